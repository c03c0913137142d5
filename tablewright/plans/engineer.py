"""The feature-engineering chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tablewright.functions.kinds import categorical_columns, column, numeric_columns, require_column
from tablewright.operators.features import (
    FeatureReport,
    add_date_parts,
    add_interactions,
    add_squares,
    add_value_encodings,
    correlated_drops,
    date_columns,
    interaction_names,
    target_encoding_skipped,
    target_number,
)
from tablewright.operators.target import Target


def engineer_features(
    df: DataFrame, target: Target, keep: Sequence[str] = (), fit_on: DataFrame | None = None
) -> tuple[DataFrame, FeatureReport]:
    """Dates, products, squares, value encodings, then correlation pruning.

    ``keep`` names columns such as row keys that travel along untouched. The
    frame that comes back holds the features, the kept columns and the target.
    """
    require_column(df, target.name)
    aside = [target.name, *keep]
    categorical = categorical_columns(df, aside)
    n_before = len(df.columns) - len(set(aside))

    dates = date_columns(df, categorical)
    plain = [n for n in categorical if n not in dates]
    out = add_date_parts(df, dates)
    numeric = numeric_columns(out, aside)
    pairs, skipped = interaction_names(numeric)
    out = add_interactions(out, numeric)
    # squares of the columns that existed before the products
    out = add_squares(out, numeric)
    no_target_encoding = target_encoding_skipped(plain, target)
    base = fit_on if fit_on is not None else df
    y = None if no_target_encoding or not plain else target_number(base, target)
    out = add_value_encodings(out, plain, y, fit_on=base)
    # multiclass keeps frequencies only
    drops = correlated_drops(out, numeric_columns(out, aside))
    gone = {d for d, _, _ in drops}
    out = out.select(*[column(n) for n in out.columns if n not in gone])
    report = FeatureReport(
        date_features=[(n, [f"{n}_year", f"{n}_month", f"{n}_weekday"]) for n in dates],
        interaction_features=pairs,
        interaction_skipped=skipped,
        polynomial_features=[(n, f"{n}_squared") for n in numeric],
        frequency_encoded=[(n, f"{n}_freq") for n in plain],
        target_encoded=[] if y is None else [(n, f"{n}_target_enc") for n in plain],
        target_encoding_skipped=no_target_encoding,
        dropped_correlated=drops,
        feature_count_before=n_before,
        feature_count_after=len(out.columns) - len(set(aside)),
    )
    return out, report
