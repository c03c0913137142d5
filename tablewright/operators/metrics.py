"""Model quality from (truth, prediction, score) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.ranking import running_totals


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def confusion_counts(df: DataFrame, truth: str = "y_true", prediction: str = "y_pred") -> DataFrame:
    return df.groupBy(F.col(truth).alias("y_true"), F.col(prediction).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_metrics(
    df: DataFrame, truth: str = "y_true", prediction: str = "y_pred", positive=None
) -> DataFrame:
    """Accuracy, precision, recall and F1.

    With ``positive`` they describe that class; without, they are averaged over
    the classes weighted by support. Undefined ratios count as zero.
    """
    cells = confusion_counts(df, truth, prediction)
    if positive is not None:
        pos = F.lit(positive)
        hit = F.sum(F.when((F.col("y_true") == pos) & (F.col("y_pred") == pos), F.col("n")).otherwise(0))
        said = F.sum(F.when(F.col("y_pred") == pos, F.col("n")).otherwise(0))
        real = F.sum(F.when(F.col("y_true") == pos, F.col("n")).otherwise(0))
        right = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
        sums = cells.agg(
            hit.alias("hit"), said.alias("said"), real.alias("real"), right.alias("right"), F.sum("n").alias("n")
        )
        return sums.select(
            _or_zero(F.try_divide(F.col("right").cast("double"), F.col("n"))).alias("accuracy"),
            _or_zero(F.try_divide(F.col("hit").cast("double"), F.col("said"))).alias("precision"),
            _or_zero(F.try_divide(F.col("hit").cast("double"), F.col("real"))).alias("recall"),
            _or_zero(F.try_divide(2.0 * F.col("hit"), F.col("said") + F.col("real"))).alias("f1"),
        )
    # every cell counts once for its true and once for its predicted class
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("y_true").alias("cls"),
                    F.col("n").alias("real"),
                    F.lit(0).cast("bigint").alias("said"),
                    F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hit"),
                ),
                F.struct(
                    F.col("y_pred").alias("cls"),
                    F.lit(0).cast("bigint").alias("real"),
                    F.col("n").alias("said"),
                    F.lit(0).cast("bigint").alias("hit"),
                ),
            )
        )
    )
    per_class = sides.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("real", "said", "hit")])
    hit = F.col("hit").cast("double")
    weighted = {
        "precision": _or_zero(F.try_divide(hit, F.col("said"))),
        "recall": _or_zero(F.try_divide(hit, F.col("real"))),
        "f1": _or_zero(F.try_divide(2.0 * hit, F.col("said") + F.col("real"))),
    }
    total = F.sum("real")
    return per_class.agg(
        _or_zero(F.try_divide(F.sum(hit), total)).alias("accuracy"),
        *[_or_zero(F.try_divide(F.sum(e * F.col("real")), total)).alias(n) for n, e in weighted.items()],
    )


def binary_roc_auc(df: DataFrame, truth: str = "y_true", score: str = "score", positive=1) -> DataFrame:
    """Exact area under the ROC curve; tied scores share their rank. NULL with a single class."""
    rows = df.select(
        F.lit(0).alias("cls"),
        (F.col(truth) == F.lit(positive)).cast("bigint").alias("pos"),
        F.col(score).cast("double").alias("score"),
    )
    return _areas(rows).agg(F.max("auc").alias("roc_auc"))


def ovr_roc_auc(df: DataFrame, truth: str, scores: Column, n_classes: int) -> DataFrame:
    """One-vs-rest area, averaged over classes by support; NULL when a class is absent.

    ``scores`` is an array with one score per class, ``truth`` the class index.
    """
    rows = df.select(F.col(truth).alias("t"), F.posexplode(scores).alias("cls", "score")).select(
        "cls", (F.col("t").cast("int") == F.col("cls")).cast("bigint").alias("pos"), F.col("score").cast("double")
    )
    areas = _areas(rows)
    complete = (F.count("auc") == n_classes)
    return areas.agg(F.when(complete, F.sum(F.col("auc") * F.col("n_pos")) / F.sum("n_pos")).alias("roc_auc"))


def _areas(rows: DataFrame) -> DataFrame:
    """``(cls, auc, n_pos)``: a positive scores above a negative with this probability.

    Rows are first combined per distinct score, so a score shared by a third of
    the rows is one row when the running totals are built.
    """
    usable = rows.where(F.col("pos").isNotNull() & F.col("score").isNotNull())
    table = usable.groupBy("cls", "score").agg(
        F.sum("pos").alias("p"), F.sum(1 - F.col("pos")).alias("q")
    )
    distinct = usable.agg(F.approx_count_distinct(F.struct("cls", "score"), 0.05).alias("d")).first()["d"]
    ranked = running_totals(table, ["cls"], ["score"], {"upto": F.col("q")}, rows_hint=int(distinct * 1.2) + 1)
    below = F.col("upto") - F.col("q")
    wins = F.sum(F.col("p").cast("double") * (below + F.col("q") / 2.0))
    pairs = F.sum("p").cast("double") * F.sum("q")
    return ranked.groupBy("cls").agg(F.try_divide(wins, pairs).alias("auc"), F.sum("p").alias("n_pos"))


def regression_metrics(df: DataFrame, truth: str = "y_true", prediction: str = "y_pred") -> DataFrame:
    """MAE, RMSE and R². A constant truth gives R² 1 for perfect predictions, else 0; one row gives NULL."""
    rows = df.select(F.col(truth).cast("double").alias("y"), F.col(prediction).cast("double").alias("p")).where(
        F.col("y").isNotNull() & F.col("p").isNotNull()
    )
    e = F.col("y") - F.col("p")
    sums = rows.agg(
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.var_pop("y").alias("var"),
        F.count(F.lit(1)).alias("n"),
    )
    flat = F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("n") < 2, None).when(F.col("var") == 0, flat).otherwise(1.0 - F.try_divide("mse", "var"))
    return sums.select("mae", F.sqrt("mse").alias("rmse"), r2.alias("r2"))
