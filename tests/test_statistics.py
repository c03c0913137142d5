import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions.values import size_text
from tablewright.operators import correlation, quantiles
from tablewright.operators.columns import categorical_stats, categorical_top_values, numeric_stats
from tablewright.operators.distribution import boxplots, histograms
from tablewright.operators.overview import duplicate_count, missing_values, shape, small_cardinalities, target_candidates
from tablewright.operators.sampling import sample_rows
from tablewright.operators.target import class_labels, detect_problem_type
from tablewright.plans.profile import column_profile, profile

RNG = np.random.default_rng(3)


def frame(spark, data):
    return spark.createDataFrame(pd.DataFrame(data))


@pytest.mark.parametrize("sort_rows", [500_000, 5])
def test_quantiles_equal_numpy(spark, monkeypatch, sort_rows):
    monkeypatch.setattr(quantiles, "SORT_ROWS", sort_rows)
    monkeypatch.setattr(quantiles, "SKETCH_K", 16 if sort_rows == 5 else 2048)
    n = 3000
    skew = np.where(RNG.random(n) < 0.4, 7.0, RNG.lognormal(0, 3, n))
    data = {"skew": skew, "ties": RNG.integers(0, 4, n).astype(float), "wide": RNG.normal(1e9, 1, n), "neg": -np.abs(skew)}
    probs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = quantiles.numeric_summaries(frame(spark, data).repartition(7), list(data), probs)
    for name, values in data.items():
        for p in probs:
            assert got[name].quantiles[p] == pytest.approx(np.percentile(values, p * 100), rel=1e-12)
        assert got[name].mean == pytest.approx(values.mean(), rel=1e-12)
        # a single pass in doubles loses digits in proportion to mean / deviation
        tolerance = 1e-9 + 1e-15 * abs(values.mean() / values.std())
        assert got[name].std == pytest.approx(values.std(ddof=1), rel=tolerance)


def test_quantiles_small_and_missing(spark):
    df = spark.createDataFrame(
        [(1.0, None, float("nan"), 5), (3.0, None, 2.0, 5), (2.0, None, None, 5), (10.0, None, 4.0, 5)],
        "a double, none double, gaps double, same int",
    )
    s = quantiles.numeric_summaries(df, df.columns, (0.25, 0.5))
    assert s["a"].quantiles == {0.25: 1.75, 0.5: 2.5}
    assert s["none"].median is None and s["none"].missing == 4 and s["none"].std is None
    assert s["gaps"].median == 3.0 and s["gaps"].missing == 2
    assert s["same"].std == 0.0 and s["same"].median == 5.0
    one = quantiles.numeric_summaries(df.limit(1), ["a"], (0.5,))["a"]
    assert one.median == 1.0 and one.std is None
    empty = quantiles.numeric_summaries(df.where("a > 100"), ["a"], (0.5,))["a"]
    assert empty.rows == 0 and empty.median is None


def test_numeric_stats_like_pandas(spark):
    pdf = pd.DataFrame({"x": RNG.integers(0, 30, 400), "y": RNG.normal(size=400)})
    pdf.loc[::7, "y"] = np.nan
    rows = {r["column"]: r for r in numeric_stats(frame(spark, pdf)).collect()}
    for c in pdf:
        r, s = rows[c], pdf[c].dropna()
        assert (r["mean"], r["median"], r["std"]) == pytest.approx((s.mean(), s.median(), s.std()))
        assert r["mode"] == s.mode().iloc[0] and r["missing_count"] == len(pdf) - len(s)


def test_mode_and_top_values_break_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "v string")
    assert categorical_stats(df).first().asDict() == {
        "column": "v", "missing_count": 1, "missing_pct": 16.67, "mode": "a", "unique_count": 3
    }
    assert [r["value"] for r in categorical_top_values(df, limit=2).orderBy("rank").collect()] == ["a", "b"]


def test_large_integers_stay_apart(spark):
    big = 2**53
    df = spark.createDataFrame([(big + 1,), (big + 1,), (big,), (big,), (big + 1,)], "k bigint")
    assert numeric_stats(df).first()["mode"] == float(big + 1)


def test_booleans_are_categorical_and_spelled_like_python(spark):
    df = spark.createDataFrame([(True,), (False,), (True,)], "b boolean")
    assert categorical_stats(df).first()["mode"] == "True"


def test_duplicates_with_nulls_nan_and_signed_zero(spark):
    rows = [(None, 1), (1.0, None), (None, 1), (float("nan"), 1), (0.0, 2), (-0.0, 2), (1.0, None)]
    df = spark.createDataFrame(rows, "a double, b int")
    for whole in (False, True):
        assert duplicate_count(df, whole).first()[0] == 4
    # NULL in different columns is not the same row
    assert duplicate_count(spark.createDataFrame([(None, 1), (1, None)], "a int, b int")).first()[0] == 0
    assert duplicate_count(df.where("b > 9")).first()[0] == 0


def test_duplicates_with_a_third_copied(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("v"))
    assert duplicate_count(df).first()[0] == 999


def test_missing_and_shape_of_empty_frame(spark):
    df = spark.createDataFrame([], "a double, b string")
    assert {r["missing_pct"] for r in missing_values(df).collect()} == {0.0}
    assert shape(df).first().asDict() == {
        "rows": 0, "columns": 2, "numeric_columns": 1, "categorical_columns": 1, "missing_values_pct": 0.0
    }


def test_correlation_like_pandas(spark):
    n = 500
    pdf = pd.DataFrame({"a": RNG.normal(1e6, 1, n), "b": RNG.normal(size=n), "k": 3.7, "t": RNG.random(n)})
    pdf["c"] = pdf["a"] * -2 + RNG.normal(size=n)
    pdf.loc[::5, "b"] = np.nan
    pdf["nothing"] = np.nan
    want = pdf.corr()
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in correlation.correlation_matrix(frame(spark, pdf)).collect()}
    assert len(got) == 36
    for (a, b), v in got.items():
        if math.isnan(want.loc[a, b]):
            assert v is None, (a, b)
        else:
            assert v == pytest.approx(want.loc[a, b], abs=1e-9)


@pytest.mark.parametrize("more", [0, 2])
def test_correlation_of_a_column_that_starts_late_and_far_from_zero(spark, more):
    a = F.when(F.col("id") >= 1000, F.col("id") % 100 + 1.7e9)
    df = spark.range(0, 20_000, 1, 4).select(a.alias("a"), (2 * a + 1).alias("b"), *[F.rand(k).alias(f"r{k}") for k in range(more)])
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in correlation.correlation_pairs(df).collect()}
    assert got["a", "b"] == pytest.approx(1.0, abs=1e-9) and len(got) == (2 + more) * (1 + more) // 2
    assert [r["corr"] for r in correlation.correlation_pairs(df.limit(0)).collect()] == [None] * len(got)


def test_correlation_needs_two_columns(spark):
    assert correlation.correlation_matrix(spark.createDataFrame([(1.0,)], "a double")).count() == 0


def test_histogram_like_numpy(spark):
    pdf = pd.DataFrame({"e": np.repeat(np.arange(11) / 10, 3), "r": RNG.normal(size=33), "one": 1.0})
    pdf.loc[0, "r"] = np.nan
    got = histograms(frame(spark, pdf)).orderBy("column", "bin").toPandas()
    assert set(got["column"]) == {"e", "r"}
    for c, part in got.groupby("column"):
        counts, edges = np.histogram(pdf[c].dropna(), bins=10)
        assert part["count"].tolist() == counts.tolist()
        assert part["lo"].tolist() == pytest.approx([round(float(e), 4) for e in edges[:-1]])


def test_boxplot_skips_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (100.0, None)], "a double, b double")
    rows = boxplots(df).collect()
    assert [r["column"] for r in rows] == ["a"]
    q1, q3 = np.percentile([1, 2, 3, 100], [25, 75])
    assert rows[0]["upper_whisker"] == min(100.0, q3 + 1.5 * (q3 - q1))


def test_sample_is_repeatable(spark, table):
    ev = table("events")
    a = [r["event_id"] for r in sample_rows(ev, ["event_id"]).collect()]
    b = [r["event_id"] for r in sample_rows(ev.repartition(5), ["event_id"]).collect()]
    assert a == b and len(a) == 50 and a == sorted(a)
    assert sample_rows(ev.limit(3)).count() == 3


def test_bounded_cardinality(spark):
    df = spark.range(5000).select((F.col("id") % 20).alias("d20"), (F.col("id") % 21).alias("d21"), "id", F.lit(None).cast("int").alias("n"))
    assert small_cardinalities(df, df.columns, 20) == {"d20": 20, "d21": None, "id": None, "n": 0}


def test_target_candidates_of_a_tiny_table(spark):
    df = spark.createDataFrame([(i, i % 2, "same") for i in range(10)], "id int, label int, c string")
    assert target_candidates(df) == ["label"]


def test_problem_types(spark):
    df = spark.range(60).select(
        (F.col("id") % 2).alias("two"), (F.col("id") % 20).alias("twenty"), "id", F.lit(1).alias("one"), F.col("id").cast("string").alias("text")
    )
    assert detect_problem_type(df, "two") == "binary_classification"
    assert detect_problem_type(df, "twenty") == "multiclass_classification"
    assert detect_problem_type(df, "id") == "regression"
    for bad in ("one", "text", "absent"):
        with pytest.raises(ValueError):
            detect_problem_type(df, bad)
    assert class_labels(spark.createDataFrame([(10,), (9,), (None,)], "v int"), "v") == [9, 10]


def test_profile_handles_one_kind_only(spark):
    assert column_profile(profile(spark.createDataFrame([(1.0,), (2.0,)], "a double"))).count() == 1
    p = profile(spark.createDataFrame([("x",), ("y",)], "a string"))
    assert column_profile(p).count() == 1 and p.histograms.count() == 0 and p.correlation.count() == 0


def test_column_names_with_dots_and_blanks(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b")], "`x.y z` double, `t.u` string")
    p = profile(df)
    assert {r["column"] for r in column_profile(p).collect()} == {"x.y z", "t.u"}
    assert p.histograms.count() == 10


def test_size_text():
    assert [size_text(v) for v in (0, 1023, 1024, 1536, 1024**2, 5 * 1024**4, 3 * 1024**5)] == [
        "0.0 B", "1023.0 B", "1.0 KB", "1.5 KB", "1.0 MB", "5.0 TB", "3072.0 TB"
    ]


def test_duplicates_with_nulls_inside_arrays(spark):
    df = spark.createDataFrame([([1, None],), ([1],), ([None, 1],), ([1],)], "a array<int>")
    assert duplicate_count(df).first()[0] == duplicate_count(df, whole_rows=True).first()[0] == 1
