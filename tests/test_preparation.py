import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.constants import BINARY, MULTICLASS, REGRESSION
from tablewright.functions.dates import parsed_date
from tablewright.operators import lookup, ranking, split as split_module
from tablewright.operators.encode import label_encode, ordinal_codes
from tablewright.operators.features import add_value_encodings, correlated_drops, date_columns, interaction_names
from tablewright.operators.impute import missing_value_plan, scaler_of
from tablewright.operators.quantiles import numeric_summaries
from tablewright.operators.split import fit_split, train_quotas
from tablewright.operators.target import Target
from tablewright.plans.engineer import engineer_features
from tablewright.plans.preprocess import FittedPreprocessor, preprocess
from tablewright.session import scratch_path


def classes(spark, n=4000):
    """One class holds two thirds of the rows."""
    return spark.range(n).select(
        "id", F.when(F.col("id") % 3 > 0, "big").when(F.col("id") % 30 == 0, "rare").otherwise("mid").alias("y")
    )


@pytest.mark.parametrize("rank_rows", [200_000, 3])
def test_split_sizes_and_disjointness(spark, monkeypatch, rank_rows):
    monkeypatch.setattr(split_module, "RANK_ROWS", rank_rows)
    df = classes(spark)
    s = fit_split(df, Target("y", MULTICLASS), ["id"])
    assert s.stratified and s.test_rows == 800 and s.train_rows == 3200
    train, test = s.train(df), s.test(df)
    assert (train.count(), test.count()) == (3200, 800)
    assert train.join(test, "id", "left_semi").count() == 0
    share = {r["y"]: r["count"] for r in test.groupBy("y").count().collect()}
    total = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    assert all(abs(share[c] - total[c] * 0.2) <= 1 for c in total)
    # the same rows whatever the partitioning
    assert test.exceptAll(s.test(df.repartition(9))).count() == 0


def test_split_thresholds_agree_with_or_without_prefix_passes(spark, monkeypatch):
    df = classes(spark, 1000)
    a = fit_split(df, Target("y", MULTICLASS), ["id"])
    monkeypatch.setattr(split_module, "RANK_ROWS", 1)
    assert fit_split(df, Target("y", MULTICLASS), ["id"]).thresholds == a.thresholds


def test_split_falls_back_for_a_single_member(spark):
    df = spark.range(101).select("id", F.when(F.col("id") == 5, "once").otherwise("many").alias("y"))
    s = fit_split(df, Target("y", BINARY), ["id"])
    assert not s.stratified and s.test_rows == 21


def test_split_drops_rows_without_target(spark):
    df = spark.range(50).select("id", F.when(F.col("id") >= 10, F.col("id").cast("double")).alias("y"))
    s = fit_split(df, Target("y", REGRESSION), ["id"])
    assert (s.dropped_rows, s.train_rows + s.test_rows, s.test_rows) == (10, 40, 8)


def test_split_without_key_keeps_copies_together(spark):
    df = spark.range(300).select((F.col("id") % 100).cast("double").alias("y"))
    s = fit_split(df, Target("y", REGRESSION))
    assert s.train(df).distinct().join(s.test(df).distinct(), "y", "left_semi").count() == 0


def test_train_quotas_follow_the_largest_remainder():
    assert sum(train_quotas([7, 7, 7], 16)) == 16
    assert train_quotas([10, 5], 12) == [8, 4]


def test_running_totals_both_ways(spark):
    pdf = pd.DataFrame({"g": np.repeat(["a", "b"], 500), "o": np.tile(np.random.default_rng(1).permutation(500), 2), "n": 2})
    df = spark.createDataFrame(pdf).repartition(5)
    want = pdf.sort_values(["g", "o"]).assign(t=lambda d: d.groupby("g")["n"].cumsum())
    for hint in (10, None):
        got = ranking.running_totals(df, ["g"], ["o"], {"t": F.col("n")}, hint).orderBy("g", "o").toPandas()
        assert got["t"].tolist() == want["t"].tolist()


def test_ordinal_codes_are_sorted_ranks(spark):
    df = spark.createDataFrame([("b",), ("é",), ("a",), ("b",), (None,), ("Z",)], "v string")
    for hint in (10, None):
        got = {r["key"]: r["code"] for r in ordinal_codes(df, "v", hint).collect()}
        assert got == {"Z": 0, "a": 1, "b": 2, "é": 3}


@pytest.mark.parametrize("size", [0, 1 << 60])
def test_lookup_with_a_hot_value(spark, monkeypatch, size):
    monkeypatch.setattr(lookup, "HOT_SHARE", 3)
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 5 == 0, None).otherwise(F.col("id").cast("string")).alias("v")
    )
    mapping = df.where("v is not null").groupBy(F.col("v").alias("key")).agg(F.count("*").alias("n"), F.max("id").alias("m")).where("key <> '7'")
    out = lookup.left_lookup(df, "v", mapping, ["m"], size, "n", 3000)
    assert out.columns == ["id", "v", "m"] and out.count() == 3000
    want = df.join(mapping.select(F.col("key").alias("v"), "m"), "v", "left").select("id", "v", "m")
    assert out.exceptAll(want).count() == 0 and want.exceptAll(out).count() == 0


def test_scaler_closed_form(spark):
    values = [1.0, 4.0, None, 9.0, None, 2.5]
    s = numeric_summaries(spark.createDataFrame([(v,) for v in values], "x double"), ["x"])["x"]
    filled = np.array([v if v is not None else s.median for v in values])
    assert scaler_of(s) == pytest.approx((filled.mean(), filled.std()))


def test_constant_column_scales_by_one(spark):
    s = numeric_summaries(spark.createDataFrame([(2.0,), (2.0,)], "x double"), ["x"])["x"]
    assert scaler_of(s) == (2.0, 1.0)


def test_missing_plan_of_an_all_null_category(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None)], "c string, x double")
    assert {(r["column"], r["strategy"], r["fill_value"]) for r in missing_value_plan(df).collect()} == {
        ("c", "mode", ""), ("x", "median", "1.0")
    }


def mixed(spark):
    return spark.range(400).select(
        "id",
        F.when(F.col("id") % 9 > 0, F.col("id").cast("double") * 1.5).alias("x"),
        F.lit(None).cast("double").alias("void"),
        F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, "b").alias("few"),
        F.concat(F.lit("k"), (F.col("id") % 37).cast("string")).alias("many"),
        (F.col("id") % 2 == 0).alias("flag"),
        F.when(F.col("id") % 3 == 0, "yes").otherwise("no").alias("y"),
    )


def test_preprocess_report_and_features(spark):
    df = mixed(spark)
    p = preprocess(df, Target("y", BINARY), ["id"], exclude=["id"])
    rep = p.report
    assert rep.excluded_columns == ["void"] and rep.stratified and rep.test_rows == 80
    assert p.preprocessor.feature_names == ["x", "few_a", "few_b", "flag_False", "flag_True", "many"]
    assert rep.feature_count_after == 6 and rep.feature_count_before == 5
    train = p.features("train", keep=["id"]).collect()
    assert len(train) == 320 and all(len(r["features"]) == 6 for r in train)
    z = np.array([r["features"][0] for r in train])
    assert np.abs(z).max() <= 3.0 and abs(z.mean()) < 1e-9
    assert all(r["features"][1] + r["features"][2] == 1.0 for r in train)  # missing category takes the mode


def test_preprocessor_saves_and_meets_unseen_values(spark):
    df = mixed(spark)
    p = preprocess(df, Target("y", BINARY), ["id"], exclude=["id"]).preprocessor
    path = scratch_path(spark, "test-prep")
    p.save(spark, path)
    back = FittedPreprocessor.load(spark, path)
    new = spark.createDataFrame([(1e9, "new", "never", None)], "x double, few string, many string, flag boolean")
    for one in (p, back):
        f = one.transform(new).first()["features"].toArray()
        assert f[1] == f[2] == 0.0 and f[5] == -1.0 and f[3] + f[4] == 1.0 and f[0] > 3.0
        assert one.transform(new, clip=True).first()["features"][0] == 3.0
    with pytest.raises(ValueError, match="Missing required fields: few, many"):
        p.transform(new.drop("few", "many"))


def test_label_encode_numbers_in_numeric_order(spark):
    df = spark.createDataFrame([(10,), (9,), (None,)], "v int")
    assert [r["label"] for r in label_encode(df, "v", [9, 10]).collect()] == [1.0, 0.0, None]


def test_engineer_features_multiclass_skips_target_encoding(spark):
    df = mixed(spark).drop("void").withColumn("when", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")), "yyyy/MM/dd"))
    out, rep = engineer_features(df.withColumn("y3", F.col("id") % 3), Target("y3", MULTICLASS), keep=["id", "y"])
    assert rep.date_features == [("when", ["when_year", "when_month", "when_weekday"])]
    assert rep.target_encoded == [] and "multiclass" in rep.target_encoding_skipped
    assert "when" not in out.columns and "few_freq" in out.columns
    assert rep.feature_count_after == len(out.columns) - 3 and out.count() == 400


def test_interactions_are_capped_not_sampled():
    assert interaction_names(list("abcdefg"))[0] == [] and interaction_names(list("abcdefg"))[1].startswith("Skipped")
    assert len(interaction_names(list("abcdef"))[0]) == 15 and interaction_names(["a"]) == ([], None)


def test_value_encodings_like_pandas(spark):
    pdf = pd.DataFrame({"k": ["a", "a", "b", None, "c"], "y": [1.0, 3.0, 5.0, 7.0, np.nan]})
    out = add_value_encodings(spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k string, y double"), ["k"], F.col("y"))
    got = {r["k"]: (r["k_freq"], r["k_target_enc"]) for r in out.collect()}
    assert got == {"a": (0.5, 2.0), "b": (0.25, 5.0), "c": (0.25, None), None: (None, None)}


def test_correlated_drop_is_greedy_in_order(spark):
    pdf = pd.DataFrame({"a": np.arange(50.0)})
    pdf["b"], pdf["c"], pdf["k"] = pdf["a"] * 2, -pdf["a"], 1.0
    assert correlated_drops(spark.createDataFrame(pdf)) == [("b", "a", 1.0), ("c", "a", 1.0)]


def test_date_columns(spark):
    df = spark.createDataFrame(
        [("2024-01-05", "05-Jan-2024", "12", None), ("2024-02-30", "x", "13", None)] + [("2024-03-01", "06-Feb-2023", "14", None)] * 18,
        "iso string, named string, num string, void string",
    )
    assert date_columns(df) == ["iso", "named"]


def test_years_above_9999_are_dates(spark, tmp_path):
    from tablewright.catalog.features import engineered

    spelt = {"+10000-02-07": (10000, 2), "+179400-12-31T10:30:00Z": (179400, 12), "+293999-01-01": (293999, 1), "+294000-01-01": None, "+999999-01-01": None, "+10000-02-30": None, "+1995-01-01": None, "12345-01-01": None}
    d = parsed_date(df := spark.createDataFrame([(t,) for t in spelt], "t string"), "t")
    assert {r[0]: None if r[1] is None else (r[1], r[2]) for r in df.select("t", F.year(d), F.month(d)).collect()} == spelt
    # most dates of these parts have more than four digits
    key = (F.col("id") * 400_000 + 7).alias("p_partkey")
    parts = spark.range(12).select(key, F.lit("a").alias("p_name"), F.lit("b").alias("p_brand"), (F.col("id") % 5).cast("int").alias("p_size"), (F.col("id") % 3 + 1.0).alias("p_retailprice"))
    parts.write.parquet(f"{tmp_path}/part.parquet")
    years = {r["p_partkey"]: int(r["made_year"]) for r in engineered(spark, str(tmp_path)).collect()}
    assert len(years) == 12 and all(abs(y - 1995 - k * 9 / 365.2425) < 1.01 for k, y in years.items())


def test_large_lookups_grow_linearly(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    rows = spark.range(400).select("id", *[F.when(F.col("id") % 3 > 0, F.col("id") % (50 + k)).alias(f"c{k}") for k in range(4)])
    out = rows
    for k in range(4):
        mapping = rows.where(f"c{k} IS NOT NULL").groupBy(F.col(f"c{k}").alias("key")).agg(F.count("*").alias("n"), F.min("id").alias(f"m{k}"))
        out = lookup.left_lookup(out, f"c{k}", mapping, [f"m{k}"], 1, "n")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Range (0, 400") <= 1 + 2 * 4
    got = out.toPandas()
    assert len(got) == 400
    for k in range(4):
        want = got.groupby(f"c{k}")["id"].transform("min")
        assert got[f"m{k}"].equals(want.where(got[f"c{k}"].notna()))
