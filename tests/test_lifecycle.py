"""Joint boosting, stored and promoted models, logged streams, upserted trends, exact splits and samples, dates."""

import datetime
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablewright.constants import BINARY, MULTICLASS, REGRESSION
from tablewright.functions.dates import parse_date_text
from tablewright.operators import correlation, split as split_module, sampling, tree_shap
from tablewright.operators.sampling import sample_rows
from tablewright.operators.split import fit_split
from tablewright.operators.target import Target
from tablewright.plans import explain
from tablewright.plans.boosting import fit_joint_boosting
from tablewright.plans.engineer import engineer_features
from tablewright.plans.explain import explain_position, explain_rows, row_at, shap_frame
from tablewright.plans.model import ScoringModel, load_promoted, model_scores, promote_model, promote_saved, promoted_path, promotions
from tablewright.plans.preprocess import preprocess
from tablewright.plans.serve import score_batch
from tablewright.plans.training import Boosting, SuiteOptions, append_experiment, estimators, load_result, read_experiments, run_suite
from tablewright.session import remove, scratch_path, shared_dir
from tablewright.sources.sinks import append_log, read_log
from tablewright.streaming import scoring, trend
from tests.conftest import SF

TINY = SuiteOptions(trees=3, forest_depth=3, boosting={"gbt_fast": Boosting(3, 2, 0.5)}, max_iter=20)


@pytest.fixture(scope="module")
def three(spark):
    """Three classes that cuts along the axes separate, and a column of noise."""
    rng = np.random.default_rng(3)
    x = rng.random((600, 3))
    y = np.where(x[:, 0] > 0.6, 2, np.where(x[:, 1] > 0.5, 1, 0))
    df = spark.createDataFrame(pd.DataFrame({"id": range(600), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": [f"k{v}" for v in y]}))
    target = Target("y", MULTICLASS)
    return df, target, preprocess(df, target, ["id"], exclude=["id"])


@pytest.fixture(scope="module")
def joint(spark, three):
    df, target, prepared = three
    return run_suite(prepared, target, TINY, names=["gbt_fast"]).models["gbt_fast"]


def labelled(df, target, prepared):
    codes = F.regexp_extract(F.col(target.name), "[0-9]", 0).cast("double")
    return prepared.features("train").select("features", codes.alias("label"))


def log_loss(df, scores):
    return df.agg(F.avg(-F.log(F.greatest(F.element_at(scores, F.col("label").cast("int") + 1), F.lit(1e-15)))).alias("l")).first()["l"]


def test_joint_loss_is_below_one_model_per_class(spark, three):
    df, target, prepared = three
    train = labelled(df, target, prepared).persist()
    joint = fit_joint_boosting(train, 3, 6, 3, 0.3, 42, 256, 32)
    assert [s.getNumTrees for s in joint.stages] == [6, 6, 6]
    scored = model_scores(joint, train, target, 3)
    total = scored.select(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x).alias("t"))
    assert total.where(F.abs(F.col("t") - 1) > 1e-12).count() == 0
    alone = train
    for k in range(3):
        one = GBTClassifier(maxIter=6, maxDepth=3, stepSize=0.3, seed=42).fit(train.withColumn("label", (F.col("label") == k).cast("double")))
        p = one.setProbabilityCol(f"p{k}").setPredictionCol(f"d{k}").setRawPredictionCol(f"r{k}")
        alone = p.transform(alone)
    from pyspark.ml.functions import vector_to_array

    shares = F.array(*[F.element_at(vector_to_array(f"p{k}"), 2) for k in range(3)])
    shares = F.transform(shares, lambda x: x / F.aggregate(shares, F.lit(0.0), lambda a, y: a + y))
    assert log_loss(scored, F.col("scores")) < log_loss(alone, shares) < math.log(3)
    # equal seeds give equal trees, and the sums of the rounds are gone
    again = fit_joint_boosting(train, 3, 6, 3, 0.3, 42, 256, 32)
    assert not [f for f in os.listdir(shared_dir(spark)) if f.startswith("tablewright-margins")]
    same = model_scores(again, train, target, 3).select("scores").exceptAll(scored.select("scores"))
    assert same.count() == 0


def test_joint_model_is_saved_and_explained_per_class(spark, three, joint):
    df, target, prepared = three
    assert isinstance(joint.fitted, PipelineModel) and len(joint.fitted.stages) == 3
    path = scratch_path(spark, "joint")
    joint.save(spark, path)
    back = ScoringModel.load(spark, path)
    test = prepared.split.test(df)
    frame, base = shap_frame(test, back)
    scored = model_scores(back.fitted, frame, target, 3).collect()
    for r in scored:
        margins = np.array(base) + np.array(r["shap"]).sum(axis=1)
        shares = np.exp(margins) / np.exp(margins).sum()
        assert shares == pytest.approx(r["scores"], abs=1e-9)
    assert {r["predicted_class"] for r in explain_rows(test, back, ["id"]).collect()} <= {"k0", "k1", "k2"}


def test_only_scratch_tables_are_removed(spark):
    with pytest.raises(ValueError, match="not a scratch table"):
        remove(spark, "/somewhere/else")
    remove(spark, None)


def test_forests_keep_row_positions_between_levels():
    forest = estimators(Target("y", BINARY), 100)["random_forest"]
    assert forest.getCacheNodeIds() and forest.getCheckpointInterval() == 10 and forest.getMaxBins() == SuiteOptions().max_bins == 32


def random_tree(rng, features, depth, cover):
    rows = []

    def grow(d, n):
        at = len(rows)
        rows.append(None)
        if d == 0 or n < 2 or rng.random() < 0.1:
            share = rng.random()
            rows[at] = (at, rng.normal(), [n * share, n - n * share], -1, -1, {"featureIndex": -1, "leftCategoriesOrThreshold": []})
            return at
        k, feature, threshold = int(rng.integers(1, n)), int(rng.integers(features)), rng.normal()
        left, right = grow(d - 1, k), grow(d - 1, n - k)
        stats = [u + v for u, v in zip(rows[left][2], rows[right][2])]
        rows[at] = (at, 0.0, stats, left, right, {"featureIndex": feature, "leftCategoriesOrThreshold": [threshold]})
        return at

    grow(depth, cover)
    return pd.DataFrame(rows, columns=["id", "prediction", "impurityStats", "leftChild", "rightChild", "split"])


@pytest.mark.parametrize("features,rows", [(1, 5), (3, 40), (9, 300), (20, 30)])
def test_tables_and_single_sets_agree(features, rows, monkeypatch):
    rng = np.random.default_rng(features)
    trees = [(random_tree(rng, features, 12, 500), 0.25) for _ in range(4)]
    e = tree_shap.build_ensemble(trees, features, "forest_classes")
    x = rng.normal(size=(rows, features))
    monkeypatch.setattr(tree_shap, "SETS_PER_ROW", 1 << 20)
    tabled = tree_shap.shap_values(e, x)
    monkeypatch.setattr(tree_shap, "TABLE_BITS", -1)
    single = tree_shap.shap_values(e, x)
    assert np.allclose(tabled, single, rtol=0, atol=1e-12)
    monkeypatch.setattr(tree_shap, "CELLS_PER_BLOCK", 1)
    monkeypatch.setattr(tree_shap, "ROWS_PER_BLOCK", 7)
    monkeypatch.setattr(tree_shap, "TABLE_BITS", 12)
    assert np.allclose(tree_shap.shap_values(e, x), single, rtol=0, atol=1e-12)
    # both classes' shares add up to one, whatever is known
    assert np.allclose(tabled.sum(axis=1), 0, atol=1e-12) and e.base.sum() == pytest.approx(1.0)


def test_features_that_are_alike_get_alike_shares():
    """x0 and x1 in mirrored trees: by symmetry a row with equal values owes both the same."""
    split = lambda f, t: {"featureIndex": f, "leftCategoriesOrThreshold": [t]}
    leaf = {"featureIndex": -1, "leftCategoriesOrThreshold": []}
    columns = ["id", "prediction", "impurityStats", "leftChild", "rightChild", "split"]

    def both(first, second):
        rows = [(0, 0.0, [4.0], 1, 2, split(first, 0.0)), (1, 0.0, [2.0], -1, -1, leaf), (2, 0.0, [2.0], 3, 4, split(second, 0.0)), (3, 0.0, [1.0], -1, -1, leaf), (4, 8.0, [1.0], -1, -1, leaf)]
        return pd.DataFrame(rows, columns=columns)

    e = tree_shap.build_ensemble([(both(0, 1), 0.5), (both(1, 0), 0.5)], 3, "boosted")
    phi = tree_shap.shap_values(e, np.array([[1.0, 1.0, 5.0], [-1.0, -1.0, 5.0]]))[:, 0]
    assert e.base[0] == 2.0 and np.allclose(phi, [[3.0, 3.0, 0.0], [-1.0, -1.0, 0.0]])


def test_models_are_stored_promoted_and_explained_by_position(spark, three):
    df, target, prepared = three
    folder = scratch_path(spark, "store")
    first = run_suite(prepared, target, TINY, names=["logistic_regression", "gbt_fast"], folder=folder)
    second = run_suite(prepared, target, TINY, names=["random_forest"], folder=folder)
    for suite in (first, second):
        append_experiment(suite, folder)
    runs, results = read_experiments(spark, folder)
    ids = [s.run.first()["run_id"] for s in (first, second)]
    assert ids[0] != ids[1] and runs.count() == 2 and results.where("model_path IS NULL").count() == 0
    model = load_result(spark, results, ids[0], "gbt_fast")
    with pytest.raises(ValueError, match="no saved model"):
        load_result(spark, results, ids[0], "random_forest")
    # a folder is written once, also by the model that came from it
    with pytest.raises(Exception, match="(?i)exist"):
        model.save(spark, model.path)
    with pytest.raises(Exception, match="(?i)exist"):
        model.preprocessor.save(spark, f"{model.path}/preprocessor")
    assert ScoringModel.load(spark, model.path).labels == ["k0", "k1", "k2"]

    info = promote_model(spark, second.models["random_forest"], folder, 1)
    assert info.first()["model_name"] == "random_forest"
    promote_saved(spark, model.path, folder, 1)
    assert load_promoted(spark, folder, 1).name == "gbt_fast" and promoted_path(spark, folder, 1) == model.path
    assert [os.path.basename(r["path"]) for r in promotions(spark, folder, 1).collect()] == ["gbt_fast", "random_forest"]
    # a promotion of an unfinished folder changes nothing
    with pytest.raises(Exception):
        promote_saved(spark, f"{folder}/none", folder, 1)
    assert load_promoted(spark, folder, 1).name == "gbt_fast"

    test = prepared.split.test(df)
    n, keys = test.count(), sorted(r["id"] for r in test.select("id").collect())
    for position in (0, 17, n - 1):
        assert explain_position(test, model, ["id"], position).first()["id"] == keys[position]
    for position in (-1, n):
        with pytest.raises(ValueError, match="outside 0 to"):
            row_at(test, ["id"], position)


def test_promoting_an_unsaved_model_writes_a_version(spark, joint):
    fresh = ScoringModel(**{**joint.__dict__, "path": None})
    folder = scratch_path(spark, "store")
    promote_model(spark, fresh, folder, 9)
    assert "/versions/" in promoted_path(spark, folder, 9) and load_promoted(spark, folder, 9).name == "gbt_fast"


def test_observed_numbers_are_those_of_the_written_rows(spark, three, joint):
    df, _, _ = three
    log, out = scratch_path(spark, "log"), scratch_path(spark, "out")
    result = score_batch(df, joint, out, log, 1, 2)
    back = spark.read.parquet(out).agg(F.count("*").alias("n"), F.avg("probability").alias("c")).first()
    assert result.row_count == back["n"] == 600 and result.avg_confidence == pytest.approx(back["c"])
    empty = score_batch(df.limit(0), joint, scratch_path(spark, "out"))
    assert (empty.row_count, empty.avg_confidence) == (0, None)


def test_a_batch_that_breaks_off_is_logged_once(spark, three, joint, monkeypatch):
    df, _, _ = three
    source, out, log, checkpoint = (scratch_path(spark, x) for x in ("source", "out", "log", "checkpoint"))
    df.limit(100).write.parquet(source)
    append_log(spark, log, 1, 1, "other", "single", 1, 0.5)
    run = lambda: scoring.start_scoring(scoring.read_rows(spark, source, df.schema), joint, out, checkpoint, log=log, project_id=4).awaitTermination()
    real = scoring.append_log
    # the rows of the batch are written, its log entry is written, and then the batch fails

    def broken(*a, **b):
        real(*a, **b)
        raise RuntimeError("broken off")

    monkeypatch.setattr(scoring, "append_log", broken)
    with pytest.raises(Exception, match="broken off"):
        run()
    monkeypatch.setattr(scoring, "append_log", real)
    run()
    run()
    df.limit(30).write.mode("append").parquet(source)
    run()
    entries = [(r["prediction_type"], r["row_count"], r["project_id"]) for r in read_log(spark, log).orderBy("id").collect()]
    assert sorted(entries) == [("single", 1, 1), ("stream", 30, 4), ("stream", 100, 4)]
    assert spark.read.parquet(out).count() == 130
    mean = spark.read.parquet(out).where("batch_number = 0").agg(F.avg("probability")).first()[0]
    assert read_log(spark, log).where("row_count = 100").first()["avg_confidence"] == pytest.approx(mean)


def test_trend_of_batches_with_late_days(spark, monkeypatch):
    source, path, checkpoint = (scratch_path(spark, x) for x in ("source", "days", "checkpoint"))
    row = lambda day, n: (datetime.datetime(2024, 1, day, 12), n)
    schema = "created_at timestamp, row_count long"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: trend.start_trend_upsert(trend.read_event_stream(spark, source, "*.parquet", spark.createDataFrame([], schema).schema), path, checkpoint).awaitTermination()
    got = lambda: {r["date"].day: r["count"] for r in trend.read_trend(spark, path).collect()}
    assert got() == {}
    write([row(1, 5), row(2, 7), row(2, 1), (None, 9)])
    run()
    assert got() == {1: 5, 2: 8}
    # the next batch breaks off after its days are written, and runs again; day 1 comes late
    write([row(1, 10), row(9, 2)])
    real = spark.createDataFrame
    states = []

    def broken(*a, **b):
        states.append(1)
        raise RuntimeError("broken off")

    held = trend._held
    monkeypatch.setattr(trend, "_held", lambda *a: (held(*a).count(), broken())[0])
    with pytest.raises(Exception, match="broken off"):
        run()
    monkeypatch.setattr(trend, "_held", held)
    run()
    run()
    assert got() == {1: 15, 2: 8, 9: 2} and states
    # a day that the batch has already changed is not added to again
    before = trend._held(spark, path).where("date = '2024-01-01'").first()
    assert (before["count"], before["before"], before["batch"]) == (15, 5, 1)
    assert real


@pytest.mark.parametrize("block", [100_000, 7])
def test_keyless_split_of_few_contents(spark, monkeypatch, block):
    monkeypatch.setattr(split_module, "COPIES_PER_BLOCK", block)
    rows = [("x", 1)] * 600 + [("x", 2)] * 37 + [("y", 1)] * 240 + [("z", None)] * 3 + [(None, 5)] * 20
    df = spark.createDataFrame(rows, "y string, v int").repartition(6)
    for target, stratified in ((Target("y", MULTICLASS), True), (Target("v", REGRESSION), False)):
        split = fit_split(df, target)
        known = 880 if stratified else 897
        assert split.stratified == stratified and (split.test_rows, split.train_rows) == (math.ceil(0.2 * known), known - math.ceil(0.2 * known))
        test, train = split.test(df), split.train(df)
        assert (test.count(), train.count()) == (split.test_rows, split.train_rows)
        assert test.unionAll(train).exceptAll(df.where(F.col(target.name).isNotNull())).count() == 0
        assert df.where(F.col(target.name).isNotNull()).exceptAll(test.unionAll(train)).count() == 0
        assert split.mark(df).where("is_test").exceptAll(test.withColumn("is_test", F.lit(True))).count() == 0
    split = fit_split(df, Target("y", MULTICLASS))
    per = {r["y"]: r["count"] for r in split.test(df).groupBy("y").count().collect()}
    assert per == {"x": 127, "y": 48, "z": 1}
    assert {r["y"] for r in split.train(df).select("y").distinct().collect()} == {"x", "y", "z"}


def test_rows_of_one_key_stay_together(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("k"), "id", (F.col("id") % 2).alias("y"))
    split = fit_split(df, Target("y", BINARY), ["k"])
    assert not split.cut
    marked = split.mark(df).groupBy("k", "y").agg(F.countDistinct("is_test").alias("sides"))
    assert marked.where("sides > 1").count() == 0


@pytest.mark.parametrize("block", [100_000, 3])
def test_keyless_sample_of_few_contents(spark, monkeypatch, block):
    monkeypatch.setattr(sampling, "COPIES_PER_BLOCK", block)
    df = spark.range(3000).select((F.col("id") % 3).cast("int").alias("v"), F.when(F.col("id") % 3 > 0, "t").alias("w")).repartition(5)
    found = [tuple(r) for r in sample_rows(df).collect()]
    assert len(found) == 50 and len(set(found)) == 3
    assert sorted(map(str, found)) == sorted(map(str, (tuple(r) for r in sample_rows(df.repartition(2)).collect())))
    assert sample_rows(df.limit(4)).count() == 4 and sample_rows(df.limit(0)).count() == 0


def test_co_moments_of_parts_are_those_of_the_whole():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 5)) * [1, 1e-3, 1e6, 1, 1] + [0, 5, 1e9, -3, 7]
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 4] = np.where(np.isnan(x[:, 4]), np.nan, 0.1)
    x[:400, 3] = np.nan
    whole = correlation.CoMoments.of(x)
    parts = [correlation.CoMoments.of(x[i:j]) for i, j in zip([0, 1, 7, 300, 430], [1, 7, 300, 430, 500])]
    merged = correlation._merged(correlation.CoMoments.from_bytes(p.to_bytes(), 5) for p in parts)
    want = pd.DataFrame(x).corr(min_periods=2).to_numpy()
    for state in (whole, merged):
        with np.errstate(all="ignore"):
            r = state.co / np.sqrt(state.spread * state.spread.T)
        keep = np.ix_(range(4), range(4))
        assert np.allclose(r[keep], want[keep], atol=1e-9, equal_nan=True)
        assert (state.spread[4] == 0).all()
    assert np.array_equal(whole.n, merged.n)


def test_dates_in_everyday_spellings(spark):
    day = datetime.datetime(2024, 1, 5)
    at = lambda h=0, m=0, s=0, us=0: day.replace(hour=h, minute=m, second=s, microsecond=us)
    spelt = {
        "2024-01-05": at(), " 2024/1/5 ": at(), "1/5/2024": at(), "01/05/24": at(), "1.5.2024": at(), "20240105": at(), "05-Jan-2024": at(), "5 January 2024": at(),
        "Jan 5, 2024": at(), "January 5th, 2024 3:04 PM": at(15, 4), "Fri, 5 Jan 2024 10:30:00 GMT": at(10, 30), "2024-01-05T10:30:00Z": at(10, 30), "2024-01-05 10:30": at(10, 30),
        "2024-01-05 10:30:00.123456+02:00": at(10, 30, 0, 123456), "2024-Jan-05": at(), "1/5/2024 12:00 am": at(), "Jan 2024": at().replace(day=1), "2024-01": at().replace(day=1),
        "13/01/2024": at().replace(day=13), "sept 3, 2021": datetime.datetime(2021, 9, 3), "2024": at().replace(day=1), "29.02.2024": datetime.datetime(2024, 2, 29),
        "2023-02-29": None, "13/13/2024": None, "12.05": None, "x": None, "": None, None: None, "2024-01-05T25:00": None, "January 32, 2024": None, "1/2/3/4": None, "9999-01-01": datetime.datetime(9999, 1, 1), "1234": None,
        "2024-01-05 10:30 and more": None, "sunny 5 2024": None, "1e5": None, "-1": None, "x" * 100_000: None, "1/5/2024 13:00 pm": None,
    }
    df = spark.createDataFrame([(t,) for t in spelt], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", parse_date_text(F.col("t")).alias("d")).collect()}
    assert got == spelt


def test_reports_as_rows(spark, three):
    df, target, prepared = three
    rows = {(r["section"], r["column"], r["detail"]): r["n"] for r in prepared.report.rows(spark).collect()}
    assert rows["size", None, "train_rows"] + rows["size", None, "test_rows"] == 600
    assert rows["size", None, "feature_count_before"] == 3 and rows["size", None, "dropped_rows"] == 0
    assert rows["size", None, "total_clipped"] == sum(n for (section, _, _), n in rows.items() if section == "outliers")
    assert {c for section, c, _ in rows if section == "scaling"} == {"a", "b", "c"}
    wide = df.withColumn("twin", 2 * F.col("a")).withColumn("when", F.lit("Jan 5, 2024")).withColumn("kind", F.when(F.col("id") % 2 == 0, "x").otherwise("y"))
    _, report = engineer_features(wide, target, keep=["id"])
    made = [(r["step"], r["source"], r["made"]) for r in report.rows(spark).collect()]
    assert ("date", "when", "when_month") in made and ("frequency", "kind", "kind_freq") in made and ("square", "a", "a_squared") in made
    assert ("dropped", "twin", "a") in made and ("target_encoding_skipped", None, report.target_encoding_skipped) in made
    assert report.rows(spark).where("step = 'count' AND made = 'before'").first()["r"] == 6.0
