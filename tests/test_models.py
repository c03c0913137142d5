import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.constants import BINARY, MULTICLASS, REGRESSION
from tablewright.functions.scores import argmax_index, decode_label
from tablewright.operators import metrics, ranking
from tablewright.operators.attribution import contribution_list, top_contributions
from tablewright.operators.leaderboard import best_models, training_runs
from tablewright.operators.monitor import prediction_overview, prediction_stats
from tablewright.operators.target import Target
from tablewright.operators.tree_shap import build_ensemble, shap_values
from tablewright.plans import training
from tablewright.plans.explain import explain_rows, shap_summary
from tablewright.plans.model import ScoringModel, score
from tablewright.plans.preprocess import preprocess
from tablewright.plans.training import RESULT_SCHEMA, Boosting, Suite, SuiteOptions, judge, loggable_params, run_suite
from tablewright.plans.serve import score_batch
from tablewright.session import scratch_path
from tablewright.sources.sinks import LOG_SCHEMA, read_log
from tests.conftest import SF

TINY = SuiteOptions(trees=3, forest_depth=3, boosting={"gbt_fast": Boosting(2, 2, 0.3)}, max_iter=20)


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])


@pytest.mark.parametrize("window_rows", [1_000_000, 0])
def test_auc_equals_pair_counting(spark, monkeypatch, window_rows):
    monkeypatch.setattr(ranking, "WINDOW_ROWS", window_rows)
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300)
    s = np.where(rng.random(300) < 0.35, 0.5, np.round(rng.random(300), 2))
    df = spark.createDataFrame(pd.DataFrame({"y_true": y, "score": s})).repartition(4)
    got = metrics.binary_roc_auc(df).first()[0]
    assert got == pytest.approx(brute_auc(y, s))
    assert metrics.binary_roc_auc(df.withColumn("score", -F.col("score"))).first()[0] == pytest.approx(1 - got)
    assert metrics.binary_roc_auc(df.where("y_true = 1")).first()[0] is None


def test_ovr_auc_is_null_without_a_class(spark):
    df = spark.createDataFrame([(0, [0.7, 0.2, 0.1]), (1, [0.2, 0.5, 0.3])], "y int, s array<double>")
    assert metrics.ovr_roc_auc(df, "y", F.col("s"), 3).first()[0] is None
    full = df.union(spark.createDataFrame([(2, [0.1, 0.1, 0.8])], "y int, s array<double>"))
    assert metrics.ovr_roc_auc(full, "y", F.col("s"), 3).first()[0] == pytest.approx(1.0)


def test_classification_metrics_zero_division(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "y_true int, y_pred int")
    r = metrics.classification_metrics(df, positive=1).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0) and r["accuracy"] == pytest.approx(1 / 3)
    w = metrics.classification_metrics(df).first()
    assert w["precision"] == pytest.approx((1 / 3) / 3) and w["recall"] == pytest.approx(1 / 3)


def test_regression_metrics_of_constant_truth(spark):
    make = lambda rows: metrics.regression_metrics(spark.createDataFrame(rows, "y_true double, y_pred double")).first()
    assert make([(2.0, 2.0), (2.0, 2.0)])["r2"] == 1.0
    assert make([(2.0, 2.0), (2.0, 3.0)])["r2"] == 0.0
    assert make([(2.0, 2.0)])["r2"] is None
    r = make([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)])
    assert (r["mae"], r["rmse"], r["r2"]) == pytest.approx((2 / 3, math.sqrt(2 / 3), 0.75))


def test_best_model_ties_and_missing_metrics(spark):
    runs = spark.createDataFrame(
        [(1, 7, "binary_classification", "2024-01-01"), (2, 7, "regression", "2024-01-02"), (3, 7, "regression", "2024-01-03")],
        "run_id long, dataset_id long, problem_type string, created_at string",
    )
    results = spark.createDataFrame(
        [
            (1, 1, "a", 0.9, 0.5, None, None, None), (1, 2, "b", 0.9, 0.5, None, None, None), (1, 3, "c", None, 1.0, 1.0, None, None),
            (2, 4, "a", None, None, None, 0.5, 3.0), (2, 5, "b", None, None, None, 0.5, 2.0), (2, 6, "c", None, None, None, None, None),
        ],
        "run_id long, result_id long, model_name string, roc_auc double, f1 double, accuracy double, r2 double, rmse double",
    )
    assert {r["run_id"]: r["best_model_name"] for r in best_models(runs, results).collect()} == {1: "a", 2: "b"}
    listed = training_runs(runs, results, 7).collect()
    assert [(r["run_id"], r["model_count"], r["best_model_name"]) for r in listed] == [(3, 0, None), (2, 3, "b"), (1, 3, "a")]


def test_argmax_takes_the_first_of_a_tie(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],)], "s array<double>")
    i = argmax_index(F.col("s"))
    assert df.select(decode_label(i, ["x", "y", "z"]), decode_label(i, None)).first()[:] == ("y", "1")


def test_stats_of_an_empty_log(spark):
    log = spark.createDataFrame([], LOG_SCHEMA)
    s = prediction_stats(log)
    assert s.total.first()[0] == 0 and s.most_used.first()[0] is None and s.confidence.first()[0] is None and s.trend.count() == 0
    o = prediction_overview(log).first()
    assert (o["total_predictions"], o["most_used_model"], o["average_confidence"], o["days_active"]) == (0, None, None, 0)


def tree(rows):
    cols = ["id", "prediction", "impurityStats", "leftChild", "rightChild", "split"]
    return pd.DataFrame([dict(zip(cols, r)) for r in rows])


def node(i, stats, left=-1, right=-1, feature=-1, threshold=0.0, prediction=0.0):
    return (i, prediction, stats, left, right, {"featureIndex": feature, "leftCategoriesOrThreshold": [threshold]})


def expectation(nodes, x, known):
    """Path-dependent expectation of a tree when only some features are known."""
    rows = {r["id"]: r for _, r in nodes.iterrows()}

    def walk(i):
        r = rows[i]
        if r["leftChild"] < 0:
            return r["prediction"]
        f, t = r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"][0]
        if f in known:
            return walk(r["leftChild"] if x[f] <= t else r["rightChild"])
        share = rows[r["leftChild"]]["impurityStats"][0] / r["impurityStats"][0]
        return share * walk(r["leftChild"]) + (1 - share) * walk(r["rightChild"])

    return walk(0)


def brute_shapley(nodes, x, n):
    out = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for size in range(n):
            w = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
            for s in itertools.combinations(others, size):
                out[i] += w * (expectation(nodes, x, {*s, i}) - expectation(nodes, x, set(s)))
    return out


def test_tree_shap_equals_the_definition():
    # feature 0 is split twice on one path
    nodes = tree(
        [
            node(0, [100.0], 1, 2, 0, 0.5),
            node(1, [60.0], 3, 4, 1, 1.0),
            node(2, [40.0], 5, 6, 0, 2.0),
            node(3, [20.0], prediction=1.0),
            node(4, [40.0], 7, 8, 2, 0.0),
            node(5, [30.0], 9, 10, 1, -1.0),
            node(6, [10.0], prediction=-4.0),
            node(7, [15.0], prediction=2.5),
            node(8, [25.0], prediction=7.0),
            node(9, [12.0], prediction=0.5),
            node(10, [18.0], prediction=3.0),
        ]
    )
    e = build_ensemble([(nodes, 1.0)], 4, "boosted")
    xs = np.random.default_rng(2).normal(0, 2, (40, 4))
    phi = shap_values(e, xs)[:, 0, :]
    for x, p in zip(xs, phi):
        assert p == pytest.approx(brute_shapley(nodes, x, 4), abs=1e-12)
        assert e.base[0] + p.sum() == pytest.approx(expectation(nodes, x, {0, 1, 2, 3}))


def test_contributions_sorted_and_cut(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    listed = contribution_list([F.col(c) for c in "abc"], [F.lit(0.1), F.lit(-0.5), F.lit(0.2)], list("abc"))
    top = df.select(top_contributions(listed, 2).alias("t")).first()["t"]
    assert [(t["feature"], t["bar_width"]) for t in top] == [("b", 100.0), ("c", pytest.approx(40.0))]


@pytest.fixture(scope="module")
def fitted(spark, table):
    df = table("customer").drop("c_name").withColumn("rich", F.when(F.col("c_acctbal") + F.col("c_nationkey") * 50 > 5000, "yes").otherwise("no"))
    target = Target("rich", BINARY)
    prepared = preprocess(df, target, ["c_custkey"], exclude=["c_custkey"])
    return df, prepared, run_suite(prepared, target, TINY)


def test_suite_results(fitted):
    _, prepared, s = fitted
    rows = s.results.collect()
    assert [r["model_name"] for r in rows] == ["logistic_regression", "random_forest", "gbt_fast"]
    assert all(0 <= r["accuracy"] <= 1 and r["roc_auc"] > 0.5 and r["mae"] is None and r["training_time_seconds"] > 0 for r in rows)
    assert rows[1]["params"]["numTrees"] == "3"
    assert s.run.first()["class_labels"] == ["no", "yes"]


def test_saved_model_predicts_the_same(spark, fitted):
    df, _, s = fitted
    for name, model in s.models.items():
        path = scratch_path(spark, "test-model")
        model.save(spark, path)
        back = ScoringModel.load(spark, path)
        a = score(df, model).select("c_custkey", "prediction", "probability")
        b = score(df, back).select("c_custkey", "prediction", "probability")
        assert a.exceptAll(b).count() == 0, name
        assert back.feature_columns == model.feature_columns and back.labels == ["no", "yes"]


def test_scoring_text_rows_and_missing_columns(spark, fitted):
    df, _, s = fitted
    model = s.models["random_forest"]
    text = df.select(*[F.concat(F.lit(" "), F.col(c).cast("string")).alias(c) if c in ("c_nationkey", "c_acctbal") else F.col(c) for c in df.columns])
    a = score(df, model).select("c_custkey", "prediction")
    b = score(text, model).select("c_custkey", "prediction")
    assert a.exceptAll(b).count() == 0
    with pytest.raises(ValueError, match="Missing required fields: c_acctbal"):
        score(df.drop("c_acctbal"), model)


def test_batch_scoring_appends_to_the_log(spark, fitted):
    df, _, s = fitted
    log = scratch_path(spark, "test-log")
    for fmt in ("parquet", "csv"):
        r = score_batch(df, s.models["logistic_regression"], scratch_path(spark, "test-out"), log, 4, 2, fmt)
        assert r.row_count == df.count() and 0.5 <= r.avg_confidence <= 1
    assert read_log(spark, log).where("project_id = 4 and prediction_type = 'batch'").count() == 2


def test_explanations_add_up(spark, fitted):
    df, prepared, s = fitted
    test = prepared.split.test(df)
    total = F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x.getField("shap_value"))
    links = {"logistic_regression": 1 / (1 + F.exp(-total)), "random_forest": total, "gbt_fast": 1 / (1 + F.exp(-2 * total))}
    for name, model in s.models.items():
        rows = explain_rows(test, model, ["c_custkey"])
        assert rows.select(F.max(F.abs(links[name] - F.col("predicted_value")))).first()[0] < 1e-9, name
        if name != "random_forest":
            assert {r[0] for r in rows.select("explained_class").distinct().collect()} == {"yes"}
        else:
            assert rows.where("explained_class <> predicted_class").count() == 0
        imp = shap_summary(test, model).collect()
        assert [r["feature"] for r in imp][0] in ("c_acctbal", "c_nationkey") and len(imp) == len(model.preprocessor.feature_names)


def test_multiclass_boosting_gives_probabilities(spark, table):
    df = table("orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    target = Target("o_orderstatus", MULTICLASS)
    p = preprocess(df, target, ["o_orderkey"], exclude=["o_orderkey"])
    s = run_suite(p, target, TINY, names=["gbt_fast"])
    r = s.results.first()
    assert r["roc_auc"] is not None and 0 <= r["f1"] <= 1
    scored = score(p.split.test(df), s.models["gbt_fast"])
    assert scored.where("probability < 0.333 or probability > 1").count() == 0
    assert {x[0] for x in scored.select("prediction").distinct().collect()} <= {"F", "O", "P"}


def test_judge_regression_and_params(spark):
    scored = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0)], "label double, value double")
    assert judge(scored, Target("y", REGRESSION), 0)["mae"] == 0.25
    from pyspark.ml.regression import LinearRegression

    assert "maxIter" in loggable_params(LinearRegression())


def test_explanations_of_any_number_of_nodes(spark, fitted, monkeypatch):
    from tablewright.operators import tree_shap
    from tablewright.plans import explain

    df, prepared, s = fitted
    test, model = prepared.split.test(df), s.models["random_forest"]
    read = lambda: {r["c_custkey"]: r for r in explain_rows(test, model, ["c_custkey"]).collect()}
    phi = lambda r: {c["feature"]: c["shap_value"] for c in r["contributions"]}
    whole = read()
    # fewer nodes than a tree has: three groups
    monkeypatch.setattr(tree_shap, "NODES_PER_PART", 4)
    monkeypatch.setattr(explain, "NODES_PER_PART", 4)
    parts = read()
    assert set(parts) == set(whole)
    for k, r in whole.items():
        assert math.isclose(r["base_value"], parts[k]["base_value"], rel_tol=1e-9)
        assert all(math.isclose(v, phi(parts[k])[f], rel_tol=1e-9, abs_tol=1e-12) for f, v in phi(r).items())
    assert tree_shap._tree_groups([(0, 3), (1, 1), (2, 9), (3, 2)]) == [(0, 1), (2, 2), (3, 3)]
    assert SuiteOptions().forest_depth == 30


@pytest.mark.parametrize("name", ["train_suite_binary", "train_suite_multiclass", "train_suite_regression"])
def test_suite_queries_train_at_full_size_on_all_columns(spark, monkeypatch, name):
    from tablewright.catalog import training

    seen = {}

    def run(prepared, target, options=SuiteOptions(), **_):
        seen.update(options=options, columns=prepared.preprocessor.input_columns)
        assert prepared.features("train").where("features IS NULL").count() == 0
        empty = spark.createDataFrame([], RESULT_SCHEMA)
        return Suite(empty, empty, {})

    monkeypatch.setattr(training, "run_suite", run)
    out = training.QUERIES[name](spark, SF)
    many = ["c_name"] if name == "train_suite_binary" else ["o_orderdate", "o_custkey"]
    assert seen["options"] == SuiteOptions() and set(many) <= set(seen["columns"])
    assert "training_time_seconds" not in out.columns


def test_training_rows_of_one_partition_are_spread(spark):
    one = spark.range(35_000).coalesce(1).withColumn("label", F.col("id") % 2)
    spread = training._spread(one, 35_000)
    assert spread.rdd.getNumPartitions() == 3 and max(spread.rdd.glom().map(len).collect()) < 12_000
    assert spread.agg(F.sum("id")).first()[0] == sum(range(35_000))
    assert training._spread(one, 19_999).rdd.getNumPartitions() == 1
    assert training._spread(one, 900_000).rdd.getNumPartitions() == 36


@pytest.mark.parametrize("kind", [BINARY, MULTICLASS, REGRESSION])
def test_forests_grow_in_parts_on_few_partitions(spark, monkeypatch, tmp_path, kind):
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor

    from tablewright.plans import forest
    from tablewright.plans.training import estimators, fit_model

    label = {BINARY: F.col("id") % 2, MULTICLASS: F.col("id") % 3, REGRESSION: F.col("id") / 10}[kind]
    rows = spark.range(600).select((F.col("id") % 6).alias("a"), F.hash("id").alias("b"), label.cast("double").alias("label"))
    train = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows).select("features", "label").repartition(6)
    estimator = estimators(Target("y", kind), 600, SuiteOptions(trees=23, forest_depth=5))["random_forest"]
    learner = RandomForestRegressor if kind == REGRESSION else RandomForestClassifier
    fits, fit = [], learner.fit

    def seen(self, df, *rest):
        fits.append((self.getNumTrees(), self.getSeed(), (self.getMaxDepth(), df.rdd.getNumPartitions(), df.count())))
        return fit(self, df, *rest)

    monkeypatch.setattr(learner, "fit", seen)
    monkeypatch.setattr(forest, "WHOLE_ROWS", 100)
    monkeypatch.setattr(forest, "PARTITION_ROWS", 300)
    classes = {BINARY: 2, MULTICLASS: 3, REGRESSION: 0}[kind]
    model = fit_model(estimator, train, classes)
    # all trees at the same depth on all rows, in parts with seeds of their own
    assert sorted(n for n, *_ in fits) == [3, 10, 10] and len({s for _, s, *_ in fits}) == 3
    assert {rest for *_, rest in fits} == {(5, 2, 600)}
    stage = model.stages[0]
    assert len(stage.trees) == 23 and len({t.toDebugString for t in stage.trees}) > 20
    assert stage.getOrDefault("numTrees") == stage._java_obj.getNumTrees() == 23 and stage.getOrDefault("maxDepth") == 5 and stage.numFeatures == 2
    output = "prediction" if kind == REGRESSION else "probability"
    read = lambda m: [r[0] for r in m.transform(train).orderBy("features").select(output).collect()]
    found = read(model)
    if kind == REGRESSION:  # the mean of the trees
        first = train.orderBy("features").first()["features"]
        assert found[0] == pytest.approx(sum(t._call_java("predict", first) for t in stage.trees) / 23)
    else:
        assert all(sum(p) == pytest.approx(1.0) and len(p) == classes for p in found)
    # the same rows and seed give the same forest, and a saved one is the same
    assert read(fit_model(estimator, train, classes)) == found
    model.write().save(f"{tmp_path}/m")
    back = PipelineModel.load(f"{tmp_path}/m")
    assert isinstance(back.stages[0], (RandomForestClassificationModel, RandomForestRegressionModel))
    assert len(back.stages[0].trees) == 23 and read(back) == found
    # a small table keeps one forest
    fits.clear()
    monkeypatch.setattr(forest, "WHOLE_ROWS", 600)
    assert len(fit_model(estimator, train, classes).stages[0].trees) == 23 and [n for n, *_ in fits] == [23]
