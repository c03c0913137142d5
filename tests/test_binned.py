import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from tablewright.constants import BINARY, MULTICLASS, REGRESSION
from tablewright.operators.target import Target
from tablewright.plans import binned, rounds, training
from tablewright.plans.binned import Bins, bin_table, grow, pruned
from tablewright.plans.compact import CompactForest
from tablewright.plans.explain import explain_rows, shap_summary
from tablewright.plans.model import ScoringModel, score
from tablewright.plans.preprocess import preprocess
from tablewright.plans.training import Boosting, SuiteOptions, run_suite
from tablewright.session import scratch_path

SMALL = SuiteOptions(trees=12, forest_depth=8, boosting={"gbt_fast": Boosting(4, 3, 0.3)}, max_iter=20)


def rows_of(spark, n=400):
    """Rows with copies; b has more values than bins, c is a flag."""
    rng = np.random.default_rng(3)
    some = pd.DataFrame({"id": np.arange(n), "a": rng.integers(0, 6, n), "b": np.round(rng.normal(0, 1, n), 2), "c": rng.integers(0, 2, n)})
    some["y"] = np.round(some.a * 2 + some.b * some.c + rng.normal(0, 0.3, n), 3)
    some = pd.concat([some, some.iloc[:150].assign(id=lambda d: d.id + 10_000)])
    return spark.createDataFrame(some)


def features(df, label):
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df.withColumn("label", label.cast("double"))).select("features", "label").persist()


def test_a_table_holds_every_row_once(spark):
    df = rows_of(spark)
    table = bin_table(features(df, F.col("y")), 550, 3, 32, 1)
    rows = df.toPandas()
    assert table.count.sum() == 550 and len(table.label) < 550
    assert [len(c) for c in table.cuts] == [5, 31, 1]
    keys = [tuple(np.searchsorted(c, rows[f].to_numpy(float))) for f, c in zip("abc", table.cuts)]
    expected = pd.DataFrame(np.array(keys).T).assign(y=rows.y).value_counts()
    got = {(*map(int, table.bins[:, i]), table.label[i]): int(table.count[i]) for i in range(len(table.label))}
    assert got == {(int(k[0]), int(k[1]), int(k[2]), k[3]): v for k, v in expected.items()}
    again = bin_table(features(df.repartition(5), F.col("y")), 550, 3, 32, 1)
    assert (again.bins == table.bins).all() and (again.label == table.label).all()
    assert bin_table(features(df, F.col("y")), 550, 3, 500, 1) is None


def test_rounds_equal_sparks_learner(spark):
    df = rows_of(spark)
    for label, learner, fit in ((F.col("y"), GBTRegressor, rounds.squared), (F.col("y") > 5, GBTClassifier, rounds.logistic)):
        train = features(df, label)
        estimator = learner(maxIter=5, maxDepth=4, stepSize=0.3, maxBins=32)
        theirs = estimator.fit(train)
        table = bin_table(train, 550, 3, 32, 1)
        trees = rounds.java_trees(spark, fit(table, 5, 4, 0.3), table.cuts, 3)
        ours = rounds.spark_model(estimator, trees, [1.0] + [0.3] * 4, 3)
        read = lambda m: [r[0] for r in m.transform(train).orderBy("features").select("prediction").collect()]
        assert read(ours) == pytest.approx(read(theirs), abs=1e-9)
        assert ours.getOrDefault("maxIter") == 5 and len(ours.trees) == 5


def test_the_sparse_search_finds_what_the_dense_one_finds():
    rng = np.random.default_rng(1)
    key_of = lambda m, n, w: (node := np.sort(np.r_[np.arange(m), rng.integers(0, m, n - m)])) * w + rng.integers(0, w, n)
    for gini in (True, False):
        key = key_of(40, 600, 16)
        w = rng.integers(1, 4, 600).astype(float)
        stats = np.stack([w * (rng.integers(0, 3, 600) == k) for k in range(3)]) if gini else np.stack([w, w * rng.normal(0, 1, 600)])
        if gini:
            stats[0] += stats.sum(axis=0) == 0
        total = np.stack([np.bincount(key // 16, s, 40) for s in stats])
        dense, sparse = binned._dense(key, stats, total, 16, gini), binned._sparse(key, stats, total, 16, gini)
        assert dense[0] == pytest.approx(sparse[0]) and (dense[1] == sparse[1]).all()


def test_a_tree_splits_as_long_as_a_cut_gains():
    rng = np.random.default_rng(4)
    bins = np.unique(rng.integers(0, 8, (3, 300)).astype(np.uint8), axis=1)
    n = bins.shape[1]
    label = rng.integers(0, 3, n).astype(float)
    table = Bins(bins, tuple(np.arange(7) + 0.5 for _ in range(3)), label, np.ones(n))
    stats = np.stack([(label == k).astype(float) for k in range(3)])
    tree, leaf = grow(table, stats, True, 30, 3, None)
    assert (tree.left[leaf] < 0).all() and (tree.stats[:, leaf].argmax(axis=0) == label).mean() > 0.95
    gini = lambda rows: len(rows) - sum((label[rows] == k).sum() ** 2 for k in range(3)) / max(1, len(rows))
    for node in set(leaf.tolist()):
        rows = np.flatnonzero(leaf == node)
        # what no cut makes purer stays a leaf
        gains = [gini(rows) - gini(rows[bins[f, rows] <= b]) - gini(rows[bins[f, rows] > b]) for f in range(3) for b in range(7)]
        assert max(gains) < 1e-9
    inner = tree.left >= 0
    assert np.allclose(tree.stats[:, inner], tree.stats[:, tree.left[inner]] + tree.stats[:, tree.left[inner] + 1])
    # two leaves of one class go
    short, _ = grow(table, stats, True, 3, 3, None)
    cut = pruned(short)
    inner = np.flatnonzero(cut.left >= 0)
    a = cut.left[inner]
    told = cut.stats.argmax(axis=0)
    assert not ((cut.left[a] < 0) & (cut.left[a + 1] < 0) & (told[a] == told[a + 1])).any()
    assert cut.stats[:, 0].sum() == n == cut.stats[:, cut.left < 0].sum()
    assert len(grow(table, stats, True, 0, 3, None)[0].left) == 1


@pytest.mark.parametrize("kind", [BINARY, MULTICLASS, REGRESSION])
def test_a_suite_above_the_limit_trains_on_the_table(spark, monkeypatch, kind):
    monkeypatch.setattr(training, "LEAST_BINNED", 100)
    for learner in (GBTClassifier, GBTRegressor, DecisionTreeRegressor):
        monkeypatch.setattr(learner, "fit", lambda *_: pytest.fail("passes over the cluster"))
    rule = {BINARY: F.when(F.col("y") > 5, "high").otherwise("low"), MULTICLASS: F.when(F.col("y") > 7, "x").when(F.col("y") > 3, "y").otherwise("z"), REGRESSION: F.col("y")}
    df = rows_of(spark, 1200).withColumn("t", rule[kind]).drop("y")
    target = Target("t", kind)
    prepared = preprocess(df, target, ["id"], exclude=["id"])
    suite = run_suite(prepared, target, SMALL)
    results = suite.results.orderBy("result_id").collect()
    assert [r["model_name"] for r in results][1:] == ["random_forest", "gbt_fast"] and [r["result_id"] for r in results] == [1, 2, 3]
    quality = "r2" if kind == REGRESSION else "accuracy"
    assert all(r[quality] > 0.8 for r in results[1:])
    test = prepared.split.test(df)
    for name in ("random_forest", "gbt_fast"):
        model = suite.models[name]
        path = scratch_path(spark, "test-model")
        model.save(spark, path)
        back = ScoringModel.load(spark, path)
        columns = ["id", "prediction"] + ([] if kind == REGRESSION else ["probability"])
        a, b = ({r["id"]: r[:] for r in score(test, m).select(*columns).collect()} for m in (model, back))
        assert a == b and len(a) == test.count()
        if name == "random_forest":
            assert isinstance(model.fitted, PipelineModel) and isinstance(back.fitted.stages[0], CompactForest) and back.fitted.stages[0].n_trees == 12
            again = run_suite(prepared, target, SMALL, names=["random_forest"]).models[name]
            assert {r["id"]: r[:] for r in score(test, again).select(*columns).collect()} == a
            rows = explain_rows(test, model, ["id"])
            total = F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda acc, x: acc + x.getField("shap_value"))
            assert rows.select(F.max(F.abs(total - F.col("predicted_value")))).first()[0] < 1e-9
            assert shap_summary(test, model).count() == len(model.preprocessor.feature_names)


def test_large_tables_are_left_to_sparks_learners(spark, monkeypatch):
    monkeypatch.setattr(binned, "MOST_CELLS", 1000)
    assert bin_table(features(rows_of(spark), F.col("y")), 550, 3, 32, 1) is None
