import numpy as np
import pytest
from pyspark.sql import functions as F

from morphospark.featureset import FeatureSet
from morphospark.operators import forest, models as M
from morphospark.plans import classification


def _table(spark, parts, n=6000):
    df = spark.range(0, n, 1, parts)
    a, b = (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0 for k in (1, 2))
    return df.select("id", a.alias("a"), b.alias("b"), (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1000)) / 1000.0).alias("c")) \
        .withColumn("y", F.when(F.col("a") < 0.3, "p").when(F.col("b") < 0.5, "q").otherwise("r"))


def test_forest_does_not_depend_on_partitions(spark):
    kept = []
    for parts in (1, 7):
        fs = FeatureSet(_table(spark, parts, 900), ("id",), ("a", "b", "c"))
        clf = M.Classifier(fs, "y", num_trees=8, max_depth=4)
        kept.append((clf.score(fs), *clf.forest.importances, sorted(
            (r.id, r["class"], round(r.probability, 9)) for r in clf.predict_proba_long(fs, ["id"]).filter("id < 50").collect())))
    assert kept[0] == kept[1]
    assert kept[0][0] > 0.95 and kept[0][3] < 0.1  # c says nothing


def test_forest_agrees_with_spark_ml(spark):
    fs = FeatureSet(_table(spark, 4).withColumn("y", F.when(F.rand(5) < 0.2, "q").otherwise(F.col("y"))).cache(), ("id",), ("a", "b", "c"))
    own = M.Classifier(fs, "y", num_trees=40, max_depth=6)
    est = M.make_estimator("random_forest", num_trees=40, max_depth=6)
    rows = M.StringIndexer(inputCol="y", outputCol="_label", stringOrderType="alphabetAsc").fit(fs.df).transform(M.assemble(fs))
    model = est.fit(rows)
    theirs = model.transform(rows).agg(F.avg((F.col("prediction") == F.col("_label")).cast("double"))).first()[0]
    assert abs(own.score(fs) - theirs) < 0.01
    assert np.abs(own.forest.importances - model.featureImportances.toArray()).max() < 0.06
    mean = own.predict_proba_long(fs, ["id"]).groupBy("class").agg(F.avg("probability")).collect()
    for i, y in enumerate(("p", "q", "r")):
        want = model.transform(rows).agg(F.avg(M.vector_to_array("probability")[i])).first()[0]
        assert abs(dict(mean)[y] - want) < 0.01


def test_groups_of_nodes_change_no_counts(spark):
    fs = FeatureSet(_table(spark, 3), ("id",), ("a", "b", "c"))
    one = forest.RandomForest(fs.df, fs.features, "y", ["id"], num_trees=6, max_depth=1, max_memory_mb=64)
    few = forest.RandomForest(fs.df, fs.features, "y", ["id"], num_trees=6, max_depth=1, max_memory_mb=0)  # a node at a time
    assert one.importances.tolist() == few.importances.tolist()


def test_odd_inputs(spark):
    rows = [(i, float("nan") if i % 5 == 0 else None if i % 7 == 0 else float(i % 3), 1.0, None, "x" if i % 3 else "z")
            for i in range(300)]
    fs = FeatureSet(spark.createDataFrame(rows, "id long, a double, b double, c double, y string"), ("id",), ("a", "b", "c"))
    clf = M.Classifier(fs, "y", num_trees=10, max_depth=3)
    assert clf.score(fs) > 0.7 and clf.classes == ["x", "z"]
    single = M.Classifier(FeatureSet(fs.df.filter("y = 'x'"), fs.keys, fs.features), "y", num_trees=3, max_depth=3)
    assert {(r["class"], r.probability) for r in single.predict_proba_long(fs, ["id"]).collect()} == {("x", 1.0)}
    with pytest.raises(ValueError):
        M.Classifier(FeatureSet(fs.df.filter("y = 'none'"), fs.keys, fs.features), "y", num_trees=3)


def test_cut_points_keep_rare_and_large_values():
    assert forest.cut_points([0.0] * 1000 + [1.0], 32).tolist() == [0.5]
    assert forest.cut_points([5.0] * 10, 32).tolist() == [] == forest.cut_points([], 32).tolist()
    assert len(forest.cut_points(range(1001), 32)) == 31
    assert forest.cut_points([-1.7e308, 1.7e308], 32).tolist() == [0.0]


def test_bags_are_poisson():
    w = forest.bags(np.arange(20000), 10)
    assert w.shape == (10, 20000) and abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    assert abs(np.corrcoef(w).round(2) - np.eye(10)).max() < 0.05


def test_report_and_holdout_score_read_one_set_of_predictions(spark, monkeypatch):
    fs = FeatureSet(_table(spark, 3, 600), ("id", "y"), ("a", "b", "c"))
    seen = []
    real = M.Classifier.transform
    monkeypatch.setattr(M.Classifier, "transform", lambda self, x: seen.append(1) or real(self, x))
    rep, scores = classification.classify_one(fs, [F.col("id")], "y", cv=0, num_trees=5, max_depth=3)
    right = {r.label: r.Score for r in rep.filter("Metric = 'support'").collect()}
    assert len(seen) == 1 and sum(right.values()) == 300 and scores["holdout"] > 0.9
