import numpy as np
from conftest import SF001
from morphospark.featureset import ORGANOID_KEYS, FeatureSet
from morphospark.operators import forest, models
from morphospark.plans import catalog_more, classification


def test_linear_estimators_run_to_their_end(spark, monkeypatch):
    """no fit has fewer iterations than its estimator's own; the support vectors converge within them."""
    made = {}

    class Seen(models.Classifier):
        def __init__(self, fs, label, estimator="random_forest", seed=0, **kw):
            super().__init__(fs, label, estimator, seed, **kw)
            made[estimator] = (self, kw)

    monkeypatch.setattr(models, "Classifier", Seen)
    rows = catalog_more.q_linear_estimators_holdout(spark, SF001).collect()
    assert {r.estimator for r in rows} == set(made) == {"logistic_regression", "linear_svc", "mlp"}
    assert not any("max_iter" in kw for _, kw in made.values())
    vectors = made["linear_svc"][0].model.stages[-1].models
    assert len(vectors) == len(made["linear_svc"][0].classes) and all(
        m.summary().totalIterations < m.getMaxIter() == 100 for m in vectors)
    fitted = made["logistic_regression"][0].model.stages[-1].summary
    assert fitted.totalIterations < 100


def _grown(rng, p, bins, depth):
    tree, front = forest._Grown(), [0]
    for _ in range(depth):
        following = []
        for node in front:
            if node == 0 or rng.random() < 0.85:  # some nodes stay leaves
                first = tree.open(node, int(rng.integers(p)), int(rng.integers(bins - 1)), 1.0, (np.ones(2), np.ones(2)))
                following += [first, first + 1]
        front = following
    return tree.arrays()


def test_rows_reach_the_same_nodes_by_tables_and_level_by_level(monkeypatch):
    """several levels at once, with an odd and an even number of features, over blocks, for all rows and for some."""
    rng = np.random.default_rng(0)
    for p, bins, depth in ((6, 32, 8), (5, 7, 6), (1, 32, 3), (2, 2, 1), (12, 64, 9), (3, 32, 0)):
        x, tree = rng.integers(0, bins, (p, 500), dtype=np.uint8), _grown(rng, p, bins, depth)
        here = np.flatnonzero(rng.random(300) < 0.6) + 100
        got = []
        for limit in (forest.TOP_FEATURES, 0):
            monkeypatch.setattr(forest, "TOP_FEATURES", limit)
            rows, way = forest._Ranged(x, bins), forest._Paths(tree, p, bins)
            assert bool(way.tables) == (limit > 0 and depth > 0)
            got.append([way.node[way.places(rows, 0, 500)].tolist(), way.node[way.places(rows, 100, 400, here)].tolist()])
        monkeypatch.undo()
        feature, split, left, _ = tree
        want = []
        for row in x.T:
            node = 0
            while left[node] != node:
                node = left[node] + (row[feature[node]] > split[node])
            want.append(int(node))
        assert got[0] == got[1] == [want, [want[i] for i in here]]


def test_halves_of_a_population_are_told_apart_once(spark, monkeypatch):
    """not once a variable."""
    rng = np.random.default_rng(5)
    rows = [(f"d{i % 4}", "ab"[i % 2], "c", str(i), float(i % 3), i, float(rng.normal(3 * (i % 2))), float(rng.normal())) for i in range(120)]
    kinds = "Date string, Drug string, Cell string, Replicate string, `Conc /uM` double, ImageNumber long, u double, v double"
    fs, seen, real = FeatureSet(spark.createDataFrame(rows, kinds), ORGANOID_KEYS, ("u", "v")), [], classification.split_flag_ordered
    monkeypatch.setattr(classification, "split_flag_ordered", lambda *a, **k: seen.append(1) or real(*a, **k))
    rep, scores = classification.classification_study(fs, None, variables=["Drug", "Conc /uM"], cv=0, num_trees=3, max_depth=2,
                                                      population_names=["Median per Organoid unsorted"])
    support = {}
    for r in rep.filter("Metric = 'support'").collect():
        support[r.Variable] = support.get(r.Variable, 0) + r.Score
    assert len(seen) == 1 and support == {"Drug": 60, "Conc /uM": 60} and scores.count() == 2


def test_elimination_ranges_its_rows_once_a_fold(spark, monkeypatch):
    """not once a set of features; a forest on shared rows is that on its own rows."""
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[i % 2], float(rng.normal(3 * (i % 2))), float(rng.normal(2 * (i % 2))), float(rng.normal())) for i in range(300)]
    fs = FeatureSet(spark.createDataFrame(rows, "id long, y string, s double, t double, noise double"), ("id", "y"), ("s", "t", "noise"))
    made, real = [], forest.RangedRows.__init__
    monkeypatch.setattr(forest.RangedRows, "__init__", lambda self, *a, **k: made.append(1) or real(self, *a, **k))
    kept, curve = models.elimination_curve(fs, "y", ["id"], folds=3, num_trees=4, max_depth=3)
    got = [tuple(r) for r in curve.collect()]
    assert [(n, f) for n, f, *_ in got] == [(n, f) for f in range(3) for n in (3, 2, 1)] and len(made) in (3, 4)
    assert all(r[2] > 0.6 for r in got if r[0] == 3) and kept
    ranged = forest.RangedRows(fs.df, fs.features, "y", ["id"])
    both = [forest.RandomForest(fs.df, fs.features, "y", ["id"], num_trees=4, max_depth=3, ranged=x) for x in (None, ranged)]
    assert both[0].importances.tolist() == both[1].importances.tolist()
    few = forest.RandomForest(fs.df, ["noise", "t"], "y", num_trees=4, max_depth=3, ranged=ranged)
    assert few.importances[1] > 0.6 and [c.tolist() for c in few.cuts] == [ranged.cuts[i].tolist() for i in (2, 1)]
    ranged.release()


def test_ranged_rows_are_kept_and_dealt_in_packs(spark):
    """a record for thousands of rows, in the order of classes, seeds and bytes of the rows."""
    df = spark.range(0, 30_000, 1, 3).selectExpr("id", "cast(id % 40 as double) a", "if(id % 50 = 0, null, cast(id % 3 as string)) y")
    ranged = forest.RangedRows(df, ["a"], "y", ["id"])
    kept = ranged.rows.collect()
    assert 30_000 / forest.PACK <= len(kept) < 30 and ranged.sizes[None] == 600
    x, y = (np.concatenate([np.frombuffer(r[i], kind) for r in kept]) for i, kind in ((0, np.uint8), (1, np.int32)))
    assert len(x) == len(y) == sum(len(r.s) // 8 for r in kept) == 30_000
    want = df.groupBy("y", "a").count().collect()
    code = {"0": 0, "1": 1, "2": 2, None: 3}
    assert {(code[r.y], int(np.searchsorted(ranged.cuts[0], r.a))) for r in want} == set(zip(y.tolist(), x.tolist()))
    assert np.bincount(y).tolist() == [ranged.sizes[k] for k in ("0", "1", "2", None)]
    ranged.release()
