"""Extra trees, bagging, voting; keyed permutations; RANSAC; codes in order of appearance; elimination with folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphospark.featureset import FeatureSet
from morphospark.operators import ensembles, importance, models, ranking, ransac


@pytest.fixture(scope="module")
def moons(spark):
    """Two noisy rings and a noise feature: no line parts them."""
    rng = np.random.default_rng(0)
    n = 1200
    y = rng.integers(0, 2, n)
    angle, r = rng.uniform(0, 2 * np.pi, n), 1 + 1.5 * y + rng.normal(0, 0.2, n)
    rows = [(i, "ab"[k], float(u), float(v), float(w)) for i, (k, u, v, w) in
            enumerate(zip(y, r * np.cos(angle), r * np.sin(angle), rng.normal(size=n)))]
    df = spark.createDataFrame(rows, "id long, y string, u double, v double, w double").repartition(5)
    fs = FeatureSet(df, ("id", "y"), ("u", "v", "w"))
    return fs.with_df(df.filter("id < 800")), fs.with_df(df.filter("id >= 800"))


def accuracy(model, test):
    best = ensembles.most_probable(model.predict_proba_long(test, ["id", "y"]), ["id", "y"])
    return best.agg(F.avg((F.col("predicted") == F.col("y")).cast("double"))).first()[0]


def test_ensembles_learn_rings_like_the_forest(moons):
    train, test = moons
    forest = models.Classifier(train, "y", num_trees=30, max_depth=10).score(test)
    extra = ensembles.extra_trees(train, "y", ["id"], trees=30, max_depth=12)
    bags = ensembles.bagged_trees(train, "y", ["id"], trees=15, max_depth=10)
    a, b = accuracy(extra, test), accuracy(bags, test)
    assert a > forest - 0.04 and b > forest - 0.04 and min(a, b) > 0.9
    vote = ensembles.soft_vote([m.predict_proba_long(test, ["id", "y"]) for m in (extra, bags)], ["id", "y"])
    best = ensembles.most_probable(vote, ["id", "y"])
    assert best.agg(F.avg((F.col("predicted") == F.col("y")).cast("double"))).first()[0] > min(a, b) - 0.02
    p = vote.groupBy("id").agg(F.sum("probability").alias("s"))
    assert p.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_a_small_tree_by_hand(spark):
    # One feature, 0 0 1 1 against a a b b: every threshold inside (0, 1) parts the classes at the root.
    df = spark.createDataFrame([(1, "a", 0.0), (2, "a", 0.0), (3, "b", 1.0), (4, "b", 1.0)], "id long, y string, x double")
    model = ensembles.extra_trees(FeatureSet(df, ("id", "y"), ("x",)), "y", ["id"], trees=3, max_depth=5, seed=4)
    for tree in model.trees:
        assert tree.feature == [0, -1, -1] and 0 <= tree.threshold[0] < 1 and tree.left[0] == 1
        assert [c.tolist() for c in tree.counts] == [[2, 2], [2, 0], [0, 2]]
    got = {(r.id, r["class"]): r.probability for r in model.predict_proba_long(df, ["id"]).collect()}
    assert got == {(i, c): float((i < 3) == (c == "a")) for i in (1, 2, 3, 4) for c in "ab"}


def test_trees_do_not_depend_on_the_partitions(moons):
    train, _ = moons
    one = ensembles.bagged_trees(train.with_df(train.df.coalesce(1)), "y", ["id"], trees=4, max_depth=6)
    many = ensembles.bagged_trees(train.with_df(train.df.repartition(9)), "y", ["id"], trees=4, max_depth=6)
    for a, b in zip(one.trees, many.trees):
        assert a.feature == b.feature and np.allclose(a.threshold, b.threshold) and a.left == b.left


def test_ensembles_of_one_class_and_constant_features(spark):
    df = spark.createDataFrame([(i, "a", 1.0) for i in range(6)] + [(9, None, 2.0)], "id long, y string, x double")
    fs = FeatureSet(df, ("id", "y"), ("x",))
    got = ensembles.extra_trees(fs, "y", ["id"], trees=2).predict_proba_long(df, ["id"]).collect()
    assert len(got) == 7 and all(r["class"] == "a" and r.probability == 1.0 for r in got)


def test_soft_vote_weights_and_ties(spark):
    a = spark.createDataFrame([(1, "x", 0.5), (1, "y", 0.5), (2, "x", 1.0)], "id int, class string, probability double")
    b = spark.createDataFrame([(1, "y", 0.5), (1, "x", 0.5), (2, "y", 1.0)], "id int, class string, probability double")
    got = {(r.id, r["class"]): r.probability for r in ensembles.soft_vote([a, b], ["id"], [1, 3]).collect()}
    assert got == {(1, "x"): 0.5, (1, "y"): 0.5, (2, "x"): 0.25, (2, "y"): 0.75}
    assert {r.id: r.predicted for r in ensembles.most_probable(ensembles.soft_vote([a, b], ["id"], [1, 3]), ["id"]).collect()} \
        == {1: "x", 2: "y"}


# ---------------------------------------------------------------- permutation importance
@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_keyed_permutation_is_one(n):
    seen = [importance.keyed_permutation(np.arange(n), n, 3, key) for key in range(4)]
    assert all(sorted(x.tolist()) == list(range(n)) for x in seen)
    if n >= 1000:
        assert all((x != np.arange(n)).mean() > 0.98 for x in seen) and (seen[0] != seen[1]).mean() > 0.98
        assert abs(np.corrcoef(np.arange(n), seen[0])[0, 1]) < 0.08


def test_permuted_rows_keep_every_value_and_shuffle_once(spark):
    rows = [(i, "ab"[i % 2], *[float(100 * f + i) for f in range(64)]) for i in range(300)]
    names = [f"f{k}" for k in range(64)]
    df = spark.createDataFrame(rows, "id long, y string, " + ", ".join(f"{c} double" for c in names))
    out = importance.permuted_rows(FeatureSet(df, ("id", "y"), tuple(names)), "y", ["id"])
    got = out.collect()
    assert sorted(r.row for r in got) == list(range(300))
    for f in (0, 31, 63):
        assert sorted(r.d[f].v for r in got) == [100.0 * f + i for i in range(300)]
    assert all(r.x == [100.0 * f + r.row for f in range(64)] and r.y == "ab"[r.row % 2] for r in got)
    assert sum(r.d[5].v != r.x[5] for r in got) > 280
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    assert plan.count("hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_permutation_importance_finds_what_matters(moons):
    train, test = moons
    clf = models.Classifier(train, "y", num_trees=20, max_depth=8)
    got = {r.feature: r.importance for r in importance.permutation_importance(clf, test, "y", ["id"]).collect()}
    assert got["u"] > 0.1 and got["v"] > 0.1 and abs(got["w"]) < 0.06


# ---------------------------------------------------------------- RANSAC
def test_ransac_finds_planted_inliers(spark):
    rng = np.random.default_rng(1)
    n = 2000
    a, b = rng.normal(size=n), rng.normal(size=n)
    good = rng.random(n) < 0.7
    y = np.where(good, 3 + 2 * a - b + rng.normal(0, 0.05, n), rng.uniform(-40, 40, n))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(a, b, y))], "id long, a double, b double, y double")
    fs = FeatureSet(df.repartition(4), ("id",), ("a", "b"))
    rows, coef = ransac.ransac_inliers(fs, "y", ["id"], candidates=100, threshold=0.3, batch=10)
    got = {r.id for r in rows.collect()}
    assert coef["trials"] < 100 and len(got) == coef["inliers"]
    # the same count in SQL for the chosen line, which is that of one clean subset
    df.createOrReplaceTempView("planted")
    c, ka, kb = coef["line"]
    assert spark.sql(f"select count(*) from planted where abs(y - ({ka!r}D * a + {kb!r}D * b + {c!r}D)) <= 0.3").first()[0] == len(got)
    near = {i for i in range(n) if abs(y[i] - (3 + 2 * a[i] - b[i])) < 0.02}
    assert len(near & got) > 0.95 * len(near)
    assert abs(coef["a"] - 2) < 0.05 and abs(coef["b"] + 1) < 0.05 and abs(coef["intercept"] - 3) < 0.05


def test_ransac_trials_and_degenerate_rows(spark):
    assert ransac.trials_needed(1.0, 3, 0.99) == 1 and ransac.trials_needed(0.0, 3, 0.99) == float("inf")
    assert 34 < ransac.trials_needed(0.5, 3, 0.99) < 35
    flat = spark.createDataFrame([(i, 1.0, float(i)) for i in range(50)], "id long, x double, y double")
    with pytest.raises(ValueError):
        ransac.ransac_inliers(FeatureSet(flat, ("id",), ("x",)), "y", ["id"], threshold=1.0)


# ---------------------------------------------------------------- codes, elimination
def test_codes_in_order_of_appearance(spark):
    labels = ["m", "c", None, "m", "z", "a", "c", "é"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "i int, label string").repartition(3)
    got = {r.i: r.label_code for r in ranking.label_codes(df, "label", order=["i"]).collect()}
    seen = list(dict.fromkeys(v for v in labels if v is not None))
    assert got == {i: None if v is None else seen.index(v) for i, v in enumerate(labels)}
    by_name = {r.i: r.label_code for r in ranking.label_codes(df, "label").collect()}
    assert by_name == {i: None if v is None else sorted(seen).index(v) for i, v in enumerate(labels)}


def test_codes_of_as_many_labels_as_rows(spark):
    df = spark.range(200_000).select(F.concat(F.lit("l"), F.reverse(F.col("id").cast("string"))).alias("label"), "id")
    out = ranking.label_codes(df, "label", order=["id"])
    assert out.filter("label_code <> id").count() == 0 and out.count() == 200_000


def test_elimination_drops_planted_noise_first(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[i % 2], float(rng.normal(3 * (i % 2))), float(rng.normal(2 * (i % 2))), float(rng.normal())) for i in range(300)]
    fs = FeatureSet(spark.createDataFrame(rows, "id long, y string, s double, t double, noise double"), ("id", "y"), ("s", "t", "noise"))
    kept, curve = models.elimination_curve(fs, "y", ["id"], folds=3, num_trees=10, max_depth=5)
    got = curve.collect()
    assert len(got) == 9 and {r.dropped for r in got if r.n_features == 3} == {"noise"}
    assert "noise" not in kept and all(0.5 < r.accuracy <= 1 for r in got)


def test_a_row_an_open_node_reaches_the_driver(moons):
    """Not one a candidate: the best split of a node is found where its counts meet."""
    train, _ = moons
    model = ensembles.bagged_trees(train, "y", ["id"], thresholds=8, trees=3, max_depth=2)
    rows = train.df.selectExpr("u f0", "v f1", "w f2", "if(y = 'a', 0, 1) y", "id s")
    for tree in model.trees:
        tree.__init__()
    front = [(t, 0, [(j % 3, j / 10 - 1.0) for j in range(20 + t)], None) for t in range(3)]
    found = model._counts(rows, front, 2, 24, False)
    got = rows.collect()
    x, y = np.array([r[:3] for r in got]), np.array([r.y for r in got])
    assert sorted(found) == [(0, 0), (1, 0), (2, 0)]
    for t, _, candidates, _ in front:
        sides = [np.array([np.bincount(y[(x[:, f] > at) == side], minlength=2) for side in (False, True)]) for f, at in candidates]
        gains = [sum((s ** 2).sum() / s.sum() for s in both) if both.sum(axis=1).all() else 0 for both in sides]
        j, _, counts = found[t, 0]
        assert j == int(np.argmax(gains)) and counts.tolist() == sides[j].tolist()
    ends = model._ranges(rows, [(0, 0, [2, 0])], 2, False)
    assert ends == {(0, 0): ([x[:, 2].min(), x[:, 0].min()], [x[:, 2].max(), x[:, 0].max()])}
