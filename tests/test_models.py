import numpy as np
from pyspark.sql import functions as F

from morphospark.featureset import FeatureSet
from morphospark.operators import models as M


def _sk_folds(y, k=5):
    """Reference rule of unshuffled stratified folds, written out in numpy."""
    _, idx, inv = np.unique(y, return_index=True, return_inverse=True)
    _, perm = np.unique(idx, return_inverse=True)
    enc = perm[inv]
    order = np.sort(enc)
    alloc = np.asarray([np.bincount(order[i::k], minlength=len(idx)) for i in range(k)])
    out = np.empty(len(y), dtype=int)
    for c in range(len(idx)):
        out[enc == c] = np.arange(k).repeat(alloc[:, c])
    return out


def test_stratified_folds_match_rule(spark):
    rng = np.random.default_rng(1)
    y = rng.choice(["b", "a", "c"], size=53, p=[0.5, 0.3, 0.2])
    df = spark.createDataFrame([(i, str(v)) for i, v in enumerate(y)], "id long, y string")
    got = {r.id: r.fold for r in M.stratified_folds(df, "y", ["id"]).collect()}
    want = _sk_folds(y)
    assert [got[i] for i in range(len(y))] == list(want)


def test_separable_classification(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "A" if i % 2 else "B", float(rng.normal(5 if i % 2 else -5, 1)), float(rng.normal()))
            for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y string, a double, b double")
    fs = FeatureSet(df, ("id", "y"), ("a", "b"))
    clf = M.Classifier(fs, "y", num_trees=20, max_depth=5)
    assert clf.score(fs) >= 0.95
    proba = clf.predict_proba_long(fs, keep=["id"]).groupBy("id").agg(F.sum("probability").alias("s"))
    assert proba.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    cv = M.cross_val_accuracy(fs, "y", ["id"], k=5, num_trees=10, max_depth=4)
    assert cv["mean"] >= 0.95


def test_pca_centred_and_signed(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(300, 3)) @ np.array([[3, 0, 0], [1, 1, 0], [0, 0, 0.1]]) + 10
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], "id long, a double, b double, c double")
    out, ratio = M.pca(FeatureSet(df, ("id",), ("a", "b", "c")), k=2)
    pdf = out.df.toPandas()
    assert abs(pdf["PC1"].mean()) < 1e-9 and ratio[0] > ratio[1]
    Xc = X - X.mean(axis=0)
    _, _, vt = np.linalg.svd(Xc, full_matrices=False)
    v = vt[0] * np.sign(vt[0][np.abs(vt[0]).argmax()])
    assert np.allclose(pdf.sort_values("id")["PC1"].to_numpy(), Xc @ v, atol=1e-8)


def test_anova_matches_numpy(spark):
    rng = np.random.default_rng(4)
    y = rng.choice(["a", "b", "c"], 200)
    x = rng.normal(size=200) + (y == "a") * 1.5
    df = spark.createDataFrame([(str(a), float(b)) for a, b in zip(y, x)], "y string, x double")
    got = M.anova_f(FeatureSet(df, ("y",), ("x",)), "y").first().F
    groups = [x[y == g] for g in ("a", "b", "c")]
    mu = x.mean()
    ssb = sum(len(g) * (g.mean() - mu) ** 2 for g in groups) / 2
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups) / (200 - 3)
    assert abs(got - ssb / ssw) < 1e-9
