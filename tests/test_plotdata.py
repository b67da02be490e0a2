"""Bootstrap sketches and binned densities against the plain sums over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphospark.operators import plotdata


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = [(i, str(rng.choice(["a", "b", None])) if rng.random() < 0.9 else "hot", int(rng.integers(3)),
            float(rng.gamma(2, 3)) if rng.random() < 0.97 else None) for i in range(4000)]
    return spark.createDataFrame(out, "id long, g string, k int, x double").repartition(6), out


def test_bootstrap_equals_the_weighted_means(spark, rows):
    import hashlib

    df, plain = rows
    got = {(r.g, r.k): r for r in plotdata.bootstrap_mean_ci(df, ["g", "k"], "x", ["id"], replicates=200).collect()}
    for g, k in {(r[1], r[2]) for r in plain}:
        own = [(r[0], r[3]) for r in plain if (r[1], r[2]) == (g, k) and r[3] is not None]
        seeds = [int(hashlib.md5(f"{i}|boot0".encode()).hexdigest()[:8], 16) for i, _ in own]
        w, x = plotdata.poisson1_weights(seeds, 200), np.array([x for _, x in own])
        lo, hi = np.quantile((w * x[:, None]).sum(0) / w.sum(0), [0.025, 0.975])
        r = got[g, k]
        assert r.n == len(own) and abs(r["mean"] - x.mean()) < 1e-9
        assert abs(r.ci_low - lo) < 1e-9 and abs(r.ci_high - hi) < 1e-9


def test_bootstrap_weights_are_poisson():
    w = plotdata.poisson1_weights(np.random.default_rng(0).integers(0, 2**32, 2000), 500)
    share = np.bincount(w.ravel(), minlength=6)[:6] / w.size
    assert np.allclose(share, [math.exp(-1) / math.factorial(k) for k in range(6)], atol=2e-3)
    means = w.mean(axis=0)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.08 and abs(means.std() - 1 / math.sqrt(2000)) < 0.004


def test_bootstrap_neither_multiplies_nor_moves_rows(spark, rows):
    df, _ = rows
    plan = plotdata.bootstrap_mean_ci(df, "g", "x", ["id"])._jdf.queryExecution().toString()
    assert "explode" not in plan.lower() and "Generate" not in plan


def test_bootstrap_of_nothing_and_of_one(spark):
    empty = spark.createDataFrame([], "id long, g string, x double")
    assert plotdata.bootstrap_mean_ci(empty, "g", "x", ["id"]).count() == 0
    one = spark.createDataFrame([(1, "a", 2.0), (2, "b", None)], "id long, g string, x double")
    got = {r.g: (r["mean"], r.n, r.ci_low, r.ci_high) for r in plotdata.bootstrap_mean_ci(one, "g", "x", ["id"]).collect()}
    assert got == {"a": (2.0, 1, 2.0, 2.0), "b": (None, 0, None, None)}


def test_density_equals_the_sum_over_all_rows(spark, rows):
    df, plain = rows
    got = plotdata.kde_grid(df.filter("g is not null"), ["g"], "x").toPandas()
    for g in {r[1] for r in plain if r[1]}:
        x = np.array([r[3] for r in plain if r[1] == g and r[3] is not None])
        h = x.std(ddof=1) * len(x) ** -0.2
        own = got[got.g == g].sort_values("i")
        at = np.linspace(x.min() - 2 * h, x.max() + 2 * h, 100)
        want = np.exp(-((at[:, None] - x) / h) ** 2 / 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
        assert len(own) == 100 and np.allclose(own.x, at) and np.abs(own.density - want).max() < 1e-11 / h


def test_density_far_from_the_data_is_zero_and_bins_stay_few(spark):
    n = 30_000
    df = spark.range(n).select(F.lit("a").alias("g"), F.when(F.col("id") == 0, 1e4).otherwise(F.randn(3)).alias("x"))
    got = plotdata.kde_grid(df, "g", "x").toPandas().sort_values("i")
    assert len(got) == 100 and (got.density >= 0).all() and got.density.iloc[50] < 1e-200


def test_density_of_a_constant_group_is_left_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 2.0), ("c", None)], "g string, x double")
    assert {r.g for r in plotdata.kde_grid(df, "g", "x").collect()} == {"b"}
