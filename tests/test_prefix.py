"""Prefix sums over distinct values, and what is built on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphospark.featureset import FeatureSet
from morphospark.operators import prefix
from morphospark.operators.aggregate import group_median
from morphospark.operators.distance import ks_two_sample
from morphospark.operators.models import mutual_information_binned
from morphospark.operators.quantiles import quantiles_by_rank
from morphospark.operators.scale import robust_scale


def plain(rows):
    out = {}
    for key, value, *sums in sorted(rows, key=lambda r: [(x is not None, x) for x in r[:2]]):
        before = out.setdefault(key, [])
        held = before[-1][1] if before else [0] * len(sums)
        before.append(((value, held), [h + s for h, s in zip(held, sums)]))
    return {(k, v): h for k, rows_ in out.items() for (v, h), _ in rows_}


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_prefix_sums(spark, parts):
    rng = np.random.default_rng(0)
    rows = [(k, float(v), int(rng.integers(1, 9)), float(rng.random()))
            for k, n in (("hot", 900), ("a", 1), ("b", 40), (None, 30)) for v in rng.permutation(n)]
    df = spark.createDataFrame(rows, "g string, v double, c long, w double").repartition(5)
    got = {(r.g, r.v): [r.c_before, r.w_before] for r in prefix.prefix_sums(df, ["g"], "v", ["c", "w"], parts).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_prefix_sums_without_keys_nan_keys_and_empty(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(100)], "v double, c long")
    assert sorted(r.c_before for r in prefix.prefix_sums(df, [], "v", ["c"], 7).collect()) == list(range(100))
    nan = spark.createDataFrame([(float("nan"), i, 2) for i in range(50)] + [(1.0, i, 3) for i in range(20)],
                                "g double, v int, c long")
    got = prefix.prefix_sums(nan, ["g"], "v", ["c"], 6).collect()
    assert sorted(r.c_before for r in got if r.g != 1.0) == [2 * i for i in range(50)]
    assert sorted(r.c_before for r in got if r.g == 1.0) == [3 * i for i in range(20)]
    assert prefix.prefix_sums(nan.limit(0), ["g"], "v", ["c"]).count() == 0


def hot_rows(spark, n=20_000):
    """Nine values in ten are the same, in one group that holds nearly all rows."""
    rng = np.random.default_rng(1)
    v = np.where(rng.random(n) < 0.9, 5.0, rng.normal(5, 2, n).round(3))
    g = np.where(rng.random(n) < 0.95, "hot", "cold")
    return spark.createDataFrame([(i, str(a), float(b)) for i, (a, b) in enumerate(zip(g, v))], "id long, g string, v double"), g, v


def test_ties_do_not_share_a_task(spark):
    df, g, v = hot_rows(spark)
    counts = prefix.tall_values(df, ["g"], ["v"]).groupBy("g", "_f", "_v").agg(F.count("*").alias("_n"))
    distinct = counts.count()
    dealt = counts.repartitionByRange(8, "g", "_f", "_v").groupBy(F.spark_partition_id()).count().collect()
    assert distinct < len(v) / 5 and max(r["count"] for r in dealt) < distinct / 4


def test_quantiles_of_tied_values(spark):
    df, g, v = hot_rows(spark)
    probs = [0.0, 0.01, 0.25, 0.5, 0.961, 0.999, 1.0]
    got = {(r.g, r.p): r.value for r in quantiles_by_rank(df, ["g"], ["v"], probs).collect()}
    for name in ("hot", "cold"):
        assert np.allclose([got[name, p] for p in probs], np.quantile(v[g == name], probs), atol=1e-12)
    med = {r.g: r.v for r in group_median(df, ["g"], ["v"], method="rank").collect()}
    assert med == {name: float(np.median(v[g == name])) for name in ("hot", "cold")}


def test_median_of_null_groups_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0, None), (None, 3.0, None), ("a", None, None), ("b", 2.0, 7.0)],
                               "g string, x double, y double")
    got = {r.g: (r.x, r.y) for r in group_median(df, ["g"], ["x", "y"], method="rank").collect()}
    assert got == {None: (2.0, None), "a": (None, None), "b": (2.0, 7.0)}


def test_ks_of_tied_samples(spark):
    df, g, v = hot_rows(spark)
    out = ks_two_sample(FeatureSet(df, ("id", "g"), ("v",)), F.col("g") == "hot", F.col("g") == "cold").first()
    a, b = np.sort(v[g == "hot"]), np.sort(v[g == "cold"])
    at = np.unique(v)
    want = np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max()
    assert (out.n_a, out.n_b) == (len(a), len(b)) and abs(out.ks_statistic - want) < 1e-12


def test_robust_scale_of_a_constant(spark):
    df = spark.createDataFrame([(i, 4.0, float(i)) for i in range(9)], "id long, c double, x double")
    got = robust_scale(FeatureSet(df, ("id",), ("c", "x"))).df.orderBy("id").collect()
    assert [r.c for r in got] == [0.0] * 9 and [r.x for r in got] == [(i - 4) / 4 for i in range(9)]


def test_mutual_information_of_a_copy(spark):
    df = spark.createDataFrame([("xy"[i % 2], float(i % 2), 1.0) for i in range(100)], "l string, same double, flat double")
    got = {r.feature: r.mutual_info for r in mutual_information_binned(FeatureSet(df, ("l",), ("same", "flat")), "l").collect()}
    assert abs(got["same"] - np.log(2)) < 1e-12 and abs(got["flat"]) < 1e-12
