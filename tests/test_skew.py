"""The hot-group paths must agree with the plain window / built-in paths."""

import random

from pyspark.sql import functions as F

from morphospark.operators.aggregate import group_median, row_of_group_max
from morphospark.operators.ranking import global_rank, head_per_group, ordered_split, rank_in_group
from morphospark.operators.skew import split_hot


def _skewed(spark, n=3000):
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 else f"g{i % 17}"
        v = None if i % 97 == 0 else float(rnd.randint(0, 50))
        rows.append((g, i, v, float(rnd.random())))
    return spark.createDataFrame(rows, "g string, id long, v double, w double")


def test_split_hot(spark):
    df = _skewed(spark)
    normal, hot, mode = split_hot(df, ["g"], threshold=500)
    assert mode == "some"
    assert {r.g for r in hot.select("g").distinct().collect()} == {"hot"}
    assert normal.count() + hot.count() == df.count()


def test_global_rank_is_dense_and_ordered(spark):
    df = _skewed(spark)
    r = global_rank(df, ["g", "id"]).select("g", "id", "_grank").collect()
    ranks = sorted(x._grank for x in r)
    assert ranks == list(range(1, len(r) + 1))
    by_rank = [(x.g, x.id) for x in sorted(r, key=lambda x: x._grank)]
    assert by_rank == sorted(by_rank)


def test_rank_in_group_hot_equals_window(spark):
    df = _skewed(spark)
    a = {(r.g, r.id): r._rank for r in rank_in_group(df, ["g"], ["id"], threshold=10**9).collect()}
    b = {(r.g, r.id): r._rank for r in rank_in_group(df, ["g"], ["id"], threshold=100).collect()}
    assert a == b


def test_head_per_group(spark):
    df = _skewed(spark)
    out = head_per_group(df, ["g"], 5, ["id"], threshold=100)
    counts = {r.g: r["count"] for r in out.groupBy("g").count().collect()}
    assert set(counts.values()) == {5}


def test_median_paths_agree(spark):
    df = _skewed(spark)
    a = {r.g: (r.v, r.w) for r in group_median(df, ["g"], ["v", "w"]).collect()}
    b = {r.g: (r.v, r.w) for r in group_median(df, ["g"], ["v", "w"], threshold=100).collect()}
    c = {r.g: (r.v, r.w) for r in group_median(df, ["g"], ["v", "w"], method="rank").collect()}
    assert a.keys() == b.keys() == c.keys()
    for k in a:
        for x, y, z in zip(a[k], b[k], c[k]):
            assert abs(x - y) < 1e-12 and abs(x - z) < 1e-12


def test_median_nan_skipped(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None)], "g string, v double")
    assert group_median(df, ["g"], ["v"]).first().v == 1.5
    assert group_median(df, ["g"], ["v"], method="rank").first().v == 1.5


def test_ordered_split_odd(spark):
    df = spark.range(7).withColumn("k", F.col("id"))
    train, test = ordered_split(df, ["k"])
    assert [r.k for r in train.orderBy("k").collect()] == [0, 1, 2]
    assert test.count() == 4


def test_row_of_group_max_tie(spark):
    df = spark.createDataFrame([(1, 2, 5.0), (1, 1, 5.0), (1, 3, 4.0), (2, 1, None), (2, 2, 1.0)],
                               "ImageNumber long, ObjectNumber long, AreaShape_Area double")
    out = {r.ImageNumber: r.ObjectNumber for r in
           row_of_group_max(df, "ImageNumber", "AreaShape_Area", "ObjectNumber").collect()}
    assert out == {1: 1, 2: 2}


def test_sampled_detection_finds_planted_hot_group(spark):
    from morphospark.operators.skew import find_hot_groups

    big = spark.range(30000).select(F.lit("hot").alias("g"))
    small = spark.range(3000).select((F.col("id") % 30).cast("string").alias("g"))
    mode, hot = find_hot_groups(big.unionByName(small), ["g"], threshold=10000)  # sample rate 0.04
    assert mode == "some" and [r.g for r in hot.collect()] == ["hot"]


def test_flagship_equal_under_forced_hot_paths(spark):
    from morphospark.plans.curate import curate_with_medians
    from morphospark.plans.dose_response import dose_response
    from morphospark.sources import driver_tables as D

    sf = "/root/testdata/sf0.001"

    def run(threshold):
        _, med = curate_with_medians(D.objects(spark, sf, threshold=threshold), D.images(spark, sf),
                                     drop_list=D.DROP_LIST, threshold=threshold,
                                     image_keys=D.image_keys(spark, sf))
        rows = med.select().collect()
        line = dose_response(med).select("Drug", "Cell", "n", "m", "c", "R").collect()
        return rows, line

    med_a, line_a = run(10**9)
    med_b, line_b = run(3)  # every image with more than 3 objects takes the rank paths
    key = lambda r: tuple(str(v) for v in r)
    assert len(med_a) == len(med_b)
    for a, b in zip(sorted(med_a, key=key), sorted(med_b, key=key)):
        assert a[:6] == b[:6]
        assert all(abs(x - y) < 1e-9 for x, y in zip(a[6:], b[6:]))
    la = {(r.Drug, r.Cell): r for r in line_a}
    for r in line_b:
        o = la[(r.Drug, r.Cell)]
        assert r.n == o.n and (r.m is None) == (o.m is None)
        if r.m is not None:
            assert abs(r.m - o.m) < 1e-6 * max(1, abs(o.m)) and abs(r.R - o.R) < 1e-9
