"""The SQL builders behind the model oracles against numpy and known values; folds and label grids by hand."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from morphospark.operators import models as M
from morphospark.operators import report as RP
from morphospark.plans import oracle_algebra as OA


@pytest.fixture()
def table():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(400, 3)) @ np.array([[2.0, 0.4, 0.1], [0.0, 1.5, 0.3], [0.0, 0.0, 0.2]])
    y = a @ np.array([1.5, -2.0, 0.25]) + rng.normal(size=400)
    con = duckdb.connect()
    con.execute("CREATE TABLE src (a DOUBLE, b DOUBLE, c DOUBLE, y DOUBLE)")
    con.executemany("INSERT INTO src VALUES (?, ?, ?, ?)", np.column_stack([a, y]).tolist())
    return con, a, y


def test_least_squares_by_elimination(table):
    con, a, y = table
    got = dict(con.execute("WITH " + OA.solve_ctes("src", ["a", "b", "c"], "y") + " SELECT * FROM ls").fetchall())
    want = np.linalg.lstsq(a, y, rcond=None)[0]
    assert np.allclose([got[c] for c in "abc"], want, atol=1e-9)


def test_components_by_squaring(table):
    con, a, _ = table
    sql = "WITH " + OA.component_ctes("src", ["a", "b", "c"], "pc") + " SELECT pc1.*, pc2.* FROM pc1, pc2"
    got = np.array(con.execute(sql).fetchone()).reshape(2, 3)
    _, vectors = np.linalg.eigh(np.cov(a.T))
    for row, v in zip(got, [vectors[:, 2], vectors[:, 1]]):
        v = v * np.sign(v[np.abs(v).argmax()])
        assert np.allclose(row, v, atol=1e-9)


def test_t_tail_by_quadrature():
    con = duckdb.connect()
    con.execute("CREATE TABLE fit AS SELECT * FROM (VALUES (1, 12, 0.5760), (2, 3, 0.0), (3, 5000, 0.02)) v(k, n, R)")
    got = dict(con.execute("WITH " + OA.t_tail_ctes("fit", "k") + " SELECT * FROM tails").fetchall())
    assert got[2] == pytest.approx(1.0, abs=1e-9)
    assert got[1] == pytest.approx(0.05, abs=1e-4)  # the tabled 5 % point of r at 10 degrees of freedom
    t, df = 0.02 * math.sqrt(4998 / (1 - 0.02 ** 2)), 4998  # the normal tail and the first term beyond it
    density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    assert got[3] == pytest.approx(math.erfc(t / math.sqrt(2)) + density * (t ** 3 + t) / (2 * df), abs=1e-7)


def test_likelihood_peak_of_logarithms():
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT 'x' AS feature, exp(sqrt(-2 * ln((i + 0.5) / 2000)) * cos(6.283185307 * "
                "((i * 0.6180339887) % 1))) - 1 + 1e-9 AS _v FROM range(2000) r(i)")
    con.execute("CREATE TABLE p AS SELECT feature, _v FROM t WHERE _v > -0.99")
    lam = con.execute("WITH " + OA.likelihood_peak_ctes("p") + " SELECT lam FROM peak").fetchone()[0]
    assert abs(lam) < 0.05  # 1 + x is lognormal


def test_folds_by_hand(spark):
    # b comes first, so it holds positions 0..3 and a 4..8, of folds 0 1 2 0 | 1 2 0 1 2
    rows = [(i, "b" if i in (0, 2, 4, 6) else "a") for i in range(9)] + [(99, None)]
    out = {r.i: r.fold for r in M.stratified_folds(spark.createDataFrame(rows, "i long, y string"), "y", ["i"], 3).collect()}
    assert out == {0: 0, 2: 0, 4: 1, 6: 2, 1: 0, 3: 1, 5: 1, 7: 2, 8: 2}


def test_folds_of_many_classes(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("c"), (F.col("id") % 1500).cast("string")).alias("y"))
    out = M.stratified_folds(df, "y", ["id"], 5)
    assert out.count() == 3000
    assert {r["count"] for r in out.groupBy("fold").count().collect()} == {600}


def test_label_grid(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "b"), ("c", "a"), (None, "a"), ("a", None)], "t string, p string")
    dense = {(r.t, r.p): r["count"] for r in RP.confusion_counts(df, "t", "p").collect()}
    assert len(dense) == 9 and dense[("a", "b")] == 2 and dense[("c", "a")] == 1 and dense[("b", "b")] == 0
    sparse = {(r.t, r.p): r["count"] for r in RP.confusion_counts(df, "t", "p", dense=False).collect()}
    assert sparse == {("a", "a"): 1, ("a", "b"): 2, ("c", "a"): 1}
    assert RP.confusion_counts(df, "t", "p", classes=["a", "z"]).count() == 4
    assert RP.confusion_counts(df.limit(0), "t", "p").count() == 0


def test_broadcast_is_checked_by_bytes(spark):
    from morphospark.operators.joins import row_bytes, sized_broadcast

    wide = spark.range(1000).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array_repeat(F.lit(1.0), 50).alias("v"))
    got = wide.agg(F.avg(row_bytes(wide)).alias("w")).first().w
    assert 1400 < got < 1600
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(sized_broadcast(wide)) and not hinted(sized_broadcast(wide, max_bytes=1_000_000))
    assert not hinted(sized_broadcast(wide, max_rows=999)) and hinted(sized_broadcast(wide.limit(0)))


def test_nearest_centroid_both_ways(spark, monkeypatch):
    from morphospark.operators import distance as DIST

    rows = [(1, "a", [0.0, 0.0]), (2, "a", [0.0, 2.0]), (3, "b", [9.0, 9.0]), (4, "b", [0.0, 1.0]), (5, "c", None)]
    df = spark.createDataFrame(rows, "i long, y string, v array<double>")
    # centroids: a (0, 1), b (4.5, 5)
    want = {1: ("a", 1.0), 2: ("a", 1.0), 3: ("b", math.hypot(4.5, 4)), 4: ("a", 0.0)}

    def got():
        out = DIST.nearest_centroid(df, "i", "y", "v")
        return {r.i: (r.nearest, pytest.approx(r.distance)) for r in out.collect()}

    assert got() == want
    plan = DIST.nearest_centroid(df, "i", "y", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    monkeypatch.setattr(DIST, "MODEL_NUMBERS", 3)
    assert got() == want
