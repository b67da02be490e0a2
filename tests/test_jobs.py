"""E3 whole, metrics gathered while writing, CSV files with different headers, concurrent studies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphospark.featureset import ORGANOID_KEYS, FeatureSet
from morphospark.plans import catalog, jobs
from morphospark.plans.classification import classification_study
from morphospark.plans.dose_response import control_weights, prepared_dose_response, profiles, scaled_objects
from morphospark.sources.readers import headers, read_csv, read_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cells(spark):
    return catalog.cells(spark, SF)


def test_largest_unit_does_not_decide_the_distance(spark, cells):
    """With scaled features a change of units changes nothing; raw medians follow the largest unit."""
    lam = {c: 1.0 for c in cells.features}
    one = {(r.Drug, r.Cell): r.m for r in prepared_dose_response(cells, isolate=False, lambdas=lam).collect()}
    big = FeatureSet(cells.df.withColumn("l_tax", F.col("l_tax") * 1e6), cells.keys, cells.features)
    two = {(r.Drug, r.Cell): r.m for r in prepared_dose_response(big, isolate=False, lambdas=lam).collect()}
    assert one.keys() == two.keys() and all(
        (one[k] is None and two[k] is None) or abs(one[k] - two[k]) < 1e-8 for k in one)


def test_every_feature_source(spark, cells):
    scaled = scaled_objects(cells, seed=1)
    assert 0 < scaled.df.count() < cells.df.count()  # outliers are gone
    mean = scaled.df.agg(*[F.avg(c) for c in scaled.features]).first()
    assert all(abs(m) < 1e-6 for m in mean)
    raw = profiles(scaled, "scaled")[1]
    name, weighted = profiles(scaled, "weighted")
    weights = control_weights(scaled)
    assert name == "weighted" and set(weights) == set(scaled.features)
    j = raw.df.alias("a").join(weighted.df.alias("b"), list(ORGANOID_KEYS))
    for c in ("l_quantity", "p_size"):  # medians of weighted values are weighted medians
        assert j.filter(F.abs(F.col(f"a.{c}") * weights[c] - F.col(f"b.{c}")) > 1e-9).count() == 0
    name, selected = profiles(scaled, "selected", num_trees=10, max_depth=4)
    assert name == "selected" and 0 < len(selected.features) <= len(scaled.features)
    assert selected.df.count() == raw.df.count()
    assert profiles(scaled, None, num_trees=5, max_depth=3)[0] == "selected"
    alone = scaled.with_df(scaled.df.filter("Drug <> 'Control'").withColumn("Drug", F.lit("one")))
    assert profiles(alone, None)[0] == "scaled"  # neither control rows nor two labels


def test_job_writes_metrics(spark, tmp_path):
    from morphospark.operators import aggregate as A
    from morphospark.sources import driver_tables as D

    D.objects(spark, SF).write.parquet(f"{tmp_path}/objects")
    D.images(spark, SF).write.parquet(f"{tmp_path}/images")
    jobs.run(spark, f"{tmp_path}/objects", f"{tmp_path}/images", None, f"{tmp_path}/out", features="scaled")
    got = {r.metric: r.value for r in spark.read.parquet(f"{tmp_path}/out/metrics").collect()}
    for name in ("cells", "organoids"):
        table = spark.read.parquet(f"{tmp_path}/out/{name}")
        first = [c for c in table.columns if c not in ("ImageNumber", "ObjectNumber", *ORGANOID_KEYS)][0]
        assert got[f"{name}.rows"] == table.count()
        assert got[f"{name}.objects"] == A.object_total(table, first).first()[0]
    ec50 = spark.read.parquet(f"{tmp_path}/out/ec50").collect()
    assert ec50 and all(r.pvalue is None or 0 <= r.pvalue <= 1 for r in ec50)
    assert spark.read.parquet(f"{tmp_path}/out/euclid").count() <= got["organoids.rows"]


# ---------------------------------------------------------------- CSV headers
def test_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ImageNumber,ObjectNumber,x,note\n1,1,1.5,ok\n1,2,NaN,\n")
    (tmp_path / "b.csv").write_text('note,x,ObjectNumber,ImageNumber\n"q, r",2.5,1,2\n')
    (tmp_path / "c.csv").write_text('"ObjectNumber","ImageNumber","x","extra, one"\n1,3,4,7\n')
    (tmp_path / "d.csv").write_text("ImageNumber,ObjectNumber,x,note\n4,1,5,no\n")
    found = headers(spark, str(tmp_path))
    assert sorted(len(v) for v in found.values()) == [1, 1, 2]
    df = read_table(spark, str(tmp_path))
    assert set(df.columns) == {"ImageNumber", "ObjectNumber", "x", "note", "extra, one"}
    got = {(r.ImageNumber, r.ObjectNumber): (r.x, r.note, r["extra, one"]) for r in df.collect()}
    assert got == {(1, 1): (1.5, "ok", None), (1, 2): (None, None, None), (2, 1): (2.5, "q, r", None),
                   (3, 1): (4.0, None, 7.0), (4, 1): (5.0, "no", None)}


def test_header_of_a_large_file_is_its_first_line(spark, tmp_path):
    body = "\n".join(f"{i},{i % 7},{i / 3}" for i in range(200_000))
    (tmp_path / "big.csv").write_text(f"ImageNumber,ObjectNumber,x\n{body}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 * 1024))
    try:
        assert list(headers(spark, str(tmp_path))) == [("ImageNumber", "ObjectNumber", "x")]
        assert read_csv(spark, str(tmp_path)).count() == 200_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# ---------------------------------------------------------------- study
def test_study_covers_the_same_one_by_one_and_at_once(spark):
    rng = np.random.default_rng(5)
    rows = [(f"d{i % 4}", "ab"[i % 2], f"c{i % 3}", str(i), float(i % 5), i, float(rng.normal(3 * (i % 2))), float(rng.normal()))
            for i in range(360)]
    kinds = "Date string, Drug string, Cell string, Replicate string, `Conc /uM` double, ImageNumber long, u double, v double"
    fs = FeatureSet(spark.createDataFrame(rows, kinds), ORGANOID_KEYS, ("u", "v"))
    tables = []
    for parallel in (1, 4):
        rep, scores = classification_study(fs, None, variables=["Drug", "Date"], cv=2, parallel=parallel, num_trees=5, max_depth=4)
        tables.append((rep.collect(), sorted(map(tuple, scores.collect()))))
    # The forest draws its bags by partition, so two runs differ in a few predictions, but not in what they cover.
    keys = [sorted((r["Cell type"], r["Population type"], r.Variable, r.Metric, r.label) for r in rep) for rep, _ in tables]
    assert keys[0] == keys[1] and len(set(keys[0])) == len(keys[0])
    scores, other = tables[0][1], tables[1][1]
    assert [s[:4] for s in scores] == [s[:4] for s in other]
    assert np.abs(np.array([s[4] for s in scores]) - [s[4] for s in other]).max() < 0.25
    assert {s[0] for s in scores} == {"c0", "c1", "c2"} and len(scores) == 3 * 2 * 2 * 3
    assert all(s[4] > 0.75 for s in scores if s[1] == "Drug" and s[3] == "holdout")
