"""Fixes of the round after r03: work done once a row, and tasks of a fit bounded by rows."""

import numpy as np
from pyspark.sql import functions as F

from morphospark.featureset import INDEX_KEYS, FeatureSet
from morphospark.functions.metadata import add_path_metadata
from morphospark.operators import models
from morphospark.operators.distance import row_correlation
from morphospark.operators.rows import drop_null_keys, exclude_pairs
from morphospark.sources import driver_tables


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_row_correlation_pairs_the_arrays_once(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).tolist(), rng.normal(size=6).tolist()) for i in range(20)]
    rows += [(20, [1.0] * 6, rows[0][2]), (21, [None, 1.0, 2.0, 4.0], [5.0, 1.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "i int, x array<double>, y array<double>").select("i", row_correlation(F.col("x"), F.col("y")).alias("r"))
    assert _plan(df).count("zip_with") == 1
    got = {r.i: r.r for r in df.collect()}
    assert all(abs(got[i] - np.corrcoef(x, y)[0, 1]) < 1e-12 for i, x, y in rows[:20])
    assert got[20] is None and abs(got[21] - np.corrcoef([1, 2, 4], [1, 3, 4])[0, 1]) < 1e-12


def test_path_metadata_is_parsed_once(spark):
    paths = ["/data/990101_plate_ISO34_5FU_0_041uM/img_Position_2.tif", "/data/990101_plate_ISO49_5FU_0_00uM/img.tif",
             "/data/990101_plate_ISO49_Vemurafenib_0_10uM/img.tif"]
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(paths)],
                               "ImageNumber long, ObjectNumber long, Metadata_FileLocation string")
    out = exclude_pairs(drop_null_keys(add_path_metadata(df), INDEX_KEYS), [("5FU", "ISO34")])
    assert _plan(out).count("translate(") == 1
    assert sorted(tuple(r) for r in out.select("ObjectNumber", "Date", "Drug", "Cell", "Replicate", "`Conc /uM`").collect()) == [
        (1, "990101", "Control", "ISO49", "1", 0.0), (2, "990101", "Vemurafenib", "ISO49", "1", 0.1)]


def test_file_location_looks_its_dose_up(spark):
    df = spark.range(-25, 26).select(F.col("id").alias("o_custkey"), F.lit(5).alias("l_orderkey"), F.lit("F").alias("o_orderstatus"),
                                     F.lit("2-HIGH").alias("o_orderpriority"), F.lit("2024-02-03").cast("timestamp").alias("o_orderdate"))
    df = df.unionByName(df.limit(1).withColumn("o_custkey", F.lit(None).cast("long")))
    dose = F.translate(F.format_string("%.2f", F.col("o_custkey") % 11 / 100), ".", "_")
    made = df.select(driver_tables.file_location().alias("p"), F.concat(F.lit("/data/240203_plate_ISO34_5FU_"), dose, F.lit(
        "uM/img_Position_1.tif")).alias("want"))
    assert "format_string" not in _plan(df.select(driver_tables.file_location()))
    assert made.filter("p <=> want").count() == made.count() == 52


def test_tasks_of_a_fit_are_bounded_by_rows(spark, monkeypatch):
    df = spark.range(0, 4000, 1, 2).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("string").alias("y"))
    monkeypatch.setattr(models, "FIT_ROWS", 100)
    parts = models.dealt(df).rdd.glom().map(len).collect()
    assert sum(parts) == 4000 and len(parts) == 40 and max(parts) <= 110
    assert models.Classifier(FeatureSet(df, (), ("x",)), "y", num_trees=2, max_depth=2).classes == ["0", "1"]
