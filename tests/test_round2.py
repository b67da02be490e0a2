"""Medians before null drops, letter-value depth, value-bound bins, widening lambda scans."""

import numpy as np

from morphospark.featureset import FeatureSet
from morphospark.operators import models, plotdata, scale
from morphospark.plans.curate import curate_objects, curate_with_medians, median_per_organoid
from morphospark.sources import driver_tables as D
from pyspark.sql import functions as F

SF001 = "/root/testdata/sf0.001"


def test_groups_hold_several_objects_and_medians_keep_features_with_some_nulls(spark):
    first = D.objects(spark, SF001).agg(F.min("ImageNumber")).first()[0]
    objects = D.objects(spark, SF001).withColumn(
        "l_tax", F.when((F.col("ImageNumber") > first) & (F.col("ObjectNumber") == 1)
                        & (F.col("l_linenumber") > 0) & F.col("l_tax").isNotNull()
                        & (F.col("ImageNumber") % 50 == 0) & (F.col("p_size") < 0), None)
        .when((F.col("ObjectNumber") == 2), None).otherwise(F.col("l_tax")))
    cells, medians = curate_with_medians(objects, D.images(spark, SF001), drop_list=D.DROP_LIST)
    assert "l_tax" not in cells.features
    assert medians.df.count() < cells.df.count()
    lone = objects.groupBy("ImageNumber").agg(F.count("l_tax").alias("n")).filter("n = 0").count()
    assert ("l_tax" in medians.features) == (lone == 0)
    raw = curate_objects(objects, D.images(spark, SF001), drop_list=D.DROP_LIST, drop_nulls=False)
    assert set(median_per_organoid(raw).features) == set(medians.features)


def test_letter_value_depth_follows_n(spark):
    df = spark.range(5000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    got = plotdata.letter_values(df, "g", "v")
    assert got.agg(F.max("depth")).first()[0] == 9
    assert got.count() == 18


def test_mutual_information_of_nothing_is_zero(spark):
    df = spark.range(2000).select(F.lit(1.0).alias("same"), (F.col("id") % 2).cast("double").alias("free"),
                                  (F.col("id") % 4 >= 2).cast("string").alias("y"))
    got = {r.feature: r.mutual_info for r in models.mutual_information_binned(
        FeatureSet(df, ("y",), ("same", "free")), "y").collect()}
    assert abs(got["same"]) < 1e-9 and abs(got["free"]) < 1e-9


def test_lambda_scan_moves_beyond_its_grid(spark):
    rng = np.random.default_rng(0)
    rows = [(float(x),) for x in (100 + 20 * rng.standard_normal(800)) ** 0.1 - 1]  # normal at lambda 10
    fs = FeatureSet(spark.createDataFrame(rows, "x double"), (), ("x",))
    lam = scale.fit_yeo_johnson(fs)["x"]
    assert 8 < lam < 12
