"""Binding of the driver's TPC-H-like tables onto the profiling schema.

The reference reads per-object (Secondary), per-parent (Primary) and
per-image (Image) exports.  The test tables stand in for them:

* objects   <- lineitem (+ part features), ImageNumber = l_orderkey,
               ObjectNumber = row number within the order by all columns
* images    <- orders, ImageNumber = o_orderkey
* organoids <- lineitem aggregated per (l_orderkey, l_linenumber)

The file path that carries the experiment metadata is built from the row so
that the path parser (F1-F6) runs end to end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphospark.operators.ranking import rank_in_group
from morphospark.sources.readers import read_parquet

# Fixed values of the binding (mirrored in the SQL oracle).
# An image (order) has one drug, cell line, dose, date and position; its lines are the objects in it.
DRUG_BY_PRIORITY = {"1-URGENT": "Dabrafenib", "2-HIGH": "5FU", "3-MEDIUM": "Vemurafenib",
                    "4-NOT SPECIFIED": "Dabrafenib", "5-LOW": "5FU"}
CELL_BY_ORDERSTATUS = {"F": "ISO34", "O": "ISO49", "P": "ISO49"}
OBJECT_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
# Identifier columns that are not morphology; the binding's drop list.
DROP_LIST = ("l_linenumber", "l_partkey", "o_custkey")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def _case(col: str, mapping: dict):
    expr = None
    for k, v in mapping.items():
        expr = (F.when(F.col(col) == k, v) if expr is None else expr.when(F.col(col) == k, v))
    return expr


def file_location():
    # the eleventh of the customer key in hundredths, written with two places; the texts are looked up, not formatted
    texts = F.array(*[F.lit(f"{x / 100:.2f}".replace(".", "_")) for x in range(-10, 11)])
    # (%.2f cuts the word null to two characters)
    dose_text = F.when(F.col("o_custkey").isNull(), F.lit("nu")).otherwise(
        F.element_at(texts, (F.col("o_custkey") % 11 + 11).cast("int")))
    position = F.when(F.col("l_orderkey") % 4 > 0,
                      F.concat(F.lit("_Position_"), (F.col("l_orderkey") % 4).cast("string"))
                      ).otherwise(F.lit(""))
    return F.concat(
        F.lit("/data/"), F.date_format("o_orderdate", "yyMMdd"), F.lit("_plate_"),
        _case("o_orderstatus", CELL_BY_ORDERSTATUS), F.lit("_"),
        _case("o_orderpriority", DRUG_BY_PRIORITY), F.lit("_"),
        dose_text, F.lit("uM/img"), position, F.lit(".tif"),
    )


def objects(spark: SparkSession, sf_dir: str, threshold: int | None = None) -> DataFrame:
    """Per-object table: keys, Metadata_FileLocation, identifiers, features."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    # part first: the per-order ranking then leaves the rows hash-partitioned
    # by l_orderkey (= ImageNumber) for the image join and the organoid median
    keys_only = li.select("l_orderkey")  # group sizes do not change under the n:1 join
    li = li.join(part, li.l_partkey == part.p_partkey, "left").drop("p_partkey")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                                                  "o_orderpriority")
    li = li.join(order, li.l_orderkey == order.o_orderkey)
    ranked = rank_in_group(li, ["l_orderkey"], list(OBJECT_ORDER), out="ObjectNumber",
                           threshold=threshold, detect=(keys_only, ["l_orderkey"]))
    return ranked.select(
        F.col("l_orderkey").alias("ImageNumber"), "ObjectNumber",
        file_location().alias("Metadata_FileLocation"),
        "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_tax",
        "p_size", "p_retailprice",
    )


def image_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ImageNumber of every object, straight from the scan (hot-image detection)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ImageNumber"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("ImageNumber"), "o_custkey", "o_orderstatus",
                    "o_totalprice", "o_orderdate", "o_orderpriority")


def organoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent objects: one row per (l_orderkey, l_linenumber)."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("ImageNumber"),
                      F.col("l_linenumber").cast("long").alias("ObjectNumber")).agg(
        F.sum("l_quantity").alias("AreaShape_Area"),
        F.avg("l_extendedprice").alias("l_extendedprice"),
        F.count(F.lit(1)).alias("Children_Count"),
    )


def embeddings_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide profiles: vec_id, Drug label (label code), features array<double>."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast("string").alias("Drug"),
                    F.col("embedding").cast("array<double>").alias("features"))


def embeddings_wide(spark: SparkSession, sf_dir: str, dims: int = 64) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast("string").alias("Drug"),
                    *[F.col("embedding")[i].cast("double").alias(f"f{i:02d}") for i in range(dims)])
