"""Table access, staged tables and null-safe helpers of the llm operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphospark.session import ensure_checkpoint_dir

#: The characters that separate words in the word contracts: space, and tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: Column | str = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def squeezed(text: Column) -> Column:
    """The text with each run of blanks as one space and none at its ends."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def words_of(squeezed_text: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.when(squeezed_text == "", empty).otherwise(F.split(squeezed_text, " "))


def settled(df: DataFrame) -> DataFrame:
    """The same rows, one generated for each, so that a later filter on a computed column stays above it.

    Catalyst would push such a filter below the projections by writing their
    expressions into one another, array functions inside array functions, and
    each element would then compute the arrays again.
    """
    return df.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("settled")) \
        .select("settled.*")


class Workspace:
    """Staged Parquet tables of one operator run in the shared checkpoint folder.

    A staged table cuts the lineage: a lost executor costs the tasks in
    flight, never the upstream plan.  ``drop`` removes tables as soon as no
    later step reads them, and lets Spark clear the shuffles behind them; what
    the returned DataFrame reads stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"

    def stage(self, df: DataFrame, label: str, group_bytes: int | None = None) -> DataFrame:
        """``group_bytes``: about the bytes of a Parquet row group, for rows of megabytes.  A reader takes a whole
        group at once, and the writer looks at the size of a group only every hundred rows unless told otherwise."""
        path = f"{self.base}/{label}"
        options = {} if group_bytes is None else {"parquet.block.size": str(group_bytes),
                                                  "parquet.page.size.row.check.min": "1"}
        df.write.mode("overwrite").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for label in labels:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{label}")
            path.getFileSystem(conf).delete(path, True)
        # Spark deletes the shuffle files of finished jobs when the driver's JVM collects their plans.
        jvm.System.gc()
