"""Read per-object / per-image tables.

CSV exports are read by Spark from any path it can open.  Every file's own header
is looked up first.  Files with one header are read together; tables of several
headers are united by column name where that is asked for (as ``read_table``
does) and are an error otherwise, so nothing is read by position.  Columns that hold text
anywhere stay text, as in pandas; missing-value tokens and NaN
become null once, at the source (R1).
"""

from __future__ import annotations

import csv

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphospark.featureset import q

# Text that pandas.read_csv treats as missing by default.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null")

# Columns the exports always carry as text / integers.
STRING_COLUMNS = {"Metadata_FileLocation"}
LONG_COLUMNS = {"ImageNumber", "ObjectNumber"}


#: A number as pandas reads it.
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def _value(name: str):
    """The text of a field, null where it is a missing-value token."""
    c = F.col(q(name))
    return F.when(~c.isin(*NA_TOKENS), c)


def column_types(raw: DataFrame, string_columns=(), long_columns=()) -> T.StructType:
    """Keys long, named text columns string; of the others those with a value that
    is no number are string and the rest double (one aggregate over the table)."""
    strings = STRING_COLUMNS | set(string_columns)
    longs = LONG_COLUMNS | set(long_columns)
    unknown = [c for c in raw.columns if c not in strings | longs]
    if unknown:
        row = raw.agg(*[F.max(~_value(c).rlike(NUMBER)).alias(f"t{i}") for i, c in enumerate(unknown)]).first()
        strings = strings | {c for i, c in enumerate(unknown) if row[f"t{i}"]}
    return T.StructType([
        T.StructField(c, T.StringType() if c in strings else T.LongType() if c in longs else T.DoubleType(), True)
        for c in raw.columns])


def headers(spark: SparkSession, path) -> dict[tuple[str, ...], list[str]]:
    """{header: its files}: the first line of every file, read in tasks; one row a file reaches the driver."""
    def first_lines(batches):
        seen = set()
        for batch in batches:
            files = batch.column(0).dictionary_encode()
            fresh = [(f, k) for k, f in enumerate(files.dictionary.to_pylist()) if f not in seen]
            at = [files.indices.index(k).as_py() for _, k in fresh]  # lines of a file come in order
            seen.update(f for f, _ in fresh)
            yield batch.take(pa.array(at, pa.int64())).select([0, 1])

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value",
                                         F.col("_metadata.file_block_start").alias("start")).filter("start = 0")
    found: dict[tuple[str, ...], list[str]] = {}
    for r in sorted(lines.mapInArrow(first_lines, "file string, value string").collect()):
        found.setdefault(tuple(next(csv.reader([r.value.lstrip("\ufeff")]), [])), []).append(r.file)
    return found


def read_csv(spark: SparkSession, path, schema: T.StructType | None = None, unite_headers: bool = False,
             **schema_kw) -> DataFrame:
    """Rows of one or several CSV files; columns in the order of the first header that has them, null where a
    file has none.  A given ``schema`` saves the pass that finds the text columns."""
    groups = headers(spark, path)
    if len(groups) > 1 and not unite_headers:
        raise ValueError("the header differs between " + " and ".join(files[0] for files in list(groups.values())[:2]))
    names = list(schema.names) if schema else list(dict.fromkeys(c for header in groups for c in header))
    raw = None
    for header, files in groups.items():
        as_text = T.StructType([T.StructField(c, T.StringType(), True) for c in header])
        own = spark.read.csv(files, header=True, schema=as_text, enforceSchema=False, mode="FAILFAST")
        part = own.select(*[F.col(q(c)) if c in header else F.lit(None).cast("string").alias(c) for c in names])
        raw = part if raw is None else raw.unionByName(part)
    if raw is None:  # files without any line
        raw = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType(), True) for c in names]))
    schema = schema or column_types(raw, **schema_kw)
    return normalise_nan(raw.select(*[
        (_value(f.name) if isinstance(f.dataType, T.StringType) else F.trim(_value(f.name)).cast(f.dataType))
        .alias(f.name) for f in schema.fields]))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return normalise_nan(spark.read.parquet(path))


def normalise_nan(df: DataFrame) -> DataFrame:
    """NaN -> null in every floating column (a projection, no shuffle)."""
    exprs = []
    changed = False
    for f in df.schema.fields:
        c = F.col(q(f.name))
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name)
            changed = True
        exprs.append(c)
    return df.select(*exprs) if changed else df


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **kw) -> DataFrame:
    fmt = fmt or ("csv" if _holds_csv(spark, path) else "parquet")
    return read_csv(spark, path, **({"unite_headers": True} | kw)) if fmt == "csv" else read_parquet(spark, path)


def _holds_csv(spark: SparkSession, path: str) -> bool:
    """By the file names that Spark lists; no file is read."""
    return any(f.endswith((".csv", ".csv.gz")) for f in spark.read.text(path).inputFiles())
