"""Sinks.  Parquet by default, CSV on request."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by=None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def write_without_null_columns(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S3: drop columns holding any null (P5), then write."""
    from morphospark.operators.columns import drop_null_columns

    write_table(drop_null_columns(df), path, fmt)
