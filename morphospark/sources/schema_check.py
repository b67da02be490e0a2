"""Conformance of a table's columns against an expected-column list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def family(name: str) -> str:
    return name.split("_", 1)[0]


def schema_conformance(spark: SparkSession, df: DataFrame, expected) -> DataFrame:
    """Rows (column, status, family) with status 'missing' or 'extra'."""
    have, want = list(df.columns), list(dict.fromkeys(expected))
    rows = [(c, "missing", family(c)) for c in want if c not in set(have)]
    rows += [(c, "extra", family(c)) for c in have if c not in set(want)]
    return spark.createDataFrame(rows, "column string, status string, family string")


def load_expected_columns(path: str) -> list[str]:
    """Dictionary file: one column name per line (blank/print lines ignored)."""
    out = []
    with open(path) as fh:
        for line in fh:
            name = line.strip()
            if name and " " not in name and "(" not in name:
                out.append(name)
    return out
