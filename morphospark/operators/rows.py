"""Row filters and conditional replacement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphospark.featureset import q


def drop_null_keys(df: DataFrame, keys) -> DataFrame:
    """Drop rows with a null in any key column."""
    return df.na.drop("any", subset=list(keys))


def exclude_pairs(df: DataFrame, pairs, cols=("Drug", "Cell")) -> DataFrame:
    """Drop rows equal to any of the value tuples (keys non-null, P11)."""
    if not pairs:
        return df
    cond = reduce(lambda a, b: a | b, [
        reduce(lambda x, y: x & y, [F.col(q(c)) == F.lit(v) for c, v in zip(cols, pair)])
        for pair in pairs])
    return df.filter(~cond)


def cross_section(df: DataFrame, col: str, value, drop_level: bool = True) -> DataFrame:
    """Rows whose key equals value; the key column dropped by default."""
    out = df.filter(F.col(q(col)) == F.lit(value))
    return out.drop(col) if drop_level else out


def isin(df: DataFrame, col: str, values, negate: bool = False) -> DataFrame:
    """(negated) membership."""
    cond = F.col(q(col)).isin(list(values))
    return df.filter(~cond if negate else cond)


def where_expr(df: DataFrame, predicate: str | Column) -> DataFrame:
    """Filter by a SQL expression or boolean column."""
    return df.filter(F.expr(predicate) if isinstance(predicate, str) else predicate)


def mask(df: DataFrame, cond: Column, cols, other=None) -> DataFrame:
    """Replace values where cond holds (pandas ``mask``)."""
    return df.withColumns({c: F.when(cond, F.lit(other)).otherwise(F.col(q(c))) for c in cols})


def keep_where(df: DataFrame, cond: Column, cols, other=None) -> DataFrame:
    """Keep values where cond holds, else ``other`` (pandas ``where``)."""
    return df.withColumns({c: F.when(cond, F.col(q(c))).otherwise(F.lit(other)) for c in cols})


def drop_null_rows(df: DataFrame, subset=None) -> DataFrame:
    """P20."""
    return df.na.drop("any", subset=list(subset) if subset else None)
