"""Joins (J1-J7, J11-J13) with pandas-style overlap suffixes.

Broadcast is used only behind a check of rows and bytes (``sized_broadcast``);
otherwise the join is left to Catalyst/AQE, which turns it into a broadcast
at run time when the materialised side proves small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphospark.featureset import q

DEFAULT_BROADCAST_ROWS = 2_000_000


#: A broadcast side takes this many bytes at most, on the driver and on every executor.
DEFAULT_BROADCAST_BYTES = 256 * 1024 * 1024


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes once it is broadcast: 8 a number, texts and arrays by their length."""
    def of(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType,
                                                                               T.MapType, T.StructType)):
            return F.greatest(F.size(c), F.lit(0)) * 8 + 24
        if isinstance(kind, T.StructType):
            return sum((of(c.getField(f.name), f.dataType) for f in kind.fields), F.lit(16))
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) + 24
        return F.lit(8)

    return sum((of(F.col(q(f.name)), f.dataType) for f in df.schema.fields), F.lit(16)).cast("long")


def sized_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                    max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows of together at most ``max_bytes``.

    One bounded pass: the widths, one number a row, are cut off beyond the row
    bound.  Otherwise the join is Catalyst's to plan.
    """
    got = df.select(row_bytes(df).alias("_w")).limit(max_rows + 1).agg(F.count("_w").alias("n"), F.sum("_w").alias("w")).first()
    return F.broadcast(df) if got.n <= max_rows and (got.w or 0) <= max_bytes else df


def suffix_join(left: DataFrame, right: DataFrame, on, how: str = "inner",
                suffixes=("", "_y"), right_on=None, broadcast_right: bool | int = False,
                keep_right_keys: bool = True) -> DataFrame:
    """Equi-join with pandas.merge column rules.

    A key pair with the same name on both sides becomes one column; when
    the names differ (J13, ``right_on``) both key columns are kept.  Every
    other name present on both sides gets ``suffixes``.
    """
    on = [on] if isinstance(on, str) else list(on)
    right_on = on if right_on is None else ([right_on] if isinstance(right_on, str) else list(right_on))
    merged = {lk for lk, rk in zip(on, right_on) if lk == rk}
    right_keep = [c for c in right.columns if c not in merged
                  and (keep_right_keys or c not in right_on)]
    overlap = (set(left.columns) - merged) & set(right_keep)
    ls, rs = suffixes
    # left columns keep their names (keys included) so the join's hash
    # partitioning on them stays visible to later aggregations
    l2 = left.select(*[F.col(q(c)).alias(c + ls if c in overlap else c) for c in left.columns])
    lnames = [lk + ls if lk in overlap else lk for lk in on]
    r2 = right.select(*[F.col(q(rk)).alias(f"_rk{i}") for i, rk in enumerate(right_on)],
                      *[F.col(q(c)).alias(c + rs if c in overlap else c) for c in right_keep])
    if broadcast_right:
        r2 = sized_broadcast(r2, DEFAULT_BROADCAST_ROWS if broadcast_right is True else int(broadcast_right))
    cond = None
    for i in range(len(on)):
        c = l2[q(lnames[i])] == r2[f"_rk{i}"]
        cond = c if cond is None else cond & c
    out = l2.join(r2, cond, how)
    return out.drop(*[f"_rk{i}" for i in range(len(on))])


def semi_join(left: DataFrame, right: DataFrame, on, anti: bool = False) -> DataFrame:
    """Keep (or drop) left rows with a match."""
    return left.join(right.select(*[q(c) for c in ([on] if isinstance(on, str) else on)]).distinct(),
                     on=on, how="left_anti" if anti else "left_semi")


def lookup_best(tall: DataFrame, best: DataFrame, on) -> DataFrame:
    """Rows of a tall table matching a small (group-sized) selection."""
    return tall.join(sized_broadcast(best), on=list(on), how="inner")
