"""Ranks, ordered splits, hash shuffles and per-group heads.

``global_rank`` numbers rows in a total order without a single-partition
window: range-partition on the order, sort inside each partition, count each
partition (one number per partition reaches the driver), and add the
partition's offset.  The tagged data is checkpointed to the reliable
checkpoint folder first, so the counts and the final numbering see the same
rows even if an executor is lost in between.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphospark.featureset import q
from morphospark.operators.skew import null_safe_cond, split_hot
from morphospark.session import ensure_checkpoint_dir, shuffle_partitions, stage


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(q(c))


RANGE_ROWS_CONF = "morphospark.rangePartitionRows"
DEFAULT_RANGE_ROWS = 4_000_000


def hash_order_key(keys, seed: int | str = 0) -> Column:
    """Reproducible shuffle key md5(k1|k2|...|seed); same text in DuckDB."""
    parts = [F.coalesce(_col(k).cast("string"), F.lit("")) for k in keys] + [F.lit(str(seed))]
    return F.md5(F.concat_ws("|", *parts))


def global_rank(df: DataFrame, order, rank_col: str = "_grank",
                num_partitions: int | None = None) -> DataFrame:
    """Add a 1-based position in the total order ``order`` (a list of columns)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if num_partitions is None:
        # range partitions sized from the rows (one count; a fixed number
        # would give 100 TB inputs a few enormous sort tasks)
        per = int(spark.conf.get(RANGE_ROWS_CONF, str(DEFAULT_RANGE_ROWS)))
        num_partitions = max(shuffle_partitions(spark), -(-df.count() // per))
    n = num_partitions
    order = [_col(c) for c in order]
    tagged = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn(
            "_pos",
            F.monotonically_increasing_id()
            - F.shiftleft(F.col("_pid").cast("long"), 33),
        )
    )
    tagged = stage(tagged, "rank")
    counts = dict(tagged.groupBy("_pid").count().collect())
    sizes = [int(counts.get(i, 0)) for i in range(n)]
    offsets = [0] + list(accumulate(sizes))[:-1]
    return tagged.withColumn(
        rank_col,
        F.element_at(F.lit(offsets).cast("array<bigint>"), F.col("_pid") + 1)
        + F.col("_pos") + 1,
    ).drop("_pid", "_pos")


def rank_in_group(df: DataFrame, keys, order, out: str = "_rank",
                  threshold: int | None = None, detect=None) -> DataFrame:
    """row_number() within each group of ``keys`` by ``order`` (1-based, long).

    Ordinary groups use a window; hot groups are numbered by ``global_rank``
    minus the group's first position, so no task holds a whole hot group.
    ``order`` must be a total order within each group for reproducible output.
    """
    keys = list(keys)
    normal, hot, mode = split_hot(df, keys, threshold, detect)
    if detect is not None and mode == "some":
        mode = "all"  # coarse routing: the group-start table is not bounded by the hot list
    parts = []
    if normal is not None:
        w = Window.partitionBy(*[_col(k) for k in keys]).orderBy(*[_col(c) for c in order])
        parts.append(normal.withColumn(out, F.row_number().over(w).cast("long")))
    if hot is not None:
        ranked = global_rank(hot, [_col(k) for k in keys] + [_col(c) for c in order])
        starts = ranked.groupBy(*[q(k) for k in keys]).agg(F.min("_grank").alias("_gstart"))
        starts = starts.toDF(*[f"_s{i}" for i in range(len(keys))], "_gstart")
        if mode == "some":  # at most MAX_HOT_GROUPS rows
            starts = F.broadcast(starts)
        joined = ranked.join(starts, null_safe_cond(ranked, starts, keys, starts.columns[:-1]))
        parts.append(
            joined.withColumn(out, (F.col("_grank") - F.col("_gstart") + 1).cast("long"))
            .drop("_grank", "_gstart", *starts.columns[:-1])
        )
    out_df = parts[0]
    for p in parts[1:]:
        out_df = out_df.unionByName(p)
    return out_df


def head_per_group(df: DataFrame, keys, n, order, threshold: int | None = None) -> DataFrame:
    """First ``n`` rows per group in ``order`` (``n`` int or Column)."""
    ranked = rank_in_group(df, keys, order, out="_head_rank", threshold=threshold)
    limit = n if isinstance(n, Column) else F.lit(int(n))
    return ranked.filter(F.col("_head_rank") <= limit).drop("_head_rank")


def balanced_heads(df: DataFrame, label: str, order, threshold: int | None = None) -> DataFrame:
    """W2 as used for class balancing: n = size of the smallest label group."""
    n = df.groupBy(q(label)).count().agg(F.min("count")).first()[0]
    if n is None:
        return df.limit(0)
    return head_per_group(df, [label], int(n), order, threshold)


def ordered_split(df: DataFrame, order, test_fraction: float = 0.5):
    """Unshuffled split; train = first n - ceil(n*test_fraction) rows."""
    import math

    ranked = global_rank(df, order, "_split_rank")
    n = ranked.count()
    n_test = int(math.ceil(n * test_fraction))
    n_train = n - n_test
    train = ranked.filter(F.col("_split_rank") <= n_train).drop("_split_rank")
    test = ranked.filter(F.col("_split_rank") > n_train).drop("_split_rank")
    return train, test


def split_flag_ordered(df: DataFrame, order, test_fraction: float = 0.5,
                       out: str = "is_train") -> DataFrame:
    """W3 as one table with a boolean train flag."""
    import math

    ranked = global_rank(df, order, "_split_rank")
    n = ranked.count()
    n_train = n - int(math.ceil(n * test_fraction))
    return ranked.withColumn(out, F.col("_split_rank") <= n_train).drop("_split_rank")


def random_split_flag(df: DataFrame, keys, test_fraction: float = 0.25, seed=0,
                      out: str = "is_train") -> DataFrame:
    """Reproducible hash split; row is test when its hash bucket < fraction."""
    h = F.conv(F.substring(hash_order_key(keys, seed), 1, 8), 16, 10).cast("double") / float(16 ** 8)
    return df.withColumn(out, h >= F.lit(test_fraction))


def label_codes(df: DataFrame, label: str, out: str = "label_code", order=None) -> DataFrame:
    """Dense 0-based codes of the labels, in sorted order, or in order of first appearance by ``order``.

    Labels are numbered as a table, by a range sort of one row each: there may
    be as many as there are rows.  A null label has no code.
    """
    firsts = df.filter(F.col(q(label)).isNotNull()).groupBy(q(label)).agg(
        F.min(F.struct(*[_col(c).alias(f"o{i}") for i, c in enumerate(order or [label])])).alias("_first"))
    codes = global_rank(firsts, ["_first", label], "_code").select(
        F.col(q(label)).alias("_label"), (F.col("_code") - 1).alias(out))
    from morphospark.operators.joins import sized_broadcast

    codes = sized_broadcast(codes)
    joined = df.join(codes, df[q(label)] == codes["_label"], "left")
    return joined.select(*[df[q(c)] for c in df.columns], out)


def running_total(df: DataFrame, value: str, order_desc: str, tie: str,
                  out: str = "cumulative_importance") -> DataFrame:
    """Running sum over descending value (model-sized input)."""
    w = (Window.orderBy(F.col(q(order_desc)).desc(), F.col(q(tie)).asc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(out, F.sum(F.col(q(value))).over(w))


def top_k(df: DataFrame, order, k: int) -> DataFrame:
    """O3: sort then keep k rows (TakeOrderedAndProject)."""
    return df.orderBy(*[_col(c) for c in order]).limit(k)
