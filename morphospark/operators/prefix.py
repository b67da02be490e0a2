"""Prefix sums over distinct values, in two distributed levels.

Quantiles, letter values, rank bins and empirical distribution functions need
how many rows of a group lie below a value, not the place of each row.  Equal
values are therefore counted first (a map-side combined aggregate: a value that
nine rows in ten share is one row from there on), and only the distinct
(key, value) pairs are range-partitioned and sorted.  Every partition sums up
its own rows; the one group that it begins with may have rows in earlier
partitions, so one carried sum a partition completes the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphospark.featureset import q
from morphospark.operators.ranking import DEFAULT_RANGE_ROWS, RANGE_ROWS_CONF
from morphospark.session import shuffle_partitions, stage


def _changes(columns, last) -> np.ndarray:
    """Where a row of the batch starts a group other than that of the row before."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    for col in columns:
        a, b = col.slice(1), col.slice(0, n - 1)
        differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        if pa.types.is_floating(col.type):  # NaN groups with NaN
            nan = [pc.fill_null(pc.is_nan(x), False).to_numpy(zero_copy_only=False) for x in (a, b)]
            differs = differs & ~(nan[0] & nan[1])
        nulls = [pc.is_null(x).to_numpy(zero_copy_only=False) for x in (a, b)]
        out[1:] |= differs | (nulls[0] != nulls[1])
    # NaN differs from itself as a scalar: its text does not
    out[0] = last is None or repr([c[0].as_py() for c in columns]) != last
    return out


def _running(keys, sums):
    """Task body: running sums before each row within its group, for sorted rows of one partition."""
    def run(batches):
        pid, last, head, carry = TaskContext.get().partitionId(), None, True, [0] * len(sums)
        for batch in batches:
            if not len(batch):
                continue
            key_cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            fresh = _changes(key_cols, last) if keys else np.zeros(len(batch), bool)
            first = last is None
            if keys and first:
                fresh[0] = False  # the partition's first group starts with nothing carried
            at = np.maximum.accumulate(np.where(fresh, np.arange(len(batch)), -1))
            before, inner = [], at < 0
            for i, name in enumerate(sums):
                own = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
                total = np.cumsum(own)
                prior = total - own
                start = np.where(inner, 0, prior[np.maximum(at, 0)])
                before.append(prior - start + np.where(inner, carry[i], 0))
                carry[i] = before[-1][-1] + own[-1]
            of_head = head & inner
            head = bool(of_head[-1])
            last = repr([c[-1].as_py() for c in key_cols])
            n = len(batch)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(b) for b in before], pa.array(np.full(n, pid, np.int32)),
                 pa.array(of_head)],
                names=[*batch.schema.names, *[f"{s}_before" for s in sums], "_pid", "_head"])

    return run


def prefix_sums(df: DataFrame, keys, value: str, sums, num_partitions: int | None = None) -> DataFrame:
    """Add ``<s>_before`` for each column s of ``sums``: its sum over the rows of the same
    ``keys`` with a smaller ``value``.

    ``df`` has at most one row for each (keys, value) and no null in ``sums``
    (long or double).  The driver sees one row a partition.
    """
    keys, sums, spark = list(keys), list(sums), df.sparkSession
    df = stage(df, "prefix-in")
    if num_partitions is None:
        per = int(spark.conf.get(RANGE_ROWS_CONF, str(DEFAULT_RANGE_ROWS)))
        num_partitions = max(shuffle_partitions(spark), -(-df.count() // per))
    order = [F.col(q(k)) for k in [*keys, value]]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    fields = [f"`{c}` {kinds[c]}" for c in df.columns] + [f"`{s}_before` {kinds[s]}" for s in sums]
    done = stage(df.repartitionByRange(num_partitions, *order).sortWithinPartitions(*order).mapInArrow(
        _running(keys, sums), ", ".join([*fields, "_pid int", "_head boolean"])), "prefix")
    key = F.struct(*[F.col(q(k)).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("none"))
    upto = [(F.col(q(s)) + F.col(q(f"{s}_before"))).alias(f"s{i}") for i, s in enumerate(sums)]
    ends = done.groupBy("_pid").agg(
        F.min(key).alias("a"), F.max(key).alias("z"),
        F.max(F.struct(key.alias("key"), F.col(q(value)).alias("value"), *upto)).alias("top")).orderBy("_pid").collect()
    nothing = [0.0 if kinds[s] == "double" else 0 for s in sums]
    carries, group, held = [], None, nothing
    for r in ends:
        a, z = repr(r.a), repr(r.z)  # as text: NaN is itself there
        carry = held if a == group else nothing
        carries.append((r["_pid"], *carry))
        own = [r.top[f"s{i}"] for i in range(len(sums))]
        group, held = z, [x + (c if a == z else 0) for x, c in zip(own, carry)]
    carried = spark.createDataFrame(carries, ", ".join(
        ["_pid int", *[f"`_c{i}` {kinds[s]}" for i, s in enumerate(sums)]]))
    out = done.join(F.broadcast(carried), "_pid")  # one row a partition
    for i, s in enumerate(sums):
        name = f"{s}_before"
        out = out.withColumn(name, F.col(q(name)) + F.when(F.col("_head"), F.col(f"_c{i}")).otherwise(0))
    return out.drop("_pid", "_head", *[f"_c{i}" for i in range(len(sums))])


def tall_values(df: DataFrame, keys, features) -> DataFrame:
    """(keys..., _f feature index, _v value) with nulls dropped."""
    keys = list(keys)
    return df.select(
        *[q(k) for k in keys],
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("_f"), F.col(q(c)).cast("double").alias("_v"))
            for i, c in enumerate(features)])).alias("_t"),
    ).select(*[q(k) for k in keys], "_t._f", "_t._v").filter(F.col("_v").isNotNull())


def value_counts(df: DataFrame, keys, features) -> DataFrame:
    """(keys..., _f, _v, _n, _n_before) of every distinct value of every feature in every group."""
    counts = tall_values(df, keys, features).groupBy(*[q(k) for k in keys], "_f", "_v").agg(F.count("*").alias("_n"))
    return prefix_sums(counts, [*keys, "_f"], "_v", ["_n"])


def order_statistics(ranked: DataFrame, keys, wanted) -> DataFrame:
    """(keys..., _f, _size, _at) joined to the values at the positions that ``wanted`` makes of ``_size``.

    ``wanted(size)`` is an array of 0-based positions.  Returns (keys..., _f,
    _size, _t position, _v value); one row for each group goes into the join.
    """
    by = [*keys, "_f"]
    sizes = ranked.groupBy(*[q(k) for k in by]).agg(F.sum("_n").alias("_size"))
    sizes = sizes.withColumn("_wanted", F.array_distinct(wanted(F.col("_size"))))
    named = sizes.toDF(*[f"_g{i}" for i in range(len(by))], "_size", "_wanted")
    from morphospark.operators.joins import sized_broadcast
    from morphospark.operators.skew import null_safe_cond

    hit = F.filter("_wanted", lambda t: (t >= F.col("_n_before")) & (t < F.col("_n_before") + F.col("_n")))
    named = sized_broadcast(named)
    joined = ranked.join(named, null_safe_cond(ranked, named, by, named.columns[:len(by)]))
    return joined.select(*[q(k) for k in by], "_size", F.explode(hit).alias("_t"), "_v")
