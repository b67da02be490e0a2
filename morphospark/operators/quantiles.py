"""Exact quantiles from the counts of distinct values (medians of hot groups,
global quantiles, robust scaling, letter values and binned estimates).

A quantile over a whole column is one hot group by definition; prefix sums
over its distinct values (``operators.prefix``) keep every task bounded, ties
included.  Linear interpolation between the order statistics at positions
floor/ceil(p*(n-1)) - the same rule as Spark's ``percentile`` and DuckDB's
``quantile_cont``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphospark.featureset import q
from morphospark.operators.prefix import order_statistics, tall_values, value_counts

__all__ = ["column_quantiles", "quantiles_by_rank", "tall_values"]


def quantiles_by_rank(df: DataFrame, keys, features, probs) -> DataFrame:
    """Tall result (keys..., feature, p, value)."""
    keys, features, probs = list(keys), list(features), [float(p) for p in probs]
    by = [*keys, "_f"]

    def positions(size):
        return F.flatten(F.array(*[F.array(F.floor(F.lit(p) * (size - 1)), F.ceil(F.lit(p) * (size - 1))) for p in probs]))

    found = order_statistics(value_counts(df, keys, features), keys, positions)
    held = found.groupBy(*[q(k) for k in by], "_size").agg(F.map_from_entries(F.collect_list(F.struct("_t", "_v"))).alias("_m"))
    out = held.withColumn("_p", F.explode(F.array(*[F.lit(p) for p in probs]))) \
        .withColumn("_h", F.col("_p") * (F.col("_size") - 1)).withColumn("_w", F.col("_h") - F.floor("_h"))
    lo, hi = (F.element_at("_m", f("_h").cast("bigint")) for f in (F.floor, F.ceil))
    names = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("_f") + 1)
    return out.select(*[q(k) for k in keys], names.alias("feature"), F.col("_p").alias("p"),
                      (lo * (1.0 - F.col("_w")) + hi * F.col("_w")).alias("value"))


def column_quantiles(df: DataFrame, features, probs) -> dict:
    """{feature: {p: value}} for small numbers of features x probs (driver)."""
    out: dict = {c: {} for c in features}
    for r in quantiles_by_rank(df, [], features, probs).collect():
        out[r.feature][r.p] = r.value
    return out
