"""Tables behind the reference's figures (D1-D9); drawing is not built.

* D1 bar: mean and bootstrap 95% interval.  Resampling is replaced by
  Poisson(1) weights drawn from a hash of (row, replicate, seed).  Every task
  keeps one sketch a group, the weighted sums of all replicates, and sketches
  merge by addition: rows are neither multiplied nor moved.
* D3 violin: Gaussian KDE (Scott's factor) on a 100-point grid per group.  Rows
  are binned at a small part of the bandwidth with the moments of their places
  in the bin; the grid is computed from the bins, whose number does not grow
  with the rows.
* D4 boxen: letter values (quantiles 2^-i) by exact rank quantiles.
* D5 regression facets: line per facet (A12) and estimates per x or per
  nine inner-percentile bins.
D2, D6-D9 are the outputs of A4, MM10, A9, R-4/R-6 and A13.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphospark.featureset import q
from morphospark.operators.aggregate import group_median
from morphospark.operators.dose import line_fit
from morphospark.operators.joins import sized_broadcast
from morphospark.operators.quantiles import quantiles_by_rank
from morphospark.operators.ranking import hash_order_key
from morphospark.session import stage


def poisson1_thresholds(kmax: int = 12) -> list:
    """CDF of Poisson(1) at 0..kmax-1 (weight = number of thresholds <= u).

    Beyond 12 it differs from 1 by less than 2^-32, the step of u: no weight is cut short.
    """
    out, acc = [], 0.0
    for k in range(kmax):
        acc += math.exp(-1.0) / math.factorial(k)
        out.append(acc)
    return out


#: Constants of the 32-bit finaliser that spreads (row seed, replicate); part of the definition of the weights.
SPREAD = (0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35)


def poisson1_weights(seeds, replicates: int):
    """Weights (rows x replicates) of rows with the given 32-bit seeds."""
    import numpy as np

    rep = (np.arange(replicates, dtype=np.uint64) * SPREAD[0]).astype(np.uint32)
    h = np.asarray(seeds).astype(np.uint32)[:, None] ^ rep[None, :]
    for shift, factor in ((16, SPREAD[1]), (13, SPREAD[2])):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    h = h ^ (h >> np.uint32(16))
    limits = np.array([math.ceil(t * 2 ** 32) for t in poisson1_thresholds()], np.uint64)
    return np.searchsorted(limits, h.astype(np.uint64), side="right")


#: Sketches that a task holds before it hands them on, and the fan-in of the first merge.
HELD_SKETCHES = 1000
MERGE_WAYS = 64


def bootstrap_mean_ci(df: DataFrame, group, value: str, id_cols, replicates: int = 1000,
                      seed: int = 0, level: float = 95.0) -> DataFrame:
    """Per group mean, n and the bootstrap interval of the mean."""
    import numpy as np
    import pyarrow as pa

    group = [group] if isinstance(group, str) else list(group)
    lo, hi = (100.0 - level) / 200.0, 1.0 - (100.0 - level) / 200.0
    row_seed = F.conv(F.substring(hash_order_key(id_cols, f"boot{seed}"), 1, 8), 16, 10).cast("long")
    keys = F.struct(*[F.col(q(g)).alias(f"k{i}") for i, g in enumerate(group)])
    rows = df.filter(F.col(q(value)).isNotNull()).select(
        F.to_json(keys).alias("_g"), row_seed.alias("_s"), F.col(q(value)).cast("double").alias("_x"))

    def table(held):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), *[pa.array([x[i].tolist() for x in held.values()], pa.list_(pa.float64()))
                                                  for i in (0, 1)]], names=["_g", "_w", "_wx"])

    def sketch(batches):
        held = {}
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            names, code = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            seeds, x = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            order = np.argsort(code, kind="stable")
            for at in range(0, len(order), 2000):
                part = order[at:at + 2000]
                w = poisson1_weights(seeds[part], replicates).astype(np.float64)
                wx = w * x[part][:, None]
                starts = np.flatnonzero(np.concatenate(([True], np.diff(code[part]) != 0)))
                for k, a, b in zip(code[part][starts], np.add.reduceat(w, starts), np.add.reduceat(wx, starts)):
                    old = held.get(names[k])
                    held[names[k]] = (a, b) if old is None else (old[0] + a, old[1] + b)
            if len(held) > HELD_SKETCHES:
                yield table(held)
                held = {}
        if held:
            yield table(held)

    def total(part, column):
        return np.sum([x.values.to_numpy() for x in part.column(column)], axis=0)

    def merge(key, part):
        return pa.table({"_g": pa.array([key[0].as_py()]), "_w": pa.array([total(part, "_w").tolist()], pa.list_(pa.float64())),
                         "_wx": pa.array([total(part, "_wx").tolist()], pa.list_(pa.float64()))})

    def interval(key, part):
        w, wx = total(part, "_w"), total(part, "_wx")
        means = wx[w > 0] / w[w > 0]
        ends = np.quantile(means, [lo, hi]).tolist() if len(means) else [None, None]
        return pa.table({"_g": pa.array([key[0].as_py()]), "ci_low": pa.array(ends[:1], pa.float64()),
                         "ci_high": pa.array(ends[1:], pa.float64())})

    kind = "_g string, _w array<double>, _wx array<double>"
    # a sketch is 16 kB whatever its rows; two merges keep the largest group of them bounded
    parts = rows.mapInArrow(sketch, kind).withColumn("_way", F.spark_partition_id() % MERGE_WAYS)
    merged = parts.groupBy("_g", "_way").applyInArrow(merge, kind)
    ci = merged.groupBy("_g").applyInArrow(interval, "_g string, ci_low double, ci_high double")
    base = df.groupBy(*[q(g) for g in group]).agg(F.avg(F.col(q(value))).alias("mean"),
                                                  F.count(F.col(q(value))).alias("n")).withColumn("_g", F.to_json(keys))
    return base.join(ci, "_g", "left").drop("_g")


#: Bins a bandwidth, and the reach of the kernel in bandwidths; with moments up to the fifth the density differs
#: from the exact sum by less than 4e-13 of the kernel's peak for the bins and 1e-14 for the reach.
BINS_PER_BANDWIDTH = 32
KERNEL_REACH = 8.5
MOMENTS = 6


def kde_grid(df: DataFrame, group, value: str, points: int = 100, cut: float = 2.0) -> DataFrame:
    """D3: (group..., i, x, density) with a Gaussian kernel and Scott's bandwidth
    h = std_sample * n^(-1/5); grid from min - cut*h to max + cut*h.

    A row at t bandwidths from the centre c of its bin adds
    exp(-(z-t)^2/2) = exp(-z^2/2) * sum of He_k(z) t^k / k! at a grid point z
    bandwidths from c, so a bin needs the sums of t^k alone.
    """
    group = [group] if isinstance(group, str) else list(group)
    by = [q(g) for g in group]
    stats = df.groupBy(*by).agg(
        F.count(F.col(q(value))).alias("_n"), F.stddev_samp(F.col(q(value))).alias("_sd"),
        F.min(F.col(q(value))).alias("_lo"), F.max(F.col(q(value))).alias("_hi"))
    stats = stats.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))) \
        .filter(F.col("_h") > 0) \
        .withColumn("_g0", F.col("_lo") - cut * F.col("_h")) \
        .withColumn("_step", (F.col("_hi") - F.col("_lo") + 2 * cut * F.col("_h")) / (points - 1))
    stats = stage(stats, "kde-stats")
    rows = df.select(*by, F.col(q(value)).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    place = (F.col("_x") - F.col("_lo")) / F.col("_h") * BINS_PER_BANDWIDTH
    j = rows.join(sized_broadcast(stats.select(*by, "_lo", "_h")), group) \
        .select(*by, F.floor(place).alias("_b"), ((place - F.floor(place) - 0.5) / BINS_PER_BANDWIDTH).alias("_t"))
    bins = j.groupBy(*by, "_b").agg(*[F.sum(F.pow("_t", F.lit(k))).alias(f"_m{k}") for k in range(MOMENTS)])
    at = bins.join(sized_broadcast(stats), group) \
        .withColumn("_c", F.col("_lo") + (F.col("_b") + 0.5) / BINS_PER_BANDWIDTH * F.col("_h"))
    first = F.greatest(F.lit(0), F.ceil((F.col("_c") - KERNEL_REACH * F.col("_h") - F.col("_g0")) / F.col("_step")).cast("int"))
    last = F.least(F.lit(points - 1), F.floor((F.col("_c") + KERNEL_REACH * F.col("_h") - F.col("_g0")) / F.col("_step")).cast("int"))
    at = at.withColumn("_first", first).withColumn("_last", last).filter("_first <= _last") \
        .withColumn("i", F.explode(F.sequence("_first", "_last")))
    z = (F.col("_g0") + F.col("i") * F.col("_step") - F.col("_c")) / F.col("_h")
    at = at.withColumn("_z", z)
    hermite, series = [F.lit(1.0), F.col("_z")], F.lit(0.0)
    for k in range(2, MOMENTS):
        hermite.append(F.col("_z") * hermite[k - 1] - (k - 1) * hermite[k - 2])
    for k in range(MOMENTS):
        series = series + hermite[k] * F.col(f"_m{k}") / float(math.factorial(k))
    dens = at.groupBy(*by, "i").agg(F.sum(F.exp(-F.col("_z") * F.col("_z") / 2) * series).alias("_s"))
    grid = stats.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return grid.join(dens, [*group, "i"], "left").select(
        *by, "i", (F.col("_g0") + F.col("i") * F.col("_step")).alias("x"),
        (F.coalesce("_s", F.lit(0.0)) / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("density"))


def letter_values(df: DataFrame, group, value: str) -> DataFrame:
    """lower/upper letter values per depth 1..k, k = floor(log2 n) - 3 (Tukey), >= 1.

    The depths asked for are those of the largest group.
    """
    group = [group] if isinstance(group, str) else list(group)
    largest = df.groupBy(*[q(g) for g in group]).agg(F.count(F.col(q(value))).alias("n")).agg(F.max("n")).first()[0]
    max_depth = max(1, int(math.floor(math.log2(max(largest or 1, 1)))) - 3)
    probs = sorted({0.5 ** (i + 1) for i in range(1, max_depth + 1)} | {1 - 0.5 ** (i + 1) for i in range(1, max_depth + 1)})
    qs = quantiles_by_rank(df, group, [value], probs)
    n = df.groupBy(*[q(g) for g in group]).agg(F.count(F.col(q(value))).alias("n"))
    depth = F.round(-F.log2(F.least(F.col("p"), 1 - F.col("p")))).cast("int") - 1
    out = qs.join(n, group).withColumn("depth", depth)
    k = F.greatest(F.lit(1), F.floor(F.log2(F.col("n").cast("double"))).cast("int") - 3)
    return out.filter(F.col("depth") <= k).select(
        *[q(g) for g in group], "depth", F.when(F.col("p") < 0.5, "lower").otherwise("upper").alias("side"),
        "p", "value", "n")


def binned_estimates(df: DataFrame, facet, x: str, y: str, bins: int = 9,
                     estimator: str = "median") -> DataFrame:
    """Per facet, x assigned to the nearest of ``bins`` inner percentiles of
    x (ties -> lower bin), then the estimator of y per bin."""
    facet = [facet] if isinstance(facet, str) else list(facet)
    probs = [(i + 1) / (bins + 1) for i in range(bins)]
    centres = quantiles_by_rank(df, facet, [x], probs).groupBy(*[q(f) for f in facet]).agg(
        F.array_sort(F.collect_list(F.struct("p", "value"))).alias("_c"))  # bins entries per facet
    j = df.select(*[q(f) for f in facet], F.col(q(x)).cast("double").alias("_x"),
                  F.col(q(y)).cast("double").alias("_y")).join(sized_broadcast(centres), facet)
    nearest = F.array_min(F.transform(F.col("_c"), lambda c, i: F.struct(
        F.abs(F.col("_x") - c["value"]).alias("d"), i.alias("i"), c["value"].alias("centre"))))
    j = j.withColumn("_b", nearest).select(*[q(f) for f in facet], F.col("_b.i").alias("bin"),
                                           F.col("_b.centre").alias("x_bin"), "_y")
    if estimator == "mean":
        return j.groupBy(*[q(f) for f in facet], "bin", "x_bin").agg(F.avg("_y").alias("estimate"))
    return group_median(j, facet + ["bin", "x_bin"], ["_y"]).withColumnRenamed("_y", "estimate")


def point_estimates(df: DataFrame, facet, x: str, y: str, estimator: str = "mean") -> DataFrame:
    """D5 without bins: estimator of y at each distinct x."""
    facet = [facet] if isinstance(facet, str) else list(facet)
    if estimator == "mean":
        return df.groupBy(*[q(f) for f in facet], q(x)).agg(F.avg(F.col(q(y))).alias("estimate"))
    return group_median(df, facet + [x], [y]).withColumnRenamed(y, "estimate")


def facet_lines(df: DataFrame, facet, x: str, y: str) -> DataFrame:
    """D5 line per facet."""
    return line_fit(df, [facet] if isinstance(facet, str) else list(facet), x, y)
