"""Scaling and column cleaning (MM7 Yeo-Johnson, MM8 standard, MM9 robust
and normalize, MM20 sigma clip, F10 z-score).

Statistics are per feature over the whole table: means and variances are
map-side combined aggregates; the Yeo-Johnson lambda search sends each
partition's (n, mean, M2) per (feature, lambda) - a few hundred numbers -
through one small groupBy per refinement round (Chan's parallel variance
merge), so the data is read a fixed number of times regardless of the
number of features.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphospark.featureset import FeatureSet, q
from morphospark.functions.yeojohnson import scaled_psi_col, scaled_psi_np, yeo_johnson_col
from morphospark.operators.quantiles import column_quantiles
from morphospark.session import stage

X_TINY = float(np.finfo(np.float64).tiny)


# ---------------------------------------------------------------- MM8 / F10
def column_moments(df: DataFrame, features) -> dict:
    row = df.agg(*[F.avg(F.col(q(c))).alias(f"m{i}") for i, c in enumerate(features)],
                 *[F.stddev_pop(F.col(q(c))).alias(f"s{i}") for i, c in enumerate(features)]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(features)}


def standard_scale(fs: FeatureSet, with_mean: bool = True, with_std: bool = True) -> FeatureSet:
    """MM8/F10: (x - mean)/std_pop; zero variance -> scale 1 (sklearn)."""
    mom = column_moments(fs.df, fs.features)
    cols = []
    for c in fs.features:
        m, s = mom[c]
        x = F.col(q(c))
        if with_mean and m is not None:
            x = x - F.lit(m)
        if with_std and s:
            x = x / F.lit(s)
        cols.append(x.alias(c))
    return FeatureSet(fs.df.select(*[q(k) for k in fs.keys], *cols), fs.keys, fs.features)


# ---------------------------------------------------------------- MM9
def robust_scale(fs: FeatureSet, q_range=(0.25, 0.75)) -> FeatureSet:
    """MM9 robust_scale: (x - median)/(q75 - q25), exact quantiles by rank;
    zero range -> scale 1."""
    lo, hi = q_range
    qs = column_quantiles(fs.df, fs.features, [lo, 0.5, hi])
    cols = []
    for c in fs.features:
        d = qs.get(c, {})
        med, iqr = d.get(0.5), (d.get(hi, 0.0) or 0.0) - (d.get(lo, 0.0) or 0.0)
        x = F.col(q(c)) - F.lit(med) if med is not None else F.col(q(c))
        cols.append((x / F.lit(iqr) if iqr else x).alias(c))
    return FeatureSet(fs.df.select(*[q(k) for k in fs.keys], *cols), fs.keys, fs.features)


def normalize_rows(fs: FeatureSet) -> FeatureSet:
    """MM9 normalize: each row divided by its L2 norm (zero rows unchanged)."""
    from morphospark.functions.numeric import l2_norm

    df = fs.df.withColumn("_norm", l2_norm(fs.features))
    cols = [F.when(F.col("_norm") == 0, F.col(q(c))).otherwise(F.col(q(c)) / F.col("_norm")).alias(c)
            for c in fs.features]
    return FeatureSet(df.select(*[q(k) for k in fs.keys], *cols), fs.keys, fs.features)


# ---------------------------------------------------------------- MM20
def sigma_clip_report(fs: FeatureSet, sigma: float) -> DataFrame:
    """MM20: per feature max |z| and whether it survives the clip."""
    mom = column_moments(fs.df, fs.features)
    aggs = []
    for i, c in enumerate(fs.features):
        m, s = mom[c]
        z = F.abs((F.col(q(c)) - F.lit(m)) / F.lit(s)) if s else F.lit(0.0)
        aggs.append(F.max(z).alias(f"z{i}"))
    row = fs.df.agg(*aggs).first()
    spark = fs.df.sparkSession
    rows = [(c, float(row[f"z{i}"]) if row[f"z{i}"] is not None else None,
             not (row[f"z{i}"] is not None and row[f"z{i}"] > sigma))
            for i, c in enumerate(fs.features)]
    return spark.createDataFrame(rows, "feature string, max_abs_z double, kept boolean")


def sigma_clip(fs: FeatureSet, sigma: float) -> FeatureSet:
    """MM20: drop every feature that has a value beyond sigma std devs."""
    kept = [r.feature for r in sigma_clip_report(fs, sigma).filter("kept").collect()]
    return FeatureSet(fs.df.select(*[q(k) for k in fs.keys], *[q(c) for c in kept]), fs.keys, tuple(kept))


# ---------------------------------------------------------------- MM7
def value_bounds(fs: FeatureSet) -> dict:
    """{feature: (smallest, largest)}; (None, None) where all values are null."""
    row = fs.df.agg(*[F.min(F.col(q(c)).cast("double")).alias(f"lo{i}") for i, c in enumerate(fs.features)],
                    *[F.max(F.col(q(c)).cast("double")).alias(f"hi{i}") for i, c in enumerate(fs.features)]).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(fs.features)}


def _partition_stats(features, lam_table: dict, bounds: dict):
    """mapInPandas body: per partition and (feature, lambda) the count, mean and
    M2 of the scaled psi(x, lambda), and the lambda-free sum of sign(x)*log1p(|x|)."""
    def run(batches):
        acc = {}
        for pdf in batches:
            for i, c in enumerate(features):
                x = pdf[c].to_numpy(dtype="float64", na_value=np.nan)
                x = x[~np.isnan(x)]
                if x.size == 0:
                    continue
                s = float(np.sum(np.sign(x) * np.log1p(np.abs(x))))
                for j, lam in enumerate(lam_table[c]):
                    y, _ = scaled_psi_np(x, lam, *bounds[c])
                    n_b, m_b = y.size, float(y.mean())
                    m2_b = float(((y - m_b) ** 2).sum())
                    key = (i, j)
                    if key in acc:  # Chan et al. merge; all partitions share the scaling of (feature, lambda)
                        n_a, m_a, m2_a, s_a = acc[key]
                        n = n_a + n_b
                        d = m_b - m_a
                        acc[key] = (n, m_a + d * n_b / n, m2_a + m2_b + d * d * n_a * n_b / n, s_a + s)
                    else:
                        acc[key] = (n_b, m_b, m2_b, s)
        if acc:
            yield pd.DataFrame([(i, j, lam_table[features[i]][j], n, m, m2, s)
                                for (i, j), (n, m, m2, s) in acc.items()],
                               columns=["f", "j", "lam", "n", "mean", "m2", "s"])
    return run


_STATS_SCHEMA = "f int, j int, lam double, n long, mean double, m2 double, s double"


def _loglik(df: DataFrame, features, lam_table: dict, bounds: dict) -> dict:
    """{(feature, j): (lambda, log-likelihood per value)} - one pass over the data."""
    part = df.select(*[F.col(q(c)).cast("double").alias(c) for c in features]) \
        .mapInPandas(_partition_stats(list(features), lam_table, bounds), _STATS_SCHEMA)
    # merge partitions: N, pooled mean, then M2 = sum(M2_i + n_i (mean_i - mean)^2)
    part = stage(part, "loglik")  # a few hundred numbers a partition, read twice
    tot = part.groupBy("f", "j", "lam").agg(
        F.sum("n").alias("tot_n"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("tot_mu"),
        F.sum("s").alias("tot_s"))
    merged = part.join(tot, ["f", "j", "lam"]).groupBy("f", "j", "lam", "tot_n", "tot_s").agg(
        F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("tot_mu")) ** 2).alias("tot_m2"))
    out = {}
    for r in merged.collect():  # features x lambdas rows
        c = features[r.f]
        var = r.tot_m2 / r.tot_n
        t = scaled_psi_np(np.zeros(0), r.lam, *bounds[c])[1]  # logarithm of the factor left out of psi
        ll = -math.inf if var < X_TINY else -0.5 * math.log(var) - t + (r.lam - 1.0) * (r.tot_s / r.tot_n)
        out[(c, r.j)] = (r.lam, ll)
    return out


def yeo_johnson_likelihood(fs: FeatureSet, lambdas) -> DataFrame:
    """(feature, lambda, loglik): log-likelihood per value, without its constant, at the given lambdas."""
    bounds = {c: b for c, b in value_bounds(fs).items() if b[0] is not None and b[0] != b[1]}
    feats, lambdas = [c for c in fs.features if c in bounds], [float(x) for x in lambdas]
    rows = []
    if feats:
        found = _loglik(fs.df, feats, {c: lambdas for c in feats}, bounds)
        rows = [(c, lam, ll) for (c, _), (lam, ll) in found.items()]
    return fs.df.sparkSession.createDataFrame(rows, "feature string, lambda double, loglik double")


#: Times that the scan of a feature may move on; each triples its reach, so that the last one is beyond 1e11.
WIDENINGS = 24


def fit_yeo_johnson(fs: FeatureSet, grid=(-4.0, 6.0), points: int = 17, rounds: int = 4,
                    bounds: dict | None = None) -> dict:
    """Maximum-likelihood lambda per feature (sklearn's objective).

    Round 1 scans ``points`` lambdas on ``grid``.  While the best one of a
    feature is at an end of its scan, the scan moves on beyond that end, twice
    as wide each time (at most ``WIDENINGS`` times, after which the last end is
    the result); then each round scans the bracket around the best one; a final
    parabola through the best point and its neighbours.  Features whose
    variance is 0 get None.
    """
    feats = list(fs.features)
    bounds = value_bounds(fs) if bounds is None else bounds
    constant = {c for c, (lo, hi) in bounds.items() if lo is None or lo == hi}
    feats = [c for c in feats if c not in constant]
    lam_table = {c: list(np.linspace(grid[0], grid[1], points)) for c in feats}
    best: dict = {c: None for c in constant}
    if not feats:
        return {c: None for c in fs.features}
    left = {c: rounds for c in feats}  # scans still due; widening takes none of them
    moves = {c: 0 for c in feats}
    while any(left.values()):
        lam_table = {c: lams for c, lams in lam_table.items() if left[c]}
        feats = list(lam_table)
        ll = _loglik(fs.df, feats, lam_table, bounds)
        new_table = {}
        for c in feats:
            lams = lam_table[c]
            vals = [ll.get((c, j), (lams[j], -math.inf))[1] for j in range(len(lams))]
            if all(v == -math.inf for v in vals):
                best[c], left[c] = None, 0
                continue
            k = int(np.argmax(vals))
            best[c] = (lams, vals, k)
            if k in (0, len(lams) - 1) and left[c] == rounds and moves[c] < WIDENINGS:
                moves[c] += 1
                span = 2 * (lams[-1] - lams[0])
                new_table[c] = list(np.linspace(lams[0] - span, lams[1], points) if k == 0
                                    else np.linspace(lams[-2], lams[-1] + span, points))
                continue
            left[c] -= 1
            lo = lams[max(k - 1, 0)]
            hi = lams[min(k + 1, len(lams) - 1)]
            new_table[c] = list(np.linspace(lo, hi, points))
        lam_table = new_table
    result = {}
    for c in fs.features:
        if best.get(c) is None:
            result[c] = None
            continue
        lams, vals, k = best[c]
        lam = lams[k]
        if 0 < k < len(lams) - 1 and all(np.isfinite([vals[k - 1], vals[k], vals[k + 1]])):
            x0, x1, x2 = lams[k - 1], lams[k], lams[k + 1]
            y0, y1, y2 = vals[k - 1], vals[k], vals[k + 1]
            den = (x0 - x1) * (x0 - x2) * (x1 - x2)
            a = (x2 * (y1 - y0) + x1 * (y0 - y2) + x0 * (y2 - y1)) / den if den else 0.0
            b = (x2 * x2 * (y0 - y1) + x1 * x1 * (y2 - y0) + x0 * x0 * (y1 - y2)) / den if den else 0.0
            if a < 0:
                v = -b / (2 * a)
                if x0 <= v <= x2:
                    lam = float(v)
        result[c] = float(lam)
    return result


def apply_yeo_johnson(fs: FeatureSet, lambdas: dict, standardize: bool = True, bounds: dict | None = None) -> FeatureSet:
    """psi(x, lambda_f) per feature, then (y - mean)/std_pop; a feature with
    no lambda (constant) becomes 0.  What standardising takes out anyway, a
    factor and a constant, is left out beforehand, so that no digits are lost."""
    if standardize and bounds is None:
        bounds = value_bounds(fs)
    cols = []
    for c in fs.features:
        lam, x = lambdas.get(c), F.col(q(c)).cast("double")
        if lam is not None and standardize and bounds[c][0] is not None:
            x = scaled_psi_col(x, lam, *bounds[c])
        elif lam is not None:
            x = yeo_johnson_col(x, lam)
        cols.append(x.alias(c))
    out = FeatureSet(fs.df.select(*[q(k) for k in fs.keys], *cols), fs.keys, fs.features)
    return standard_scale(out) if standardize else out


def power_transform(fs: FeatureSet, **kw) -> tuple[FeatureSet, dict]:
    """MM7: fit + apply (sklearn power_transform(method='yeo-johnson'))."""
    bounds = value_bounds(fs)
    lambdas = fit_yeo_johnson(fs, bounds=bounds, **kw)
    return apply_yeo_johnson(fs, lambdas, bounds=bounds), lambdas


SCALERS = {
    "yeo_johnson": lambda fs: power_transform(fs)[0],
    "standard": standard_scale,
    "robust": robust_scale,
    "normalize": normalize_rows,
}


def scale(fs: FeatureSet, scaler: str = "yeo_johnson") -> FeatureSet:
    """Swappable preprocessor (the reference's ``preprocessor`` lambda)."""
    return SCALERS[scaler](fs)


def mask_beyond_sigma(fs: FeatureSet, sigma: float) -> FeatureSet:
    """P19/MM20 first half: blank values with |z| > sigma (population std)."""
    mom = column_moments(fs.df, fs.features)
    cols = []
    for c in fs.features:
        m, s = mom[c]
        x = F.col(q(c))
        z = (x - F.lit(m)) / F.lit(s) if s else (x - F.lit(m))
        cols.append(F.when(F.abs(z) > sigma, F.lit(None).cast("double")).otherwise(x).alias(c))
    return FeatureSet(fs.df.select(*[q(k) for k in fs.keys], *cols), fs.keys, fs.features)
