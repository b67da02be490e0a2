"""MM18: RANSAC linear regression, solved in tasks, with as many trials as the inliers call for.

Every row of a hash pre-sample belongs to one trial; the p+1 of a trial with the
smallest hashes are its minimal subset, and one task a trial solves it.  One
pass over the data counts the inliers of a batch of trials.  After each batch
the best share w of inliers says how many trials find a clean subset with the
wanted confidence, log(1 - confidence) / log(1 - w^(p+1)); batches stop there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphospark.featureset import FeatureSet, q
from morphospark.operators.quantiles import column_quantiles
from morphospark.operators.ranking import hash_order_key
from morphospark.session import stage

#: Rows of the pre-sample for each that a trial needs.
SPARE = 20
#: Determinants below this part of their scale count as zero: the subset decides no line.
SINGULAR = 1e-10


def trials_needed(share: float, size: int, confidence: float) -> float:
    """Trials after which a subset of ``size`` rows without outlier has come up with the given probability."""
    clean = share ** size
    if clean >= 1.0:
        return 1
    return math.inf if clean <= 0.0 else math.log(1 - confidence) / math.log1p(-clean)


def _solve(key, table):
    """Coefficients of the line through the rows of one trial; none if they decide no line."""
    table = table.sort_by("_h")
    names = [c for c in table.schema.names if c.startswith("_x")]
    size = len(names) + 1
    out = []
    if len(table) >= size:
        table = table.slice(0, size)
        a = np.column_stack([np.ones(size), *[table.column(c).to_numpy() for c in names]])
        scaled = a / np.maximum(np.abs(a).max(axis=0), 1e-300)
        if abs(np.linalg.det(scaled)) > SINGULAR:
            out = [np.linalg.solve(a, table.column("_y").to_numpy()).tolist()]
    return pa.table({"trial": pa.array([key[0].as_py()] * len(out), pa.int64()),
                     "beta": pa.array(out, pa.list_(pa.float64()))})


def ransac_inliers(fs: FeatureSet, target: str, id_cols, candidates: int = 100, seed: int = 0,
                   threshold: float | None = None, batch: int = 25,
                   confidence: float = 0.99) -> tuple[DataFrame, dict]:
    """(rows within ``threshold`` of the best line, coefficients of the least-squares line through them).

    ``threshold`` is by default the median absolute deviation of the target;
    ``candidates`` is the largest number of trials.
    """
    p = len(fs.features)
    y = F.col(q(target)).cast("double")
    x = [F.col(q(c)).cast("double") for c in fs.features]
    if threshold is None:
        med = column_quantiles(fs.df, [target], [0.5])[target][0.5]
        threshold = column_quantiles(fs.df.select(F.abs(y - F.lit(med)).alias("_d")), ["_d"], [0.5])["_d"][0.5]
    n = fs.df.count()
    # the pre-sample depends on the trials, not on the rows
    key = hash_order_key(list(id_cols), f"ransac{seed}")
    unit = F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / float(16 ** 12)
    share = min(1.0, SPARE * candidates * (p + 1) / max(n, 1))
    trial = F.pmod(F.conv(F.substring(key, 13, 8), 16, 10).cast("long"), F.lit(candidates))
    sample = stage(fs.df.filter(unit < share).select(
        trial.alias("_trial"), key.alias("_h"), y.alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(x)])
        .filter(" and ".join(f"{c} is not null" for c in ["_y", *[f"_x{i}" for i in range(p)]])), "ransac")
    best, tried, needed = None, 0, math.inf
    while tried < min(candidates, needed):
        upto = min(candidates, tried + batch)
        lines = sample.filter((F.col("_trial") >= tried) & (F.col("_trial") < upto)).groupBy("_trial").applyInArrow(
            _solve, "trial bigint, beta array<double>").orderBy("trial").collect()  # a batch of trials
        if lines:
            fits = [F.abs(y - sum((F.lit(b) * c for b, c in zip(r.beta[1:], x)), F.lit(r.beta[0]))) <= threshold
                    for r in lines]
            counts = fs.df.agg(*[F.count_if(f).alias(f"c{k}") for k, f in enumerate(fits)]).first()
            for k, r in enumerate(lines):
                if best is None or counts[f"c{k}"] > best[0]:
                    best = (counts[f"c{k}"], fits[k], r)
        tried = upto
        if best is not None:
            needed = trials_needed(best[0] / max(n, 1), p + 1, confidence)
    if best is None:
        raise ValueError("no subset of the rows decides a line")
    inliers = fs.df.filter(best[1])
    from morphospark.operators.models import assemble

    model = LinearRegression(featuresCol="_features", labelCol="_y", regParam=0.0, solver="normal").fit(
        assemble(FeatureSet(inliers, fs.keys, fs.features)).withColumn("_y", y))
    return inliers, {"intercept": model.intercept, **dict(zip(fs.features, model.coefficients.toArray().tolist())),
                     "inliers": best[0], "threshold": threshold, "trials": tried, "line": list(best[2].beta)}
