"""MM25: permutation importance with one exchange for all features.

Every feature has a keyed permutation of the row numbers (a Feistel network
with cycle walking), so a row knows where each of its values goes without a
sort.  All values, and the row itself, are sent there in one shuffle; the
receiver holds its own row with one strange value for each feature, scores one
variant for each, and a small aggregate compares.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphospark.featureset import FeatureSet, q
from morphospark.operators.ranking import global_rank

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed_permutation(ranks, n: int, seed: int, key: int) -> np.ndarray:
    """Where a keyed permutation of 0..n-1 puts each rank.

    The network permutes a power of four of at least n; a place beyond n is put
    in again until it falls below, which permutes 0..n-1 itself.
    """
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64((seed * 1_000_003 + key * 7919) % 2 ** 63))

    def once(x):
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & mask)
        return (left << half) | right

    out = once(np.asarray(ranks).astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def permuted_rows(fs: FeatureSet, label: str, id_cols, seed: int = 0) -> DataFrame:
    """(row, y, x own values, d values that the permutations put there), one shuffle after the numbering."""
    p = len(fs.features)
    ranked = global_rank(fs.df.select(*[F.col(q(c)).alias(f"_id{i}") for i, c in enumerate(id_cols)],
                                      F.col(q(label)).cast("string").alias("y"),
                                      F.array(*[F.col(q(c)).cast("double") for c in fs.features]).alias("x")),
                         [f"_id{i}" for i in range(len(id_cols))])
    n = ranked.count()

    @F.pandas_udf("array<bigint>")
    def places(ranks):
        import pandas as pd

        r = ranks.to_numpy() - 1
        return pd.Series(list(np.stack([keyed_permutation(r, n, seed, f) for f in range(p)], axis=1)))

    rows = ranked.select("y", "x", (F.col("_grank") - 1).alias("r"), places("_grank").alias("to"))
    own = F.array(F.struct(F.col("r").alias("row"), F.lit(-1).alias("f"), F.lit(None).cast("double").alias("v"), "x", "y"))
    sent = F.transform("to", lambda to, i: F.struct(
        to.alias("row"), i.alias("f"), F.element_at("x", i + 1).alias("v"),
        F.lit(None).cast("array<double>").alias("x"), F.lit(None).cast("string").alias("y")))
    mail = rows.select(F.explode(F.concat(own, sent)).alias("e")).select("e.*")
    strange = F.array_sort(F.collect_list(F.when(F.col("f") >= 0, F.struct("f", "v"))))
    return mail.groupBy("row").agg(F.first("y", True).alias("y"), F.first("x", True).alias("x"), strange.alias("d"))


def permutation_importance(clf, fs: FeatureSet, label: str, id_cols, seed: int = 0) -> DataFrame:
    """(feature, importance): how much the accuracy drops when one feature is permuted."""
    p = len(fs.features)
    got = permuted_rows(fs, label, id_cols, seed).withColumn("f", F.explode(F.sequence(F.lit(-1), F.lit(p - 1))))
    value = F.transform("x", lambda v, i: F.when(i == F.col("f"), F.element_at("d", i + 1)["v"]).otherwise(v))
    wide = got.select("f", F.col("y").alias(label), value.alias("_x")).select(
        "f", q(label), *[F.element_at("_x", i + 1).alias(c) for i, c in enumerate(fs.features)])
    hit = (F.col("predicted") == F.col("_label_str")).cast("double")
    found = {r.f: r.accuracy for r in clf.transform(wide).groupBy("f").agg(F.avg(hit).alias("accuracy")).collect()}
    base = found.get(-1)
    return fs.df.sparkSession.createDataFrame(
        [(c, None if base is None else base - found[i]) for i, c in enumerate(fs.features)], "feature string, importance double")
