"""MM6 isolation forest (Liu, Ting & Zhou, 2008) - Spark ML has none.

Fit: every tree needs psi (256) rows.  A deterministic hash pre-sample of
about ``oversample * T * psi`` rows (independent of the table size) is taken
in one scan; each tree keeps the psi pre-sampled rows with the smallest
hash(row, tree) - a per-tree top-psi over a bounded set - and
``applyInPandas`` grows one tree per group.  The forest (at most T * 511
nodes) is broadcast and a scalar pandas UDF scores the whole table in Arrow
batches: s = 2^(-E[h(x)] / c(psi)); a row is an inlier when s <= 0.5
(scikit-learn's ``contamination="auto"``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphospark.featureset import FeatureSet, q
from morphospark.operators.ranking import hash_order_key

EULER_GAMMA = 0.5772156649015329


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful BST search, c(n)."""
    n = np.asarray(n, dtype="float64")
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _unit_hash(keys, salt) -> "F.Column":
    h = hash_order_key(keys, salt)
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(16 ** 12)


_NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
                "size long, depth int")


def _grow(features, height_limit, seed):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["_tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        X = pdf[list(features)].to_numpy(dtype="float64")
        nodes = []  # (node, feature, threshold, left, right, size, depth)

        def grow(idx, depth):
            node = len(nodes)
            nodes.append(None)
            x = X[idx]
            if depth >= height_limit or len(idx) <= 1:
                nodes[node] = (node, -1, 0.0, -1, -1, len(idx), depth)
                return node
            lo, hi = x.min(axis=0), x.max(axis=0)
            usable = np.flatnonzero(hi > lo)
            if usable.size == 0:
                nodes[node] = (node, -1, 0.0, -1, -1, len(idx), depth)
                return node
            f = int(rng.choice(usable))
            thr = float(rng.uniform(lo[f], hi[f]))
            if thr <= lo[f]:
                thr = float(np.nextafter(lo[f], hi[f]))
            go_left = x[:, f] < thr
            left = grow(idx[go_left], depth + 1)
            right = grow(idx[~go_left], depth + 1)
            nodes[node] = (node, f, thr, left, right, len(idx), depth)
            return node

        grow(np.arange(len(X)), 0)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
        out.insert(0, "tree", tree)
        return out
    return build


class IsolationForestModel:
    """Flat arrays of the forest; ``score`` works on a numpy matrix."""

    def __init__(self, nodes: pd.DataFrame, psi: int, features):
        self.features = list(features)
        self.psi = psi
        self.trees = []
        for _, g in nodes.sort_values(["tree", "node"]).groupby("tree"):
            self.trees.append({k: g[k].to_numpy() for k in ("feature", "threshold", "left", "right", "size", "depth")})
        self.c_psi = float(c_factor([psi])[0])

    def path_lengths(self, X: np.ndarray) -> np.ndarray:
        total = np.zeros(len(X))
        rows = np.arange(len(X))
        for t in self.trees:
            node = np.zeros(len(X), dtype=np.int64)
            while True:
                feat = t["feature"][node]
                inner = feat >= 0
                if not inner.any():
                    break
                ii = rows[inner]
                go_left = X[ii, feat[inner]] < t["threshold"][node[inner]]
                node[ii] = np.where(go_left, t["left"][node[inner]], t["right"][node[inner]])
            total += t["depth"][node] + c_factor(t["size"][node])
        return total / len(self.trees)

    def score(self, X: np.ndarray) -> np.ndarray:
        return np.power(2.0, -self.path_lengths(X) / self.c_psi)


def fit_isolation_forest(fs: FeatureSet, n_trees: int = 100, max_samples: int = 256,
                         seed: int = 0, oversample: float = 4.0, id_cols=None) -> IsolationForestModel:
    """Grow the forest from a bounded hash pre-sample of the rows."""
    df = fs.df
    ids = list(id_cols or fs.keys)
    n = df.count()
    psi = int(min(max_samples, n))
    height = int(math.ceil(math.log2(max(psi, 2))))
    frac = min(1.0, oversample * n_trees * psi / max(n, 1))
    pre = df.select(*[q(c) for c in ids], *[F.col(q(c)).cast("double").alias(c) for c in fs.features]) \
        .withColumn("_u", _unit_hash(ids, f"pre{seed}")).filter(F.col("_u") < F.lit(frac)).drop("_u")
    # every tree ranks the (bounded) pre-sample by its own hash and keeps psi rows
    per_tree = pre.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    per_tree = per_tree.withColumn("_h", hash_order_key(ids + [F.col("_tree")], f"tree{seed}"))
    w = Window.partitionBy("_tree").orderBy("_h")
    sample = per_tree.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= psi)
    nodes = sample.select("_tree", *[q(c) for c in fs.features]) \
        .groupBy("_tree").applyInPandas(_grow(list(fs.features), height, seed), _NODE_SCHEMA)
    return IsolationForestModel(nodes.toPandas(), psi, fs.features)


def score_isolation_forest(fs: FeatureSet, model: IsolationForestModel, out: str = "anomaly_score") -> DataFrame:
    """Add the anomaly score s in (0, 1]; only feature columns go to Python."""
    bc = fs.df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def _score(*cols: pd.Series) -> pd.Series:
        X = np.column_stack([c.to_numpy(dtype="float64", na_value=np.nan) for c in cols])
        return pd.Series(bc.value.score(X))

    return fs.df.withColumn(out, _score(*[F.col(q(c)).cast("double") for c in model.features]))


def isolation_inliers(fs: FeatureSet, n_trees: int = 100, max_samples: int = 256, seed: int = 0,
                      threshold: float = 0.5) -> FeatureSet:
    """MM6 as used: keep rows predicted as inliers (score <= 0.5)."""
    model = fit_isolation_forest(fs, n_trees, max_samples, seed)
    scored = score_isolation_forest(fs, model)
    kept = scored.filter(F.col("anomaly_score") <= threshold).drop("anomaly_score")
    return FeatureSet(kept, fs.keys, fs.features)
