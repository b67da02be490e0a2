"""Drug-to-drug similarity from classifier probabilities (MM2, MM3) and the
post-model table operators (A6, O5, A8, R-4, R-6).

MM3 hoists the reference's inner loop: for each blind drug the training set
({Control, drug}, balanced by W2) does not depend on the scored drug, so one
model per blind drug scores every row once - k fits instead of k^2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphospark.featureset import FeatureSet, q
from morphospark.operators.aggregate import min_over_group
from morphospark.operators.models import Classifier
from morphospark.operators.ranking import balanced_heads, hash_order_key
from morphospark.operators.reshape import pivot
from morphospark.session import concurrently, shuffle_partitions, stage

CONTROL = "Control"


def pair_mean(sim: DataFrame, truth: str = "Drug", pred: str = "Predicted Drug",
              value: str = "Similarity", exclude_self: bool = True) -> DataFrame:
    """Mean similarity per (predicted, truth) pair."""
    if exclude_self:
        sim = sim.filter(F.col(q(truth)) != F.col(q(pred)))
    return sim.groupBy(q(pred), q(truth)).agg(F.avg(F.col(q(value))).alias(value))


def symmetrise_min(pairs: DataFrame, truth: str = "Drug", pred: str = "Predicted Drug",
                   value: str = "Similarity") -> DataFrame:
    """O5 + A8: canonical pair (least, greatest) and the minimum of both
    directions attached to each direction."""
    canon = pairs.withColumn("_a", F.least(F.col(q(truth)), F.col(q(pred)))) \
        .withColumn("_b", F.greatest(F.col(q(truth)), F.col(q(pred))))
    return min_over_group(canon, ["_a", "_b"], value).drop("_a", "_b")


def similarity_square(pairs: DataFrame, truth: str = "Drug", pred: str = "Predicted Drug",
                      value: str = "Similarity", triangle: bool = False, labels=None) -> DataFrame:
    """R-4 (+ R-6): square table, rows = truth, columns = predicted; with
    ``triangle`` the cells above the diagonal are masked (rows are kept)."""
    cols = list(labels) if labels is not None else \
        sorted(r[0] for r in pairs.select(q(pred)).distinct().collect())
    square = pivot(pairs, truth, pred, value, cols)
    if triangle:
        square = square.select(q(truth), *[
            F.when(F.col(q(truth)) >= F.lit(c), F.col(q(c))).alias(c) for c in cols])
    return square


def leave_one_out_similarity(fs: FeatureSet, label: str = "Drug", seed: int = 0, **kw) -> DataFrame:
    """MM2: for each drug, train on the others, class probabilities of the
    held-out rows -> long (keys..., Predicted Drug, Similarity)."""
    labels = sorted(r[0] for r in fs.df.select(q(label)).distinct().collect())
    parts = []
    for d in labels:
        train = FeatureSet(fs.df.filter(F.col(q(label)) != d), fs.keys, fs.features)
        test = FeatureSet(fs.df.filter(F.col(q(label)) == d), fs.keys, fs.features)
        if train.df.select(q(label)).distinct().count() < 1:
            continue
        clf = Classifier(train, label, seed=seed, **kw)
        long = clf.predict_proba_long(test, keep=list(fs.keys)) \
            .withColumnRenamed("class", "Predicted Drug").withColumnRenamed("probability", "Similarity")
        parts.append(long)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pairwise_similarity(fs: FeatureSet, label: str = "Drug", seed: int = 0, order_keys=None,
                        **kw) -> DataFrame:
    """MM3 long table (keys..., Predicted Drug, Similarity) for one cell line.

    For each blind drug d: train {Control, d} with n = min group size rows
    each (W2, hash order), score every row once, keep P(d).  d = Control
    trains a single class, so P = 1 everywhere (Q14).
    """
    labels = sorted(r[0] for r in fs.df.select(q(label)).distinct().collect())
    order_keys = list(order_keys or fs.keys)
    hashed = fs.df.withColumn("_h", hash_order_key(order_keys, seed))
    parts = []
    for d in labels:
        if d == CONTROL:
            parts.append(fs.df.select(*[q(k) for k in fs.keys], F.lit(CONTROL).alias("Predicted Drug"),
                                      F.lit(1.0).alias("Similarity")))
            continue
        pair = hashed.filter(F.col(q(label)).isin(CONTROL, d))
        # The heads come out of a window with as many partitions as labels; the fit wants them dealt out.
        train = balanced_heads(pair, label, ["_h"]).drop("_h").repartition(shuffle_partitions(fs.df.sparkSession))
        clf = Classifier(FeatureSet(train, fs.keys, fs.features), label, seed=seed, **kw)
        long = clf.predict_proba_long(fs, keep=list(fs.keys), classes=[d]) \
            .withColumnRenamed("class", "Predicted Drug").withColumnRenamed("probability", "Similarity")
        parts.append(long)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def similarity_of_lines(fs: FeatureSet, operator, summary, line: str = "Cell", parallel: int = 2, **kw) -> DataFrame:
    """``summary(operator(rows of one line))`` for every value of ``line``, the lines side by side."""
    spark = fs.df.sparkSession
    lines = sorted(r[0] for r in fs.df.select(q(line)).distinct().collect())

    def one(value):
        own = FeatureSet(fs.df.filter(F.col(q(line)) == value), fs.keys, fs.features)
        return stage(summary(operator(own, **kw)), "similarity").withColumn(line, F.lit(value))  # a row a pair of labels

    parts = concurrently(spark, lines, one, parallel, name=lambda v: f"similarity {v}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def similarity_summary(sim_long: DataFrame, truth: str = "Drug") -> DataFrame:
    """MM3 tail: off-diagonal pair means, symmetrised by the minimum."""
    return symmetrise_min(pair_mean(sim_long, truth=truth))
