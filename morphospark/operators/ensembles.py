"""MM24: extra trees, bagged trees and soft voting.

Trees grow level by level, all trees at once, two passes over the rows a level.
An open node has a few candidate splits (features drawn at random, thresholds
drawn uniformly between the smallest and largest value of the feature in the
node).  One pass routes the rows down the trees and counts classes on both sides
of every candidate; counts are shuffled by (tree, node), added up, and the best
candidate is found where they meet.  The other notes, in the children of the best
candidates alone, the range of the features that they will draw from: a row is
ordered by its node once, not once a candidate.  What reaches the driver is the
size of the model.

Bagging weighs every row of every tree by a Poisson(1) number from a hash of
the row's keys, so a row carries its own bags and nothing is resampled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphospark.featureset import FeatureSet, q
from morphospark.operators.forest import dealt_partitions
from morphospark.operators.plotdata import poisson1_weights
from morphospark.operators.ranking import hash_order_key
from morphospark.session import stage

#: Classes a tree ensemble may have: each is a column of the partial counts.
MAX_CLASSES = 500
#: Rows handled at a time in a task.
ROWS = 20_000
#: MB of the counts that a task holds; open nodes beyond that take another pass.
MAX_MEMORY_MB = 64


class _Tree:
    """Nodes in arrays: feature (-1 at a leaf), threshold, left child (the right one follows), class counts."""

    def __init__(self):
        self.feature, self.threshold, self.left, self.counts, self.level = [-1], [0.0], [-1], [None], [0]

    def split(self, node, feature, threshold, counts):
        self.feature[node], self.threshold[node], self.left[node] = feature, threshold, len(self.feature)
        for side in counts:
            self.feature.append(-1)
            self.threshold.append(0.0)
            self.left.append(-1)
            self.counts.append(side)
            self.level.append(self.level[node] + 1)
        return self.left[node]

    def arrays(self):
        """Feature, threshold, left child, depth; no value passes the threshold of a leaf, which leads to itself."""
        feature, left = np.array(self.feature, np.intp), np.array(self.left, np.intp)
        leaf = feature < 0
        return (np.where(leaf, 0, feature), np.where(leaf, np.inf, self.threshold),
                np.where(leaf, np.arange(len(left)), left), max(self.level))


def _route(tree, flat: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Leaf (or open node) of every row; ``flat`` holds the rows' values end to end, ``base`` where each begins."""
    feature, threshold, left, depth = tree
    node = np.zeros(len(base), np.intp)
    for _ in range(depth):
        node = left.take(node) + (flat.take(feature.take(node) + base) > threshold.take(node))
    return node


def _best(counts: np.ndarray):
    """(candidate, gain, counts) of the largest decrease of the weighted Gini impurity, the first of equal ones;
    ``counts`` is (candidates, 2, classes)."""
    total, parent = counts.sum(axis=2), counts[0].sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        kept = ((counts ** 2).sum(axis=2) / total).sum(axis=1)
    gain = np.where((total > 0).all(axis=1), kept - (parent ** 2).sum() / parent.sum(), -1.0)
    j = int(np.argmax(gain))
    return j, float(gain[j]), counts[j]


class TreeEnsemble:
    """Averaged trees: fit, probabilities, predictions, accuracy."""

    def __init__(self, fs: FeatureSet, label: str, id_cols, trees: int = 100, max_depth: int = 12,
                 features_per_node: int | None = None, thresholds: int = 1, bag: bool = False,
                 min_split: float = 2.0, seed: int = 0):
        self.features, self.label = list(fs.features), label
        p = len(self.features)
        m = features_per_node or max(1, int(math.sqrt(p)))
        rng = np.random.default_rng(seed)
        names = [f"f{i}" for i in range(p)]
        rows = stage(fs.df.select(
            *[F.col(q(c)).cast("double").alias(f) for c, f in zip(self.features, names)],
            F.col(q(label)).cast("string").alias("y"),
            F.conv(F.substring(hash_order_key(list(id_cols), f"bag{seed}"), 1, 8), 16, 10).cast("long").alias("s"))
            .filter(F.col("y").isNotNull()), "ensemble")
        sizes = {r[0]: r[1] for r in rows.groupBy("y").count().limit(MAX_CLASSES + 1).collect()}
        self.classes = sorted(sizes)
        if len(self.classes) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes")
        c = len(self.classes)
        ends = rows.agg(*[f(x) for x in names for f in (F.min, F.max)]).first()
        self.trees = [_Tree() for _ in range(trees)]

        def draw(lo, hi, chosen):
            """Candidates of a node: thresholds between the ends of the chosen features, none where they meet."""
            return [(f, lo[i] + rng.random() * (hi[i] - lo[i])) for i, f in enumerate(chosen)
                    for _ in range(thresholds) if lo[i] is not None and lo[i] < hi[i]]

        def chosen():
            return rng.choice(p, m, replace=False).tolist()

        # open nodes: tree, node, candidates, the features that each child will draw from
        front = []
        for t in range(trees):
            of = chosen()
            front.append((t, 0, draw([ends[2 * f] for f in of], [ends[2 * f + 1] for f in of], of), (chosen(), chosen())))
        # files are cut by bytes; rows of many trees take long, so each core has its share of them
        rows = rows.withColumn("y", F.array_position(F.array(*[F.lit(y) for y in self.classes]), F.col("y")).cast("int") - 1) \
            .repartition(dealt_partitions(rows, sum(sizes.values()))).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for depth in range(max_depth):
                front = [x for x in front if x[2]]
                if not front or not c:
                    break
                found, grown = self._counts(rows, front, c, m * thresholds, bag), []
                for t, node, candidates, children in front:
                    if (t, node) not in found:
                        continue
                    tree, (j, gain, counts) = self.trees[t], found[t, node]
                    if tree.counts[node] is None:
                        tree.counts[node] = counts.sum(axis=0)
                    if gain <= 1e-12 or tree.counts[node].sum() < min_split:
                        continue
                    left = tree.split(node, *candidates[j], [counts[0], counts[1]])
                    # a pure node stays a leaf
                    grown += [(t, left + side, children[side]) for side in (0, 1) if (counts[side] > 0).sum() > 1]
                if not grown or depth + 1 == max_depth:
                    break
                ends = self._ranges(rows, grown, m, bag)
                front = [(t, node, draw(*ends[t, node], of), (chosen(), chosen())) for t, node, of in grown]
        finally:
            rows.unpersist()
        spark = fs.df.sparkSession
        share = [np.array([x / x.sum() if x is not None and x.sum() else np.full(c, 1 / max(c, 1)) for x in t.counts])
                 for t in self.trees]
        self._model = spark.sparkContext.broadcast([(t.arrays(), s) for t, s in zip(self.trees, share)])

    def _pass(self, rows: DataFrame, nodes, bag: bool, held, note, add, hand_on, kinds: str) -> list:
        """Rows collected from one pass: ``note`` of the rows of a tree in its ``nodes`` (tree, node, arrays...), into
        what ``held`` gives for a tree; then the bytes of a node are merged by ``add`` and ``hand_on`` makes a row of
        (t, node, ...) as in ``kinds``."""
        spark, p, n_trees, by = rows.sparkSession, len(self.features), len(self.trees), {}
        for t, node, *arrays in nodes:
            by.setdefault(t, []).append((node, *arrays))
        plan = []
        for t, some in by.items():
            ids = np.array([x[0] for x in some], np.int32)
            opened = np.full(len(self.trees[t].feature), -1, np.intp)
            opened[ids] = np.arange(len(ids))
            plan.append((t, self.trees[t].arrays(), ids, opened, *[np.array(x) for x in list(zip(*some))[1:]]))
        shared = spark.sparkContext.broadcast(plan)

        def part(batches):
            sums = [held(len(ids)) for _, _, ids, *_ in shared.value]
            for batch in batches:
                for at in range(0, len(batch), ROWS):
                    some = batch.slice(at, ROWS)
                    flat = np.stack([some.column(i).to_numpy(zero_copy_only=False) for i in range(p)], axis=1).ravel()
                    y = some.column(p).to_numpy()
                    weights = np.ascontiguousarray(poisson1_weights(some.column(p + 1).to_numpy(), n_trees).T) if bag else None
                    base = np.arange(0, len(flat), p, dtype=np.intp)
                    for (t, tree, ids, opened, *arrays), own in zip(shared.value, sums):
                        place = opened.take(_route(tree, flat, base))
                        here = np.flatnonzero((place >= 0) & (weights[t] > 0) if bag else place >= 0)
                        if len(here):
                            note(own, place.take(here), flat, base.take(here), y.take(here),
                                 weights[t].take(here) if bag else None, *arrays)
            for (t, _, ids, *_), (own, seen) in zip(shared.value, sums):
                some = np.flatnonzero(seen)
                if len(some):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t] * len(some), pa.int32()), pa.array(ids[some], pa.int32()),
                         pa.array([own[i].tobytes() for i in some], pa.binary())], names=["t", "node", "h"])

        def merge(batches):
            sums = {}
            for batch in batches:
                for t, node, h in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                    own = np.frombuffer(h, np.float64)
                    sums[t, node] = add(sums[t, node], own) if (t, node) in sums else own
            if sums:
                yield pa.RecordBatch.from_pylist([{"t": t, "node": node} | hand_on(h) for (t, node), h in sums.items()], schema)

        schema = pa.schema([("t", pa.int32()), ("node", pa.int32()), *[(x.split()[0], {
            "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}[x.split()[1]]) for x in kinds.split(", ")]])
        found = rows.mapInArrow(part, "t int, node int, h binary").repartition("t", "node").mapInArrow(
            merge, f"t int, node int, {kinds}").collect()  # a row an open node
        shared.destroy()
        return found

    def _counts(self, rows: DataFrame, front, c: int, most: int, bag: bool) -> dict:
        """{(tree, node): (best candidate, its gain, its counts by side and class)} of the nodes that have rows."""
        def held(n):
            return np.zeros((n, most, 2 * c)), np.zeros(n, bool)

        def note(own, at, flat, begin, y, weight, feature, threshold):
            sums, seen = own
            seen[at] = True
            cell = at * (2 * c) + y
            for j in range(most):
                side = flat.take(feature[:, j].take(at) + begin) > threshold[:, j].take(at)
                sums[:, j] += np.bincount(cell + side * c, weight, len(sums) * 2 * c).reshape(len(sums), 2 * c)

        def hand_on(h):
            j, gain, counts = _best(h.reshape(most, 2, c))
            return {"j": j, "gain": gain, "counts": counts.tobytes()}

        def padded(candidates):
            """A candidate without a threshold keeps every row on the left and never wins."""
            some = candidates + [(0, np.inf)] * (most - len(candidates))
            return [f for f, _ in some], [x for _, x in some]

        room = max(1, MAX_MEMORY_MB * 2 ** 20 // (16 * most * c))
        found = {}
        for at in range(0, len(front), room):
            nodes = [(t, node, *padded(candidates)) for t, node, candidates, _ in front[at:at + room]]
            for r in self._pass(rows, nodes, bag, held, note, np.add, hand_on, "j int, gain double, counts binary"):
                found[r.t, r.node] = r.j, r.gain, np.frombuffer(r.counts, np.float64).reshape(2, c)
        return found

    def _ranges(self, rows: DataFrame, nodes, m: int, bag: bool) -> dict:
        """{(tree, node): (lows, highs)} of the features drawn for each of the nodes (tree, node, features)."""
        def held(n):  # lows, and highs with their sign turned: both are smallest values
            return np.full((n, 2 * m), np.inf), np.zeros(n, bool)

        def note(own, at, flat, begin, y, weight, drawn):
            sums, seen = own
            order = np.argsort(at.astype(np.int16) if len(sums) < 2 ** 15 else at, kind="stable")
            at, begin = at.take(order), begin.take(order)
            starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            ids = at.take(starts)
            seen[ids] = True
            for d in range(m):
                values = flat.take(drawn[:, d].take(at) + begin)
                sums[ids, d] = np.minimum(sums[ids, d], np.minimum.reduceat(values, starts))
                sums[ids, m + d] = np.minimum(sums[ids, m + d], -np.maximum.reduceat(values, starts))

        found = {}
        room = max(1, MAX_MEMORY_MB * 2 ** 20 // (16 * m))
        for at in range(0, len(nodes), room):
            for r in self._pass(rows, nodes[at:at + room], bag, held, note, np.minimum, lambda h: {"ends": h.tobytes()},
                                "ends binary"):
                ends = np.frombuffer(r.ends, np.float64)
                found[r.t, r.node] = ends[:m].tolist(), (-ends[m:]).tolist()
        return found

    def predict_proba_long(self, fs_or_df, keep=()) -> DataFrame:
        """(keep..., class, probability): the mean over the trees of the class shares of the leaf."""
        df = fs_or_df.df if isinstance(fs_or_df, FeatureSet) else fs_or_df
        shared = self._model

        @F.pandas_udf("array<double>")
        def proba(rows):
            import pandas as pd

            x = np.stack(rows.to_numpy())
            flat, base = x.ravel(), np.arange(0, x.size, x.shape[1], dtype=np.intp)
            total = sum(share.take(_route(arrays, flat, base), axis=0) for arrays, share in shared.value)
            return pd.Series(list(total / len(shared.value)))

        p = proba(F.array(*[F.col(q(c)).cast("double") for c in self.features]))
        names = F.array(*[F.lit(c) for c in self.classes])
        return df.select(*[q(c) for c in keep], F.posexplode(p).alias("_i", "probability")).select(
            *[q(c) for c in keep], F.element_at(names, F.col("_i") + 1).alias("class"), "probability")


def extra_trees(fs: FeatureSet, label: str, id_cols, **kw) -> TreeEnsemble:
    """One random threshold for each of sqrt(p) random features a node, every row in every tree."""
    return TreeEnsemble(fs, label, id_cols, **kw)


def bagged_trees(fs: FeatureSet, label: str, id_cols, thresholds: int = 4, **kw) -> TreeEnsemble:
    """All features at every node, several thresholds each, trees on Poisson bags of the rows."""
    return TreeEnsemble(fs, label, id_cols, features_per_node=len(fs.features), thresholds=thresholds, bag=True, **kw)


def soft_vote(tables, keys, weights=None) -> DataFrame:
    """(keys..., class, probability): weighted mean of several probability tables.

    A class that a table does not have for a row counts as probability 0 there.
    """
    weights = [1.0] * len(tables) if weights is None else [float(w) for w in weights]
    every = None
    for table, w in zip(tables, weights):
        part = table.select(*[q(k) for k in keys], "class", (F.col("probability") * w).alias("probability"))
        every = part if every is None else every.unionByName(part)
    # dealt by the keys alone: the classes of a row meet, and its most probable one needs no other shuffle
    every = every.repartition(*[q(k) for k in keys])
    return every.groupBy(*[q(k) for k in keys], "class").agg((F.sum("probability") / sum(weights)).alias("probability"))


def most_probable(table: DataFrame, keys) -> DataFrame:
    """(keys..., predicted, probability): the class of the largest probability, the first of equal ones."""
    best = F.min(F.struct((-F.col("probability")).alias("p"), "class")).alias("b")
    # the classes of a row are few: sorted and added up where they meet, not before the shuffle as well
    return table.repartition(*[q(k) for k in keys]).groupBy(*[q(k) for k in keys]).agg(best).select(
        *[q(k) for k in keys], F.col("b.class").alias("predicted"), (-F.col("b.p")).alias("probability"))
