"""Merkle manifest of a dataset with octopus multiproofs.

Every row is a leaf.  The leaves of one source, by ascending ``doc_id``, are
hashed upwards in runs of ``ARITY`` to the source's subroot; the subroots, in
bytewise order of their sources, are the leaves of one more tree, whose root
stands for the dataset.

Positions come from one range sort: each partition numbers its own rows source
by source, and only the source that a partition begins with can have rows in
earlier ones, so one carried number a partition completes them.  A source of
any size is then cut into blocks of ``ARITY ** BLOCK_LEVELS`` consecutive
leaves.  A block grows its own subtree; the few nodes above are grouped by
Spark, level by level.

Proofs are made block by block.  A block of wanted leaves computes which nodes
none of them can derive (``missing``), the union over all its leaves without
repeats; one join fetches those; the block then derives the interior nodes its
leaves share and writes out every single proof.

Edge cases: a null field is ``-``; rows with a null ``doc_id`` come first, rows
that share one follow by their leaf digest, and equal rows are leaves each; a
null ``source`` is a source of its own, the first; a lone leaf is its subroot,
a lone subroot the root, and a proof without siblings is the digest of the
empty text; a document without ``doc_id`` is never tampered with; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphospark.session import shuffle_partitions

from .common import Workspace

ARITY = 16
SHIFT = 4
#: Levels of the subtree that one task grows: a block has 16 ** 3 leaves.
BLOCK_LEVELS = 3
#: Rows of a range partition of the position sort.
RANGE_ROWS = 1_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(values: dict[str, Column]) -> Column:
    """H of the fields: ``-`` for null, else byte count, colon and value."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
             for v in (values[f].cast("string") for f in FIELDS)]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree (the source, null first), doc_id, leaf, and the leaf after tampering where the row is tampered with."""
    own = {f: F.col(f) for f in FIELDS}
    lower = own | {"text": F.translate("text", _UPPER, _LOWER)}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    return docs.select(F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")).alias("tree"), "doc_id",
                       leaf_digest(own).alias("leaf"), F.when(chosen, leaf_digest(lower)).alias("bad"))


def positions(rows: DataFrame, order: list, ws: Workspace, name: str) -> DataFrame:
    """``k``: position of each row within its ``tree`` (from 0), in ``order``; no window, no task per tree."""
    spark = rows.sparkSession
    n = max(shuffle_partitions(spark), -(-rows.count() // RANGE_ROWS))
    columns = rows.columns
    at = columns.index("tree")

    def number(batches):
        pid = TaskContext.get().partitionId()
        first = last = None
        k = 0
        for batch in batches:
            local, head = [], []
            for tree in batch.column(at).to_pylist():
                k = k + 1 if tree == last else 0
                last = tree
                first = tree if first is None else first
                local.append(k)
                head.append(tree == first)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([pid] * len(local), pa.int32()), pa.array(local, pa.int64()),
                 pa.array(head, pa.bool_())], names=[*columns, "pid", "k", "head"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    order = [F.col("tree").asc(), *order]
    done = ws.stage(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        number, f"{fields}, pid int, k bigint, head boolean"), name)
    carries, tree, held = [], None, 0
    for r in sorted(done.groupBy("pid").agg(F.min("tree").alias("a"), F.max(F.struct("tree", "k")).alias("z")).collect()):
        carry = held if r.a == tree else 0
        carries.append((r.pid, carry))
        tree, held = r.z.tree, r.z.k + 1 + (carry if r.a == r.z.tree else 0)
    carried = F.broadcast(spark.createDataFrame(carries, "pid int, carry bigint"))  # one row a partition
    return done.join(carried, "pid").withColumn("k", F.col("k") + F.when(F.col("head"), F.col("carry")).otherwise(0)) \
        .select(*columns, "k").withColumn("block", F.shiftright("k", SHIFT * BLOCK_LEVELS))


def _runs(nodes: list[str]) -> list[str]:
    return [digest("".join(nodes[i:i + ARITY])) for i in range(0, len(nodes), ARITY)]


def _grow(key, table):
    """Interior nodes of one block; ``leaves`` is set on the block's top node alone."""
    tree, block = key[0].as_py(), key[1].as_py()
    nodes = table.sort_by("k").column("digest").to_pylist()
    alone = block == 0 and len(nodes) < ARITY ** BLOCK_LEVELS  # no further block of this tree
    size, level, out = len(nodes), 0, []
    while level < BLOCK_LEVELS and not (alone and len(nodes) == 1):
        nodes, level = _runs(nodes), level + 1
        first = block << SHIFT * (BLOCK_LEVELS - level)
        out += [(level, first + i, x, None) for i, x in enumerate(nodes)]
    out = (out or [(0, 0, nodes[0], None)])
    out[-1] = (*out[-1][:3], size)
    cols = list(zip(*out))
    return pa.table({"tree": pa.array([tree] * len(out), pa.string()), "level": pa.array(cols[0], pa.int32()),
                     "idx": pa.array(cols[1], pa.int64()), "digest": pa.array(cols[2], pa.string()),
                     "leaves": pa.array(cols[3], pa.int64())})


def forest(rows: DataFrame, ws: Workspace, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trees over rows (tree, k, block, digest).

    Returns the interior nodes (tree, level, idx, digest), the blocks with the
    number of leaves of their tree (tree, block, size), and the roots (tree, digest).
    """
    low = ws.stage(rows.select("tree", "block", "k", "digest").groupBy("tree", "block").applyInArrow(
        _grow, "tree string, level int, idx bigint, digest string, leaves bigint"), f"{name}-low")
    tops = low.filter("leaves is not null")
    sizes = tops.groupBy("tree").agg(F.sum("leaves").alias("size"), F.count("*").alias("width"))
    blocks = ws.stage(tops.join(sizes, "tree").select(
        "tree", F.col("idx").alias("block"), "digest", "size", "width"), f"{name}-blocks")
    nodes = [low.filter("level > 0").select("tree", "level", "idx", "digest")]
    roots = [blocks.filter("width = 1").select("tree", "digest")]
    current = blocks.filter("width > 1").select("tree", F.col("block").alias("idx"), "digest", "width")
    widest, level = blocks.agg(F.max("width")).first()[0] or 0, BLOCK_LEVELS
    while widest > 1:
        level += 1
        widest = -(-widest // ARITY)
        run = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        current = ws.stage(current.groupBy("tree", F.shiftright("idx", SHIFT).alias("run"), "width").agg(
            F.sha2(F.concat_ws("", run.getField("digest")), 256).alias("digest")).select(
                "tree", F.col("run").alias("idx"), "digest", F.ceil(F.col("width") / ARITY).alias("width")),
            f"{name}-{level}")
        nodes.append(current.select("tree", F.lit(level).alias("level"), "idx", "digest"))
        roots.append(current.filter("width = 1").select("tree", "digest"))
        current = current.filter("width > 1")
    every, ends = nodes[0], roots[0]
    for x in nodes[1:]:
        every = every.unionByName(x)
    for x in roots[1:]:
        ends = ends.unionByName(x)
    return every, blocks.select("tree", "block", "size"), ends


def missing(wanted: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """(level, positions) of the nodes that proofs of the wanted leaves need and cannot derive: the octopus."""
    out, known, level = [], np.unique(wanted), 0
    while size > 1:
        runs = np.unique(known >> SHIFT)
        members = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        lacking = np.setdiff1d(members[members < size], known, assume_unique=True)
        if len(lacking):
            out.append((level, lacking))
        known, size, level = runs, -(-size // ARITY), level + 1
    return out


class Paths:
    """Proofs of the wanted leaves of one tree, from their digests and the fetched nodes."""

    def __init__(self, wanted: dict[int, str], fetched: dict[tuple[int, int], str], size: int):
        self.levels, self.memo, self.size = [], {}, size
        known = dict(wanted)
        level = 0
        while size > 1:
            at = known | {i: x for (lv, i), x in fetched.items() if lv == level}
            self.levels.append((at, size))
            known = {r: digest("".join(at[i] for i in range(r * ARITY, min(size, r * ARITY + ARITY))))
                     for r in {i >> SHIFT for i in known}}
            size, level = -(-size // ARITY), level + 1
        self.root = next(iter(known.values()))

    def steps(self, k: int, level: int = 0) -> list[tuple[str, str]]:
        """(digests before, digests after) of the node on the way up, level by level; shared above the leaves."""
        if level == len(self.levels):
            return []
        if (level, k) not in self.memo:
            at, size = self.levels[level]
            r = k >> SHIFT
            here = ("".join(at[i] for i in range(r * ARITY, k)),
                    "".join(at[i] for i in range(k + 1, min(size, r * ARITY + ARITY))))
            found = [here, *self.steps(r, level + 1)]
            if level == 0:
                return found
            self.memo[level, k] = found
        return self.memo[level, k]


def fold(node: str, steps) -> str:
    """The root that a leaf and the siblings of its proof lead to."""
    for before, after in steps:
        node = digest(f"{before}{node}{after}")
    return node


def _fetch(wanted: DataFrame, blocks: DataFrame, nodes: DataFrame, level0: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(tree, block, level, idx, digest): what each block of wanted leaves cannot derive."""
    def lacking(key, table):
        found = missing(table.column("k").to_numpy(), table.column("size")[0].as_py())
        n = [len(idx) for _, idx in found]
        total = sum(n)
        return pa.table({
            "tree": pa.array([key[0].as_py()] * total, pa.string()),
            "block": pa.array([key[1].as_py()] * total, pa.int64()),
            "level": pa.array(np.repeat(np.array([lv for lv, _ in found], np.int32), n), pa.int32()),
            "idx": pa.array(np.concatenate([idx for _, idx in found]) if found else [], pa.int64())})

    asked = ws.stage(wanted.select("tree", "block", "k").join(blocks, ["tree", "block"]).groupBy("tree", "block")
                     .applyInArrow(lacking, "tree string, block bigint, level int, idx bigint"), f"{name}-asked")
    if asked.filter("level = 0").limit(1).count():  # only where not all leaves of a run are wanted
        nodes = nodes.unionByName(level0.select("tree", F.lit(0).alias("level"), F.col("k").alias("idx"), "digest"))
    return asked.join(nodes, ["tree", "level", "idx"]).select("tree", "block", "level", "idx", "digest")


_PROOF = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
_STEPS = "array<struct<before:string,after:string>>"


class Manifest:
    """The trees of a table: leaves with their positions, interior nodes, subroots and root."""

    def __init__(self, docs: DataFrame):
        self.ws = ws = Workspace(docs.sparkSession, "merkle")
        own = ws.stage(leaves(docs), "leaves")
        self.leaves = positions(own, [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()], ws, "placed")
        level0 = self.leaves.withColumnRenamed("leaf", "digest")
        self.nodes, self.blocks, roots = forest(level0, ws, "source")
        self.subroots = ws.stage(roots, "subroots")
        # The subroots are the leaves of the tree above; its steps are the same for all rows of a source.
        upper = positions(self.subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"),
                          [F.col("source").asc()], ws, "above")
        nodes, blocks, self.root = forest(upper, ws, "above")
        fetched = _fetch(upper, blocks, nodes, upper, ws, "above")

        def write(key, left, right):
            ks, names, own = (left.column(c).to_pylist() for c in ("k", "source", "digest"))
            paths = Paths(dict(zip(ks, own)), _fetched(right), _size(right))
            return pa.table({
                "tree": pa.array(names, pa.string()), "subroot": pa.array(own, pa.string()),
                "root": pa.array([paths.root] * len(ks), pa.string()),
                "steps": pa.array([[{"before": b, "after": a} for b, a in paths.steps(k)] for k in ks],
                                  pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))})

        heads = blocks.select("tree", "block", F.lit(-1).alias("level"), F.col("size").alias("idx"),
                              F.lit(None).cast("string").alias("digest"))
        self.above = ws.stage(upper.select("tree", "block", "k", "source", "digest").groupBy("tree", "block").cogroup(
            heads.unionByName(fetched).groupBy("tree", "block")).applyInArrow(
                write, f"tree string, subroot string, root string, steps {_STEPS}"), "steps")

    def proofs(self, wanted: DataFrame | None = None) -> DataFrame:
        """Proof of every wanted row of ``leaves`` (all by default), folded from its tampered leaf where it has one."""
        wanted = self.leaves if wanted is None else wanted
        fetched = _fetch(wanted, self.blocks, self.nodes, self.leaves.withColumnRenamed("leaf", "digest"), self.ws, "rows")
        heads = self.blocks.join(self.above, "tree").select(
            "tree", "block", F.lit(-1).alias("level"), F.col("size").alias("idx"),
            F.lit(None).cast("string").alias("digest"), "subroot", "root", "steps")
        side = heads.unionByName(fetched, allowMissingColumns=True)
        kind = wanted.schema["doc_id"].dataType.simpleString()

        def write(key, left, right):
            if not len(left):  # a block of which no leaf is wanted
                text = pa.array([], pa.string())
                return pa.table([left.column("doc_id"), *[text] * 5, pa.array([], pa.bool_())], names=_PROOF)
            ks, own, bad = (left.column(c).to_pylist() for c in ("k", "leaf", "bad"))
            paths = Paths(dict(zip(ks, own)), _fetched(right), _size(right))
            head = right.filter(pc.equal(right.column("level"), -1))
            above = [(s["before"], s["after"]) for s in head.column("steps")[0].as_py()]
            subroot, root = head.column("subroot")[0].as_py(), head.column("root")[0].as_py()
            tail = "".join(b + a for b, a in above)
            shared = fold(paths.root, above)  # what every leaf as it stands leads to
            proof, folded = [], []
            for k, x in zip(ks, bad):
                steps = paths.steps(k)
                proof.append(digest("".join([b + a for b, a in steps]) + tail))
                folded.append(shared if x is None else fold(fold(x, steps), above))
            n = len(ks)
            return pa.table({
                "doc_id": left.column("doc_id"), "leaf": left.column("leaf"), "subroot": pa.array([subroot] * n),
                "root": pa.array([root] * n), "proof_sha256": pa.array(proof), "folded_root": pa.array(folded),
                "verified": pa.array([x == root for x in folded])})

        return wanted.select("tree", "block", "k", "doc_id", "leaf", "bad").groupBy("tree", "block").cogroup(
            side.groupBy("tree", "block")).applyInArrow(
                write, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, "
                       "folded_root string, verified boolean")


def _size(side) -> int:
    return side.filter(pc.equal(side.column("level"), -1)).column("idx")[0].as_py()


def _fetched(side) -> dict[tuple[int, int], str]:
    side = side.filter(pc.not_equal(side.column("level"), -1))
    return dict(zip(zip(side.column("level").to_pylist(), side.column("idx").to_pylist()),
                    side.column("digest").to_pylist()))


def audit(docs: DataFrame) -> DataFrame:
    """Every row with its leaf, subroot, root and proof, and what its proof leads to after the tampering."""
    return Manifest(docs).proofs()
