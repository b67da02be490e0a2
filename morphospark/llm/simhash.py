"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Texts become 64-bit fingerprints; equal fingerprints are one row from there on,
so a group of exact copies costs nothing more.  Two fingerprints within
``RADIUS`` bits agree on at least one of ``RADIUS + 1`` 16-bit quarters, so
every link lies inside a tile of fingerprints with equal leading bits of one
quarter.  A tile is ordered by population count and cut into pieces of at most
about ``TILE`` rows; numpy compares pairs of pieces by exclusive-or and bit
counts, and pairs whose population counts differ by more than the radius are
skipped, between pieces as within them.  The number of leading bits follows
the number of fingerprints, up to the whole quarter; beyond that tiles are cut
into more pieces.  No result depends on it.

A tile pair reports a spanning forest of its links, never all pairs, and
components come from star contraction over those links.

Edge cases: a null or empty text has fingerprint zero and is linked like any
other; fewer than ``SHINGLE`` words are one shingle; repeated rows share their
fingerprint and component; a row without doc_id links others like any row, and
a component without any doc_id has a null id; different texts under one doc_id
are not linked by it; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty

SHINGLE = 3
SEED = 42
RADIUS = 3
QUARTER = 16
TILE = 2048
STRIP = 256
#: Shingles hashed at a time.
BLOCK = 65536


def fingerprint(text: str | bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint: a bit is set if it is set in over half the shingle hashes."""
    import xxhash

    # lower() and split() of bytes know ASCII only: A-Z, and space and tab to carriage return.
    words = (text.encode() if isinstance(text, str) else text).lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    n = len(words) - width + 1
    digest = xxhash.xxh64_digest
    total = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at:at + BLOCK + width - 1]
        raw = b"".join([digest(s, SEED) for s in map(b" ".join, zip(*[part[k:] for k in range(width)]))])
        total += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and its fingerprint as a signed long."""
    def run(batches):
        for batch in batches:
            values = [fingerprint(x, shingle) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            fp = pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def _forest(own: np.ndarray, other: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Spanning links between fingerprints of one piece, or of one piece and another."""
    right = own if other is None else other
    every = own if other is None else np.concatenate([own, other])
    shift = 0 if other is None else len(own)
    root = np.arange(len(every))
    found = []
    own_pc = np.bitwise_count(own).astype(np.int64)
    right_pc = np.bitwise_count(right).astype(np.int64)
    own_order, right_order = np.argsort(own_pc, kind="stable"), np.argsort(right_pc, kind="stable")
    right_sorted, right_pc = right[right_order], right_pc[right_order]
    for at in range(0, len(own_order), STRIP):
        rows = own_order[at:at + STRIP]
        lo = np.searchsorted(right_pc, own_pc[rows[0]] - radius, "left")
        hi = np.searchsorted(right_pc, own_pc[rows[-1]] + radius, "right")
        if lo == hi:  # no population count within the radius
            continue
        near = np.bitwise_count(own[rows][:, None] ^ right_sorted[None, lo:hi]) <= radius
        least = 1 if other is None else 0  # a fingerprint of the same piece meets itself
        for k in np.flatnonzero(near.sum(axis=1) > least).tolist():
            x = int(rows[k])
            cols = right_order[lo:hi][near[k]] + shift
            groups, first = np.unique(root[cols], return_index=True)
            new = groups != root[x]
            if new.any():
                found += [(int(every[x]), int(every[y])) for y in cols[first[new]].tolist()]
                joined = np.append(groups[new], root[x])
                root[np.isin(root, joined)] = joined.min()
    return found


def links(fps: DataFrame, ws: Workspace, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v): links that connect every two distinct fingerprints at most ``radius`` bits apart."""
    quarters = radius + 1
    width = 64 // quarters
    n = fps.count()
    bits = min(width, max(0, (max(n, 1) // tile).bit_length()))
    each = fps.select("fp", F.bit_count("fp").alias("pc"), F.explode(F.array(*[
        F.struct(F.lit(q).alias("q"),
                 F.expr(f"shiftrightunsigned(fp, {q * width + width - bits}) & {(1 << bits) - 1}L").alias("lead"))
        for q in range(quarters)])).alias("t")).select("fp", "pc", "t.q", "t.lead")
    # Pieces of a tile: its population counts in order, cut at about `tile` rows; one count may fill several.
    hist = each.groupBy("q", "lead", "pc").count()
    before = F.sum("count").over(W.partitionBy("q", "lead").orderBy("pc").rowsBetween(W.unboundedPreceding, -1))
    cut = hist.select("q", "lead", "pc", F.floor(F.coalesce(before, F.lit(0)) / tile).cast("int").alias("first"),
                      F.ceil(F.col("count") / tile).cast("int").alias("parts"))
    cut = ws.stage(cut, "cut")
    piece = cut.select("q", "lead", "pc", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1))
                       .alias("piece")).groupBy("q", "lead", "piece").agg(
                           F.min("pc").alias("low"), F.max("pc").alias("high"))
    other = piece.select("q", "lead", F.col("piece").alias("b"), F.col("low").alias("b_low"),
                         F.col("high").alias("b_high"))
    pairs = (piece.withColumnRenamed("piece", "a").join(other, ["q", "lead"])
             .filter("a <= b and b_low - high <= {0} and low - b_high <= {0}".format(radius)))
    pairs = ws.stage(pairs.select("q", "lead", "a", "b"), "pairs")
    wanted = pairs.select("q", "lead", F.col("a").alias("piece"), "a", "b").unionByName(
        pairs.filter("a < b").select("q", "lead", F.col("b").alias("piece"), "a", "b"))
    placed = each.join(cut, ["q", "lead", "pc"]).select(
        "q", "lead", "fp", (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).alias("piece"))
    dealt = placed.join(wanted, ["q", "lead", "piece"]).select("q", "lead", "a", "b", "piece", "fp")

    def compare(key, table):
        fp = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        side = table.column("piece").to_numpy()
        a, b = key[2].as_py(), key[3].as_py()
        found = _forest(fp, None, radius) if a == b else _forest(fp[side == a], fp[side == b], radius)
        uv = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"u": pa.array(uv[:, 0], pa.int64()), "v": pa.array(uv[:, 1], pa.int64())})

    return dealt.groupBy("q", "lead", "a", "b").applyInArrow(compare, "u bigint, v bigint")


def star_components(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): the smallest node reachable.

    Alternating large and small stars, each a grouped minimum and a join; the
    edges shrink to stars in a logarithmic number of rounds.
    """
    e = ws.stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .distinct(), f"{name}0")
    mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first()
    for k in range(1, 100):
        if mark[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # Each u now has only smaller neighbours; the small star hangs them all on the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        nxt = ws.stage(small, f"{name}{k}")
        new = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        ws.drop(f"{name}{k - 1}")
        e, done, mark = nxt, new == mark, new
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id linked, directly or over others) of every document.

    Links and components are those of fingerprints; ids come in last, so that
    rows without doc_id carry links too, and rows that share one do not.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    own = ws.stage(fingerprints(docs, shingle), "own")
    reps = ws.stage(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "reps")
    found = ws.stage(links(reps.select("fp"), ws, radius).distinct(), "links")
    ws.drop("cut", "pairs")
    roots = star_components(found, ws)
    placed = reps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    groups = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return own.join(groups.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _node(text: str = "text"):
    return F.md5(text_or_empty(text).cast("binary"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    return components(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _keep_first(docs: DataFrame, own: DataFrame, roots: DataFrame, ws: Workspace) -> DataFrame:
    """One row of each group of texts: the first by doc_id, rows without one last, then by text.

    ``own`` has doc_id and node (the digest of the text) of every row, ``roots`` the root of every linked node.
    """
    # Narrow rows decide; the texts are shuffled once, to the kept rows.
    none = F.col("doc_id").isNull().alias("none")
    first = own.groupBy("node", "doc_id").count().groupBy("node").agg(
        F.min(F.struct(none, "doc_id", "count")).alias("r")).select("node", "r.*")
    grouped = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = grouped.groupBy("root").agg(F.min(F.struct("none", "doc_id")).alias("b"))
    kept = ws.stage(grouped.join(best, "root").filter(F.col("doc_id").eqNullSafe(F.col("b.doc_id"))).select(
        "root", "node", "doc_id", "count"), "firsts")
    tied = kept.groupBy("root").count().filter("count > 1").select("root")
    if tied.limit(1).count():  # several texts with the smallest doc_id: the first text stays
        asked = kept.join(tied, "root", "left_semi").select(F.col("node").alias("__n"), "root")
        least = docs.select(_node().alias("node"), text_or_empty().alias("text")).join(
            asked, F.col("node") == F.col("__n")).groupBy("root").agg(
                F.min(F.struct("text", "node")).getField("node").alias("least"))
        kept = ws.stage(kept.join(least, "root", "left").filter("least is null or least = node").select(
            "root", "node", "doc_id", "count"), "kept")
    # The row goes along as one struct: its columns cannot clash with ours.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _node().alias("node"),
                       F.col("doc_id").alias("own"))
    wanted = kept.select(F.col("node").alias("n"), F.col("doc_id").alias("i"), F.col("count").alias("c"))
    found = rows.join(wanted, (F.col("node") == F.col("n")) & F.col("own").eqNullSafe(F.col("i")))
    if not kept.filter("count > 1").limit(1).count():
        return found.select("row.*")
    again = found.filter("c > 1").groupBy("node").agg(F.min("row").alias("row"))  # rows that repeat a doc_id and its text
    return found.filter("c = 1").select("row.*").unionByName(again.select("row.*"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of op7's links; all columns stay.

    The row with the smallest doc_id stays, rows without one last, then the first by text.
    """
    ws = Workspace(docs.sparkSession, "keep")
    prints = fingerprints(docs.select(F.struct("doc_id", _node().alias("node")).alias("doc_id"), "text"))
    own = ws.stage(prints.select("doc_id.*", "fp"), "own")
    reps = ws.stage(own.groupBy("fp").agg(F.min("node").alias("rep")), "reps")
    found = ws.stage(links(reps.select("fp"), ws).distinct(), "links")
    ws.drop("cut", "pairs")
    far = found.join(reps.toDF("u", "ru"), "u").join(reps.toDF("v", "rv"), "v").select("ru", "rv").toDF("u", "v")
    same = own.select("fp", "node").distinct().join(reps, "fp").select("node", "rep").filter("node <> rep").toDF("u", "v")
    return _keep_first(docs, own.select("doc_id", "node"), star_components(far.unionByName(same), ws), ws)
