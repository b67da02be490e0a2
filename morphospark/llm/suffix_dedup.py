"""Repeated byte strings by a logarithmic family of suffix-array indexes.

A byte goes if a ``MATCH``-byte string that covers it also starts elsewhere, in
the same document or another.  Only suffixes that can matter are indexed:

1. Equal texts become one row, bucketed by the hash of the text, so that the
   later joins on it move no text.
2. Every ``MATCH``-byte window has an anchor, the smallest hash among its
   ``GRAM``-byte strings.  Neighbouring windows share theirs, and equal windows
   have the same anchor at the same place.  Windows whose anchor hash is unique
   in the corpus cannot repeat and end here; the others go on as *stretches*,
   the text of neighbouring windows with one anchor.
3. Equal stretches are one row with a count; a count of two or more settles all
   their windows.  Stretches that are the only one of their anchor end here.
4. Where an anchor has several stretches, the suffixes at their window starts
   are indexed: each batch of documents gets suffix arrays (sorted to ``MATCH``
   bytes), one for every part of the anchor space; these are
   merge-scanned against the suffix arrays of each existing level, equal
   neighbours being matches; then levels of equal size are merged in order, so
   there are logarithmically many of them.
5. Matches become byte ranges of documents, and the rest is hashed.

A very common anchor (a passage shared by a third of all documents, say) has too
many stretches for one part.  Its windows are halved by their place relative to
the anchor, again and again: windows of one half share more bytes around the
anchor, so stretches that differ there fall apart into groups of their own,
until every group fits a part or holds a single window position, where equal
windows are simply counted.  Nothing is capped.

Edge cases: a null text is empty; a text shorter than ``MATCH`` loses nothing;
repeated rows, ids included, are copies of each other; long texts are read in
overlapping blocks; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphospark.session import shuffle_partitions

from .common import Workspace, text_or_empty

MATCH = 200
GRAM = 48
#: Windows are looked at in blocks of so many bytes of a text.
BLOCK = 1 << 20
#: Bytes of stretches for one part of the index, and batches in which a table is indexed.
PART_BYTES = 1 << 18
BATCHES = 4
#: Bytes of a row group of a level's table; a level has a row of up to megabytes a part.
GROUP_BYTES = 16 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOW = np.uint64(BLOCK * 2 - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


_TABLES: dict = {}


def _tables():
    if not _TABLES:
        n = BLOCK + MATCH + 1
        inverse = pow(int(_BASE), -1, 1 << 64)
        _TABLES["byte"] = _mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
        one = np.ones(1, np.uint64)
        for name, base in (("power", _BASE), ("inverse", np.uint64(inverse))):
            _TABLES[name] = np.concatenate((one, np.cumprod(np.full(n, base, np.uint64))))
    return _TABLES["byte"], _TABLES["power"], _TABLES["inverse"]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours, by running minima from both ends of blocks of ``w``."""
    n = len(x)
    pad = -n % w
    full = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def stretches(data: bytes):
    """(start, end, anchor offset, anchor hash) arrays of the stretches of a text, in order.

    A stretch covers the windows that start from ``start`` to ``end - MATCH``.
    """
    byte, power, inverse = _tables()
    found = []
    for at in range(0, max(0, len(data) - MATCH + 1), BLOCK):
        raw = np.frombuffer(data, np.uint8, min(len(data), at + BLOCK + MATCH - 1) - at, at)
        n = len(raw)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(byte[raw] * power[:n], out=total[1:])
        h = _mix((total[GRAM:] - total[:-GRAM]) * inverse[:n - GRAM + 1])
        least = _sliding_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), MATCH - GRAM + 1)
        anchor = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        last = np.append(first[1:], len(anchor)) - 1
        found.append((first + at, last + at + MATCH, anchor[first] - first, h[anchor[first]].view(np.int64)))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def _text_keys(text: Column) -> list[Column]:
    """120 bits of the SHA-256 of the text, as two longs."""
    sha = F.sha2(text, 256)
    return [F.conv(F.substring(sha, a, 15), 16, 10).cast("long").alias(k) for a, k in ((1, "k1"), (16, "k2"))]


def _anchors(texts: DataFrame) -> DataFrame:
    """k1, k2, hs: the anchor hash of every stretch of a text."""
    def run(batches):
        for batch in batches:
            rows = [stretches(x)[3] for x in batch.column(2).cast(pa.binary()).to_pylist()]
            sizes = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
            values = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values, pa.int64()))],
                names=["k1", "k2", "hs"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "k1 bigint, k2 bigint, hs array<bigint>")


_PLACED = ("h bigint, s1 bigint, s2 bigint, a int, size int, k1 bigint, k2 bigint, start bigint, copies bigint, "
           "body binary")


def _placed(texts: DataFrame) -> DataFrame:
    """Stretches of the texts (k1, k2, text, copies, hs) whose anchor hash is in ``hs``.

    A task sends the bytes of equal stretches once; s1, s2 identify them.
    """
    def run(batches):
        import xxhash

        sent: set = set()
        for batch in batches:
            rows = []
            for k1, k2, data, copies, hs in zip(
                    *(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2).cast(pa.binary()).to_pylist(),
                    *(batch.column(i).to_pylist() for i in (3, 4))):
                first, last, a, h = stretches(data)
                for i in np.flatnonzero(np.isin(h, np.array(hs, np.int64))).tolist():
                    body = data[first[i]:last[i]]
                    both = xxhash.xxh3_128_digest(body)
                    s1, s2 = (int.from_bytes(x, "big", signed=True) for x in (both[:8], both[8:]))
                    if len(sent) > 500_000:
                        sent.clear()
                    new = s1 not in sent
                    sent.add(s1)
                    rows.append((int(h[i]), s1, s2, int(a[i]), len(body), k1, k2, int(first[i]), copies,
                                 body if new else None))
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    def _batch(rows):
        cols = list(zip(*rows)) or [()] * 10
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 4 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                          names="h s1 s2 a size k1 k2 start copies body".split())

    return texts.mapInArrow(run, _PLACED)


# -- suffix arrays of one part --------------------------------------------------------------------------

def _windows(rows):
    """Concatenated bodies of (body, a, p, q) rows, and for each window its place there, row and offset from the
    anchor.  A row covers the offsets p <= l < q; its window l starts l bytes before its anchor."""
    text, place, owner, offset, base = [], [], [], [], 0
    for i, (body, a, p, q) in enumerate(rows):
        low, high = max(p, MATCH - (len(body) - a)), min(q, a + 1)
        if low < high:
            ls = np.arange(low, high)
            place.append(base + a - ls)
            owner.append(np.full(len(ls), i))
            offset.append(ls)
        text.append(body)
        base += len(body)
    join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return np.frombuffer(b"".join(text), np.uint8), join(place), join(owner), join(offset)


def _strings(text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The MATCH bytes at each place, as fixed-length strings that numpy compares byte by byte."""
    if not len(place):
        return np.zeros(0, f"S{MATCH}")
    return np.lib.stride_tricks.sliding_window_view(text, MATCH)[place].view(f"S{MATCH}").ravel()


def _equal_next(s: np.ndarray) -> np.ndarray:
    """True for the members of a sorted array that equal a neighbour."""
    same = s[1:] == s[:-1]
    return np.concatenate(([False], same)) | np.concatenate((same, [False]))


def _in(sorted_s: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Which of ``s`` stand in the sorted array: the merge scan of two sorted arrays."""
    if not len(sorted_s) or not len(s):
        return np.zeros(len(s), bool)
    at = np.minimum(np.searchsorted(sorted_s, s), len(sorted_s) - 1)
    return sorted_s[at] == s


_KINDS = {"place": np.int32, "size": np.int32, "a": np.int32, "s1": np.int64, "s2": np.int64}
_LEVEL = "part bigint, body binary, " + ", ".join(f"{c} binary" for c in _KINDS)
_HIT = "s1 bigint, s2 bigint, lo int, hi int"
_FIELDS = "s1: bigint, s2: bigint, lo: int, hi: int"


class Level:
    """The suffix array of one part: the bodies of its stretches end to end, and places there in the order of their
    suffixes.  A stretch has a size, an anchor offset a and a name s1, s2; a place tells its stretch by the sizes."""

    def __init__(self, text, place, size, a, s1, s2):
        self.text, self.place, self.size, self.a, self.s1, self.s2 = text, place, size, a, s1, s2
        self.strings = _strings(text, place)

    @classmethod
    def build(cls, t: pa.Table):
        rows = list(zip(*(t.column(c).to_pylist() for c in ("body", "a", "p", "q"))))
        text, place, _, _ = _windows(rows)
        order = np.argsort(_strings(text, place), kind="stable")
        return cls(text, place[order], np.array([len(r[0]) for r in rows], np.int64),
                   *(t.column(c).to_numpy() for c in ("a", "s1", "s2")))

    @classmethod
    def load(cls, batch, i):
        text = np.frombuffer(batch.column("body")[i].as_buffer(), np.uint8)
        return cls(text, *(np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in _KINDS.items()))

    @classmethod
    def merge(cls, x, y):
        """Both arrays are sorted, so the places of one in the other give the order of the two."""
        at = np.searchsorted(x.strings, y.strings, "right")
        place = np.insert(x.place.astype(np.int64), at, y.place.astype(np.int64) + len(x.text))
        return cls(np.concatenate([x.text, y.text]), place,
                   *(np.concatenate([getattr(x, c), getattr(y, c)]) for c in ("size", "a", "s1", "s2")))

    def table(self, part) -> pa.Table:
        return pa.table({"part": pa.array([part], pa.int64()), "body": pa.array([self.text.tobytes()], pa.binary()),
                         **{c: pa.array([np.asarray(getattr(self, c)).astype(t).tobytes()], pa.binary())
                            for c, t in _KINDS.items()}})

    def hits(self, which) -> pa.Table:
        """Byte ranges, relative to their stretch, of the windows in ``which``."""
        place = self.place[which].astype(np.int64)
        ends = np.cumsum(self.size, dtype=np.int64)
        owner = np.searchsorted(ends, place, "right")
        s1, s2, lo = self.s1[owner], self.s2[owner], place - (ends - self.size)[owner]
        order = np.lexsort((lo, s2, s1))
        s1, s2, lo = s1[order], s2[order], lo[order]
        new = np.concatenate(([True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]) | (lo[1:] > lo[:-1] + 1)))[:len(lo)]
        first = np.flatnonzero(new)
        last = (np.append(first[1:], len(lo)) - 1).astype(np.int64) if len(first) else first
        return pa.table({"s1": pa.array(s1[first], pa.int64()), "s2": pa.array(s2[first], pa.int64()),
                         "lo": pa.array(lo[first], pa.int32()), "hi": pa.array(lo[last] + MATCH, pa.int32())})


_NO_HITS = pa.table({"s1": pa.array([], pa.int64()), "s2": pa.array([], pa.int64()), "lo": pa.array([], pa.int32()),
                     "hi": pa.array([], pa.int32())})


class SuffixIndex:
    """Levels of suffix arrays, one row per part of the anchor space in each."""

    def __init__(self, ws: Workspace):
        self.ws, self.levels, self.n = ws, [], 0  # levels: (batches held, label, DataFrame)

    def add(self, batch: DataFrame, last: bool = False) -> list[DataFrame]:
        """Index a batch of stretches (part, s1, s2, a, body, p, q); hits within it and against all earlier ones."""
        def build(key, t):
            x = Level.build(t)
            own = x.hits(_equal_next(x.strings)).to_struct_array().combine_chunks()
            own = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            return x.table(key[0].as_py()).append_column("own", own)

        self.n += 1
        label = f"level{self.n}"
        built = self._staged(batch.groupBy("part").applyInArrow(build, f"{_LEVEL}, own array<struct<{_FIELDS}>>"), label)
        fresh = built.drop("own")

        def scan(left, right):
            if not left.num_rows or not right.num_rows:
                return _NO_HITS
            x, y = Level.load(left, 0), Level.load(right, 0)
            return pa.concat_tables([x.hits(_in(y.strings, x.strings)), y.hits(_in(x.strings, y.strings))])

        hits = [built.select(F.inline("own"))]
        for _, _, level in self.levels:
            hits.append(fresh.groupBy("part").cogroup(level.groupBy("part")).applyInArrow(scan, _HIT))
        hits = [self.ws.stage(x, f"hits{self.n}_{i}") for i, x in enumerate(hits)]
        self.levels.append((1, label, fresh))

        def merge(key, t):
            levels = [Level.load(t, i) for i in range(t.num_rows)]
            return (levels[0] if len(levels) == 1 else Level.merge(*levels)).table(key[0].as_py())

        while not last and len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, old, x), (m, new, y) = self.levels[-2:]
            both = f"{old}_{new}"
            merged = self._staged(x.unionByName(y).groupBy("part").applyInArrow(merge, _LEVEL), both)
            self.ws.drop(old, new)
            self.levels[-2:] = [(n + m, both, merged)]
        return hits

    def _staged(self, level: DataFrame, label: str) -> DataFrame:
        return self.ws.stage(level, label, GROUP_BYTES)

    def close(self):
        self.ws.drop(*[label for _, label, _ in self.levels])


# -- groups too large for a part --------------------------------------------------------------------------

def _core() -> Column:
    """Hash of the bytes that all windows at offsets p <= l < q from the anchor share."""
    return F.md5(F.expr("substring(body, a - p + 1, p + %d - (q - 1))" % MATCH))


def _grouped(rows: DataFrame, ws: Workspace, part_bytes: int):
    """Stretches with a group id whose bytes fit a part, ranges of windows settled by counting alone, and the
    labels of the staged tables that both read.

    A group starts as all stretches of an anchor with all their windows, and
    ends here if it has one only; one that is too large is halved by window
    offset, and stretches are regrouped by the bytes that the windows of their
    half share.  A turn leaves one table, so that its files stay few.
    """
    widest = MATCH - GRAM + 1
    rows = rows.withColumns({"p": F.lit(0), "q": F.lit(widest), "core": F.lit("")})
    ready, counted, labels = [], [], []
    key = ["h", "p", "q", "core"]
    for turn in range(12):
        labels.append(f"turn{turn}")
        # Kept for the one join, so that it has a shuffle of its own on both sides and Spark can split a large group.
        sizes = rows.groupBy(*key).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).filter("n > 1").select(
            *key, (F.col("bytes") > part_bytes).alias("large")).persist(StorageLevel.DISK_ONLY)
        joined = ws.stage(rows.join(sizes, key), f"turn{turn}")
        sizes.unpersist()
        ready.append(joined.filter(~F.col("large") & (F.col("q") - F.col("p") > 1)).drop("large"))
        # One window offset left: the group is the window, and it has two or more members.
        counted.append(joined.filter("q - p = 1").select(
            "s1", "s2", (F.col("a") - F.col("p")).alias("lo"), (F.col("a") - F.col("p") + MATCH).alias("hi")))
        if not joined.filter("large and q - p > 1").limit(1).count():
            break
        half = F.expr("p + (q - p) div 2").cast("int")
        big = joined.filter("large and q - p > 1").drop("large").withColumn("half", F.explode(F.array(
            F.struct(F.col("p").alias("p"), half.alias("q")), F.struct(half.alias("p"), F.col("q").alias("q")))))
        big = big.withColumns({"p": F.col("half.p"), "q": F.col("half.q")}).drop("half")
        # A stretch goes on only if it has a window in the half; then it holds the bytes shared there.
        big = big.filter(f"greatest(p, {MATCH} - (size - a)) < least(q, a + 1)")
        rows = big.withColumn("core", _core())
    return ready, counted, labels


#: Staged tables that the ranges are read from.
RANGES = ("placed", "own", "counted")


def removed_ranges(texts: DataFrame, ws: Workspace, batches: int = BATCHES,
                   part_bytes: int = PART_BYTES) -> DataFrame:
    """k1, k2, lo, hi: byte ranges of the distinct texts (k1, k2, text, copies) that stand elsewhere too.

    They are joined as they are read, from the tables named in ``RANGES`` and the hits.
    """
    anchors = ws.stage(_anchors(texts), "anchors")
    each = anchors.select("k1", "k2", F.explode("hs").alias("h"))
    # Kept, so that the join has a shuffle of its own on both sides and Spark can split a frequent anchor.
    often = each.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h").persist(StorageLevel.DISK_ONLY)
    wanted = each.join(often, "h").groupBy("k1", "k2").agg(F.collect_set("h").alias("hs"))
    placed = ws.stage(_placed(texts.join(wanted.hint("shuffle_hash"), ["k1", "k2"]).select(
        "k1", "k2", "text", "copies", "hs")), "placed")
    often.unpersist()
    ws.drop("anchors")
    own = placed.groupBy("h", "a", "s1", "s2", "size").agg(
        F.sum("copies").alias("n"), F.min("body").alias("body"), F.min(F.pmod("k1", F.lit(batches))).alias("batch"))
    own = ws.stage(own, "own")
    ready, counted, labels = _grouped(own.select("h", "s1", "s2", "a", "size", "body", "batch"), ws, part_bytes)
    groups = ready[0]
    for x in ready[1:]:
        groups = groups.unionByName(x)
    held = groups.agg(F.sum("size")).first()[0] or 0
    parts = int(held // part_bytes) + 1
    groups = ws.stage(groups.select(
        F.pmod(F.xxhash64("h", "p", "q", "core"), F.lit(parts)).alias("part"), "s1", "s2", "a", "body", "p", "q",
        "batch"), "groups")
    singles = counted[0]
    for x in counted[1:]:
        singles = singles.unionByName(x)
    singles = ws.stage(singles, "counted")
    ws.drop(*labels)
    index, hits = SuffixIndex(ws), []
    if held:
        for b in range(batches):
            hits += index.add(groups.filter(F.col("batch") == b).drop("batch"), last=b == batches - 1)
    settled = own.filter("n > 1").select("s1", "s2", F.lit(0).alias("lo"), F.col("size").alias("hi"))
    for x in [singles, *hits]:
        settled = settled.unionByName(x)
    ranges = placed.select("s1", "s2", "k1", "k2", "start").join(settled, ["s1", "s2"]).select(
        "k1", "k2", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    index.close()
    ws.drop("groups")
    return ranges


_KEPT = "k1 bigint, k2 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _cut(texts: DataFrame) -> DataFrame:
    """Digest of what stays of the texts (k1, k2, text, copies, ranges)."""
    def run(batches):
        for batch in batches:
            rows = []
            for k1, k2, data, copies, ranges in zip(
                    batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                    batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(),
                    batch.column(4).to_pylist()):
                spans = [[0, len(data)]] if copies > 1 and len(data) >= MATCH else []
                if not spans:
                    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges or ()):
                        if spans and lo <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], hi)
                        else:
                            spans.append([lo, hi])
                kept, at = hashlib.sha256(), 0
                for lo, hi in spans:
                    kept.update(data[at:lo])
                    at = hi
                kept.update(data[at:])
                rows.append((k1, k2, len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.string()])],
                names=["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return texts.mapInArrow(run, _KEPT)


def dedup(docs: DataFrame, batches: int = BATCHES, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    spark = docs.sparkSession
    ws = Workspace(spark, "suffix")
    rows = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", "text", *_text_keys(F.col("text")))
    name = f"suffix_texts_{uuid.uuid4().hex}"
    distinct = rows.groupBy("k1", "k2").agg(F.min("text").alias("text"), F.count("*").alias("copies"))
    distinct.write.bucketBy(shuffle_partitions(spark), "k1", "k2").format("parquet").option(
        "compression", "zstd").option("path", f"{ws.base}/texts").saveAsTable(name)
    texts = spark.table(name)
    ranges = removed_ranges(texts, ws, batches, part_bytes)
    per_text = ranges.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    cut = ws.stage(_cut(texts.join(per_text.hint("shuffle_hash"), ["k1", "k2"], "left").select(
        "k1", "k2", "text", "copies", "ranges")), "cut")
    spark.sql(f"DROP TABLE {name}")
    ws.drop("texts", *RANGES)
    return rows.select("doc_id", "k1", "k2").join(cut, ["k1", "k2"]).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
