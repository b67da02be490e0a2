"""Benchmark decontamination by spaced-seed hashing.

A mask keeps some positions of a stretch of tokens and ignores the others, so
its hash survives substitutions at the ignored ones.  Every stretch of every
item and of every document is hashed under each fixed mask, in tasks; the
hashes of both sides are joined.  Equal hashes name an item and the place where
it would lie in the document.  There the item is laid over the document token
by token: a stretch of at least ``MIN_WINDOW`` aligned tokens, or the whole of a
shorter item, with ``MIN_SIMILARITY`` or more of them equal is a leak.

Few stretches of a document share a hash with an item.  A Bloom filter of the
item hashes, of ``1 << FILTER_BITS`` bits at most whatever the benchmark holds,
is broadcast, and only hashes that pass it leave the scan, with the token hashes
of their document; texts are never shuffled.  A fuller filter lets more hashes
through to the join, which decides exactly.  The item side of a join is
broadcast behind a check of its size; beyond it, both sides are dealt by key and
salt, so that a stretch which many documents hold takes ``SALTS`` tasks.

Tokens are words, and single characters in scripts that put no blanks between
words; they are compared by 64-bit hashes.  An item too short for the masks is
looked for whole, token by token.

Edge cases: a null text, and an item without token, has nothing to find; long
documents are scanned whole; of several places of an item in a document the one
with the most equal tokens is reported, the first of equal ones, and ``n_places``
counts the alignments that are leaks; repeated documents are each reported,
repeated items are laid once and reported under each id; empty tables give no
rows; other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from morphospark.operators.joins import sized_broadcast

from .common import Workspace, text_or_empty

#: Kept positions.  Any five words in a row of which at most one is replaced are hit by one of these masks; a
#: stretch of five words or more with a similarity of 0.8 always holds such five, so no leak is missed.
MASKS = ((0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4))
#: Items of fewer than five tokens are hashed whole: 0.8 of so few is all of them.
SHORT = tuple(tuple(range(n)) for n in range(1, 5))
MIN_ITEM = 1
MIN_WINDOW = 13
MIN_SIMILARITY = 0.8
#: The filter of item hashes has 256 bits or more a hash, up to this many bits (2^29: 64 MB).
FILTER_BITS = 29
#: Item hashes and items are broadcast up to this many rows and 256 MB; beyond, joins deal each key out by so many salts.
BROADCAST_ROWS = 2_000_000
SALTS = 16
#: Texts are hashed together up to this many tokens; a longer one by itself.
PORTION = 200_000
#: What parts words: ASCII punctuation by a byte table, other punctuation by a pattern.
_ODD = re.compile(r"[^\w\x00-\x7f]+")
#: Scripts without blanks between words: Thai, Lao, Tibetan, Myanmar, Khmer, kana and Chinese characters.
_ALONE = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf"
                    "\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_PARTS = bytes(32 if not (chr(b).isalnum() or b == 95) and b < 128 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[bytes]:
    """Lower-cased runs of letters, digits and underscores, as UTF-8; unspaced scripts character by character."""
    text = text.lower()
    if not text.isascii():
        text = _ALONE.sub(r" \g<0> ", _ODD.sub(" ", text))
    return text.encode("utf-8", "replace").translate(_PARTS).split()


def _tokens(text: str) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found))


def _seeds(ids: np.ndarray, mask, number: int) -> np.ndarray:
    """Hash under one mask at every position where it fits."""
    n = len(ids) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, number + 1, np.uint64)
    for k in mask:
        h = (h ^ ids[k:k + n]) * _MIX
        h ^= h >> np.uint64(32)
    return h


def _best_window(equal: np.ndarray) -> tuple[int, int, int] | None:
    """(equal words, from, to) of the longest stretch that counts as a leak, or None."""
    n = len(equal)
    least = min(MIN_WINDOW, n)
    total = np.concatenate(([0], np.cumsum(equal)))
    for size in range(n, least - 1, -1):
        got = total[size:] - total[:-size]
        at = int(np.argmax(got))
        if got[at] >= MIN_SIMILARITY * size:
            return int(got[at]), at, at + size
    return None


class SeedFilter:
    """Bloom filter of hashes: the upper and the lower ``bits`` bits of each are its two places."""

    def __init__(self, bits: int, slots: np.ndarray, values: np.ndarray):
        self.bits = bits
        self.held = np.zeros(1 << (bits - 6), np.uint64)
        self.held[slots] = values.view(np.uint64)

    def _has(self, place: np.ndarray) -> np.ndarray:
        return (self.held[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1

    def passing(self, h: np.ndarray) -> np.ndarray:
        """Positions of the hashes that may be held."""
        at = np.flatnonzero(self._has(h >> np.uint64(64 - self.bits)))
        return at[self._has(h[at] & np.uint64((1 << self.bits) - 1))]


def _filter(seeds: DataFrame) -> SeedFilter:
    """The filter of the column ``hash``, put together by Spark; the driver gets its words, bounded by FILTER_BITS."""
    bits = min(FILTER_BITS, max(16, seeds.count().bit_length() + 8))
    places = seeds.select(F.explode(F.array(F.shiftrightunsigned("hash", 64 - bits),
                                            F.col("hash").bitwiseAND((1 << bits) - 1))).alias("p"))
    held = places.groupBy(F.shiftright("p", 6).alias("slot")).agg(
        F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("value")).toArrow()
    return SeedFilter(bits, held["slot"].to_numpy(), held["value"].to_numpy())


def _portions(texts):
    """Runs (first row, token arrays) of texts with about PORTION tokens together."""
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(_tokens(text))
        size += len(held[-1])
        if size >= PORTION:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


def _hashed(held: list[np.ndarray], masks, seen: SeedFilter | None):
    """(text, hash, position) of all seeds of some texts, by text: of items all, of documents those that pass."""
    sizes = np.array([len(x) for x in held], np.int64)
    ends = np.cumsum(sizes)
    ids = np.concatenate(held)
    out = []
    for number, mask in masks:
        h = _seeds(ids, mask, number)
        at = np.arange(len(h)) if seen is None else seen.passing(h)
        text = np.searchsorted(ends, at, "right")
        fits = at + mask[-1] < ends[text]
        if seen is None:  # an item of few tokens has the one seed of its length, any other those of the masks
            fits &= sizes[text] > len(SHORT) if number < len(MASKS) else sizes[text] == len(mask)
        out.append((text[fits], h[at[fits]], (at - ends[text] + sizes[text])[fits]))
    text, h, at = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(text, kind="stable")
    return text[order], h[order], at[order]


def _lists(values, counts, kind):
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()),
                                    pa.array(values, kind))


def _scan(df: DataFrame, masks, shared=None) -> DataFrame:
    """(row, carry, tokens, seeds) of the rows (carry, text) that have a seed; ``row`` is a number of their own."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("carry", df.schema[0].dataType),
                           *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("tokens", "hashes", "places")]])

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, held in _portions(batch.column(1).to_pylist()):
                text, h, at = _hashed(held, masks, shared and shared.value)
                has, counts = np.unique(text, return_counts=True)
                tokens = [held[k] for k in has.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(len(has)), pa.int64()), batch.column(0).take(pa.array(first + has)),
                     _lists(np.concatenate([np.zeros(0, np.uint64), *tokens]).view(np.int64), [len(x) for x in tokens],
                            pa.int64()),
                     _lists(h.view(np.int64), counts, pa.int64()), _lists(at, counts, pa.int64())],
                    names=["row", "carry", "tokens", "hashes", "places"])
                row += len(has)

    return df.mapInArrow(run, schema)


def _met(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Join with the item side: broadcast behind a check of its size, else dealt by key and salt."""
    side = sized_broadcast(few, BROADCAST_ROWS)
    if side is not few:
        return many.join(side, key)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return many.withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS))).join(few.withColumn("salt", salts),
                                                                            [key, "salt"]).drop("salt")


def _judge(batches):
    """Lays items over the stretches of documents at their places; only leaks come out."""
    for batch in batches:
        out = []
        cols = [batch.column(k) for k in range(6)]
        for k, (row, item, start, size) in enumerate(zip(*[c.to_pylist() for c in cols[:4]])):
            whole, part = (np.asarray(cols[c][k].values) for c in (4, 5))
            a, b = max(0, start), min(size, start + len(whole))
            equal = np.zeros(len(whole), bool)
            equal[a - start:b - start] = part == whole[a - start:b - start]
            got = _best_window(equal)
            if got:
                out.append((row, item, start, got[0], max(0, start + got[1]), min(size, start + got[2]), len(whole)))
        cols = list(zip(*out)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                         names=["row", "item", "start", "n_equal", "first", "end", "n_item"])


def _seed_rows(scanned: DataFrame, row: str, at: str) -> DataFrame:
    return scanned.select(F.col("row").alias(row), F.explode(F.arrays_zip("hashes", "places")).alias("s")).select(
        row, F.col("s.hashes").alias("hash"), F.col("s.places").alias(at))


def _leaks(docs: DataFrame, benchmark: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Leaks of documents (carry, text): one row per document and item text, with carry and the item's key; and the
    scanned items.  Scans are staged: the numbers of their rows must not change when a task runs again."""
    texts = benchmark.filter("text is not null").select(F.md5("text").alias("carry"), "text").groupBy("carry").agg(
        F.first("text").alias("text"))
    masks = list(enumerate((*MASKS, *SHORT)))
    items = ws.stage(_scan(texts, masks), "items")
    short = {r[0] for r in items.select(F.size("tokens")).filter(F.size("tokens") <= len(SHORT)).distinct().collect()}
    masks = [(m, mask) for m, mask in masks if m < len(MASKS) or len(mask) in short]
    seeds = _seed_rows(items, "item", "item_at")
    shared = docs.sparkSession.sparkContext.broadcast(_filter(seeds))
    hits = ws.stage(_scan(docs, masks, shared), "hits")
    places = _met(_seed_rows(hits, "row", "at"), seeds, "hash").select(
        "row", "item", (F.col("at") - F.col("item_at")).alias("start")).distinct()
    start = F.greatest(F.col("start"), F.lit(0))
    laid = _met(places, items.select(F.col("row").alias("item"), F.col("tokens").alias("whole")), "item").join(
        hits.select("row", "tokens"), "row").select(
        "row", "item", "start", F.size("tokens").cast("long").alias("size"), "whole",
        F.slice("tokens", (start + 1).cast("int"),
                (F.col("start") + F.size("whole") - start).cast("int")).alias("part"))
    judged = laid.mapInArrow(_judge, "row long, item long, start long, n_equal long, first long, end long, n_item long")
    best = judged.groupBy("row", "item").agg(
        F.max(F.struct("n_equal", (-F.col("start")).alias("least"), "first", "end", "n_item")).alias("b"),
        F.count("start").alias("n_places"))
    return best.join(hits.select("row", "carry"), "row"), items


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found in it: place, equal words and their share of the aligned stretch."""
    ws = Workspace(docs.sparkSession, "decontam")
    found, items = _leaks(docs.select("doc_id", text_or_empty().alias("text")), benchmark, ws)
    names = benchmark.filter("text is not null").select("item_id", F.md5("text").alias("key")).join(
        items.select(F.col("row").alias("item"), F.col("carry").alias("key")), "key").select("item", "item_id")
    return _met(found, names, "item").select(
        F.col("carry").alias("doc_id"), "item_id", F.col("b.first").alias("first_word"),
        F.col("b.end").alias("end_word"), F.col("b.n_equal").alias("n_equal"), F.col("b.n_item").alias("n_item_words"),
        "n_places", (F.col("b.n_equal") / F.greatest(F.lit(1), F.col("b.end") - F.col("b.first"))).alias("similarity"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents in which no item was found; all columns stay.

    What is found is a short table of keys of texts.  The row goes along as one
    struct: its columns cannot clash with the key.
    """
    ws = Workspace(docs.sparkSession, "decontam")
    key = F.md5(text_or_empty())
    found, _ = _leaks(docs.select(key.alias("key"), text_or_empty().alias("text")), benchmark, ws)
    leaked = ws.stage(found.select(F.col("carry").alias("key")).distinct(), "leaked")
    ws.drop("items", "hits")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    return rows.join(sized_broadcast(leaked, BROADCAST_ROWS), "key", "left_anti").select("row.*")
