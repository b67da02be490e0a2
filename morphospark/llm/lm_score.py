"""Language-model scores from a log-frequency Bloom filter.

The filter keeps no n-grams: a count c of an n-gram x is put in as the events
(x, 1) to (x, j), where j is the number of binary digits of c.  A probe asks for
(x, 1), (x, 2) and so on until one is missing, and takes the middle of the last
range as the count.  There are no false misses, and an n-gram can be no more
frequent than the shorter ones in it, which bounds false hits.

Probabilities are smoothed order by order,
P(w | h) = (c(hw) + ``KAPPA`` P(w | shorter h)) / (c(h) + ``KAPPA``),
from (c(w) + 1) / (N + V + 1); a document begins in a context of its own.

N-grams are 64-bit hashes.  Tasks count them in bounded portions, one shuffle by
segment of the hash space adds the portions up, and every segment sizes and
fills its own bits, so the filter grows with the corpus and no task holds more
than about ``SEGMENT`` n-grams.  Workers get the filter by broadcast, at most
``BLOCK_BYTES`` of it at a time: each block is one pass over the documents that
fills in the digits of its segments, and the last pass scores.

The add-one base score needs exact counts.  Tokens with at least N / ``HEAD``
occurrences, of which there can be no more than ``HEAD``, are broadcast; tokens
the filter has never seen have none; the rest is joined.  So no join key is hot.

Edge cases: a null or empty text is its end token alone; a null ``doc_id``
counts as a training row; rows that repeat are scored each, and counted each;
without training rows every probability is 1 and every score 0; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphospark.session import shuffle_partitions

from .common import Workspace, text_or_empty

ORDER = 2
KAPPA = 2.0
SEED = 42
HOLD_EVERY, HOLD_AT = 7, 2
#: Bits for each event, and bits tested for each: a false hit in about 1.3 % of first probes.
EVENT_BITS = 9
HASHES = 6
#: N-grams of a segment, about.
SEGMENT = 1_000_000
#: Bytes of the filter that are broadcast at a time.
BLOCK_BYTES = 256 << 20
#: Tokens with exact counts that may be broadcast: 16 bytes each.
HEAD = 8_000_000
#: N-grams that a task adds up at a time, and token hashes that it remembers.
PORTION = 4_000_000
REMEMBERED = 1_000_000
#: No word has a blank in it.
END_TOKEN = b"\n"
UNKNOWN = 255
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


class _Hashes(dict):
    """XXH64 of tokens, remembered."""

    def __missing__(self, token):
        import xxhash

        h = self[token] = xxhash.xxh64_intdigest(token, SEED)
        return h

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the tokens of all texts, ends included, and the number of tokens of each."""
        if len(self) > REMEMBERED:
            self.clear()
        parts, sizes = [], []
        for text in texts:
            words = text.lower().split()  # of bytes: A-Z alone, and space and tab to carriage return
            words.append(END_TOKEN)
            parts.append(np.fromiter(map(self.__getitem__, words), np.uint64, len(words)))
            sizes.append(len(words))
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array(sizes, np.int64)


def ngram_keys(tokens: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order the hash of the n-gram that ends at each token; documents begin with pads."""
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    keys = [tokens]
    for k in range(2, order + 1):
        before = np.empty_like(tokens)
        before[1:] = keys[-1][:-1]
        before[starts] = np.uint64(k)
        keys.append(_mix(before * _A + tokens + np.uint64(k)))
    return keys


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(segments)).astype(np.int64)


def _bits(keys: np.ndarray, digit: int, sizes: np.ndarray | int):
    """Places of an event within its segment, hash by hash."""
    a = _mix(keys + np.uint64(digit * int(_B) % 2**64))
    step = _mix(a + _A) | np.uint64(1)
    for _ in range(HASHES):
        yield a % sizes
        a = a + step


def build_segment(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits, as bytes, of one segment: as many for each event, whatever the segment."""
    digits = np.frexp(counts.astype(np.float64))[1]
    size = max(64, -(-int(digits.sum()) * EVENT_BITS // 8) * 8)
    bits = np.zeros(size, bool)
    for digit in range(1, int(digits.max(initial=0)) + 1):
        chosen = keys[digits >= digit]
        for place in _bits(chosen, digit, np.uint64(size)):
            bits[place] = True
    return np.packbits(bits, bitorder="little")


class FilterBlock:
    """Some segments of the filter."""

    def __init__(self, segments: int, parts: dict[int, bytes]):
        self.segments = segments
        self.offset = np.full(max(1, segments), -1, np.int64)
        self.size = np.ones(max(1, segments), np.uint64)
        at = 0
        for seg, raw in sorted(parts.items()):
            self.offset[seg], self.size[seg] = at, len(raw) * 8
            at += len(raw)
        self.data = np.frombuffer(b"".join(raw for _, raw in sorted(parts.items())) or b"\0", np.uint8)

    def digits(self, keys: np.ndarray) -> np.ndarray:
        """Digits of the count of each n-gram, 0 if it was never put in, UNKNOWN if its segment is elsewhere."""
        out = np.full(len(keys), UNKNOWN, np.uint8)
        if not self.segments:
            return np.zeros(len(keys), np.uint8)
        seg = segment_of(keys, self.segments)
        offset = self.offset[seg]
        here = np.flatnonzero(offset >= 0)
        out[here] = 0
        digit = 0
        while len(here) and digit < 64:
            digit += 1
            found = np.ones(len(here), bool)
            for place in _bits(keys[here], digit, self.size[seg[here]]):
                byte = self.data[offset[here] + (place >> np.uint64(3)).astype(np.int64)]
                found &= (byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            here = here[found]
            out[here] = digit
        return out


def counted(digits: np.ndarray) -> np.ndarray:
    """The count that so many digits stand for: the middle of the range."""
    d = np.arange(65, dtype=np.float64)
    table = (np.exp2(d - 1) + np.exp2(d) - 1) / 2
    table[0] = 0
    return table[np.minimum(digits, 64)]


def log_probabilities(digits: list[np.ndarray], starts: np.ndarray, n: int, v: int, docs: int) -> np.ndarray:
    """log10 P of every token from the digits of the n-grams that end at it, order by order."""
    p = (counted(digits[0]) + 1) / (n + v + 1)
    shorter = digits[0]
    for own in digits[1:]:
        context = np.empty_like(shorter)
        context[1:] = shorter[:-1]
        context[starts] = min(64, int(docs).bit_length())
        own = np.minimum(np.minimum(own, shorter), context)
        c = counted(context)
        c[starts] = docs
        p = (np.minimum(counted(own), c) + KAPPA * p) / (c + KAPPA)
        shorter = own
    return np.log10(p)


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HOLD_EVERY == HOLD_AT, F.lit(False))


def _portions(order: int, segments: int):
    """Task that turns texts into partial n-gram counts (seg, k, key, c)."""
    def run(batches):
        hashes, held, size = _Hashes(), [[] for _ in range(order)], 0

        def rows():
            for k, parts in enumerate(held):
                key, c = np.unique(np.concatenate(parts), return_counts=True)
                parts.clear()
                seg = segment_of(key, segments).astype(np.int32)
                for at in range(0, len(key), 1 << 18):
                    s = slice(at, at + (1 << 18))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(seg[s]), pa.array(np.full(len(key[s]), k + 1, np.int8)),
                         pa.array(key[s].view(np.int64)), pa.array(c[s].astype(np.int64))], names=["seg", "k", "key", "c"])

        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for at in range(0, len(texts), 1000):
                tokens, sizes = hashes.of(texts.slice(at, 1000).to_pylist())
                for parts, keys in zip(held, ngram_keys(tokens, sizes, order)):
                    parts.append(keys)
                size += len(tokens) * order
                if size >= PORTION:
                    yield from rows()
                    size = 0
        if size:
            yield from rows()

    return run


class LogFrequencyFilter:
    """The filter over the training rows of a table, with the exact counts of its tokens."""

    def __init__(self, docs: DataFrame, order: int = ORDER, segment: int = SEGMENT, head: int = HEAD):
        self.ws, self.order = Workspace(docs.sparkSession, "lm"), order
        spark = docs.sparkSession
        texts = docs.filter(~_held_out()).select(text_or_empty().alias("text"))
        size, self.docs = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
        # A token takes some six bytes; with shorter ones the segments only get larger in proportion.
        self.segments = 1 + (size or 0) * order // 6 // segment
        parts = max(shuffle_partitions(spark), -(-self.segments // 16))

        def build(key, table):
            k, keys, c = (table.column(x).to_numpy() for x in ("k", "key", "c"))
            one = k == 1
            return pa.table({
                "seg": pa.array([key[0].as_py()], pa.int32()),
                "bits": pa.array([build_segment(keys.view(np.uint64), c).tobytes()], pa.binary()),
                "keys": pa.array([keys[one]], pa.list_(pa.int64())), "counts": pa.array([c[one]], pa.list_(pa.int64())),
                "tokens": pa.array([int(c[one].sum())], pa.int64())})

        counts = texts.mapInArrow(_portions(order, self.segments), "seg int, k tinyint, key bigint, c bigint") \
            .repartition(parts, "seg").groupBy("seg", "k", "key").agg(F.sum("c").alias("c"))
        self.table = self.ws.stage(counts.groupBy("seg").applyInArrow(
            build, "seg int, bits binary, keys array<bigint>, counts array<bigint>, tokens bigint"), "segments")
        self.exact = self.table.select(F.explode(F.arrays_zip("keys", "counts")).alias("e")).select(
            F.col("e.keys").alias("key"), F.col("e.counts").alias("c"))
        n, v = self.table.agg(F.sum("tokens"), F.sum(F.size("keys"))).first()
        self.n, self.v = n or 0, v or 0
        self.least = -(-self.n // head) if self.n else 1
        common = self.exact.filter(F.col("c") >= self.least).toArrow()  # at most `head` rows
        key = common.column("key").to_numpy().view(np.uint64)
        by = np.argsort(key)
        self.common = key[by], common.column("c").to_numpy()[by]

    def blocks(self, most: int = BLOCK_BYTES):
        """Blocks of segments of at most ``most`` bytes, or one segment."""
        sizes = sorted(self.table.select("seg", F.octet_length("bits")).collect())  # a row for some SEGMENT n-grams
        first, held = 0, 0
        for k, (seg, size) in enumerate(sizes):
            held += size
            if k + 1 == len(sizes) or held + sizes[k + 1][1] > most:
                raw = self.table.filter(F.col("seg").between(first, seg)).select("seg", "bits").toArrow()
                yield FilterBlock(self.segments, dict(zip(raw.column(0).to_pylist(), raw.column(1).to_pylist())))
                first, held = seg + 1, 0
        if not sizes:
            yield FilterBlock(0, {})


def _fill(block: FilterBlock, keys: list[np.ndarray], old: list[np.ndarray] | None) -> list[np.ndarray]:
    """Digits of all n-grams, with those of earlier blocks; each distinct n-gram is probed once."""
    out = []
    for k, key in enumerate(keys):
        distinct, where = np.unique(key, return_inverse=True)
        digits = block.digits(distinct)[where]
        out.append(digits if old is None else np.where(old[k] != UNKNOWN, old[k], digits))
    return out


def _split(raw: list[bytes], order: int) -> list[np.ndarray]:
    """Digits by order from the bytes of each text."""
    each = [np.frombuffer(x, np.uint8).reshape(order, -1) for x in raw]
    return [np.concatenate([x[k] for x in each]) if each else np.zeros(0, np.uint8) for k in range(order)]


def score(docs: DataFrame, model: LogFrequencyFilter, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores of all rows: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, order, ws = docs.sparkSession, model.order, model.ws
    n, v, trained = model.n, model.v, model.docs
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", _held_out().alias("held_out"), text_or_empty().alias("text"),
                       F.lit(None).cast("binary").alias("digits"))
    shared = spark.sparkContext.broadcast(model.common)
    least = np.log10(1 / (n + v + 1))

    def probed(batches, block):
        hashes = _Hashes()
        for batch in batches:
            texts, old = batch.column(2).cast(pa.binary()), batch.column(3)
            for at in range(0, len(batch), 1000):
                tokens, sizes = hashes.of(texts.slice(at, 1000).to_pylist())
                part = old.slice(at, 1000).to_pylist()
                known = _split(part, order) if part and part[0] is not None else None
                yield (batch.slice(at, 1000), tokens, sizes,
                       _fill(block, ngram_keys(tokens, sizes, order), known))

    def go_on(block):
        def run(batches):
            for batch, _, sizes, digits in probed(batches, block.value):
                ends = np.cumsum(sizes).tolist()
                raw = [np.concatenate([d[a:b] for d in digits]).tobytes() for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw, pa.binary())],
                                                 names=["doc_id", "held_out", "text", "digits"])

        return run

    def finish(block):
        def run(batches):
            row = TaskContext.get().partitionId() << 33
            common, counts = shared.value
            for batch, tokens, sizes, digits in probed(batches, block.value):
                docs_at = np.repeat(np.arange(len(sizes)), sizes)
                starts = np.cumsum(sizes) - sizes
                logs = log_probabilities(digits, starts, n, v, trained)
                total = np.bincount(docs_at, logs, len(sizes))
                where = np.minimum(np.searchsorted(common, tokens), max(0, len(common) - 1))
                in_head = common[where] == tokens if len(common) else np.zeros(len(tokens), bool)
                c = np.where(in_head, counts[where] if len(common) else 0, 0)
                tail = ~in_head & (digits[0] > 0)
                base = np.where(tail, 0.0, np.log10((c + 1) / (n + v + 1)))
                # Of the other tokens, each document asks once for each.
                asked = np.rec.fromarrays([docs_at[tail], tokens[tail].view(np.int64)])
                asked, times = np.unique(asked, return_counts=True)
                ends = np.searchsorted(asked.f0, np.arange(len(sizes) + 1)).astype(np.int32)
                rid = row + np.arange(len(sizes))
                row += len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid), *batch.columns[:2], pa.array(sizes), pa.array(np.bincount(docs_at, in_head, len(sizes))
                                                                                  .astype(np.int64)),
                     pa.array(np.bincount(docs_at, base, len(sizes))), pa.array(total),
                     pa.ListArray.from_arrays(ends, pa.array(asked.f1.astype(np.int64))),
                     pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64)))],
                    names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "keys", "times"])

        return run

    schema = (f"rid bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, "
              "keys array<bigint>, times array<bigint>")
    last = None
    for k, block in enumerate(model.blocks(block_bytes)):
        if last is not None:  # a further block: what the one before has found is kept
            rows = ws.stage(rows.mapInArrow(go_on(last), rows.schema), f"pass{k}")
            ws.drop(f"pass{k - 1}")
            last.destroy()
        last = spark.sparkContext.broadcast(block)
    own = ws.stage(rows.mapInArrow(finish(last), schema), "scores")
    asked = own.select("rid", F.explode(F.arrays_zip("keys", "times")).alias("e")).select(
        "rid", F.col("e.keys").alias("key"), F.col("e.times").alias("times"))
    found = asked.join(model.exact.filter(F.col("c") < model.least), "key", "left").groupBy("rid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.when(F.col("c").isNull(), F.lit(float(least))).otherwise(
            F.log10((F.col("c") + 1) / F.lit(float(n + v + 1))))).alias("rest"))
    return own.join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score")


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of all rows by a filter learnt from the training rows of the same table."""
    return score(docs, LogFrequencyFilter(docs))
