"""Spelling variants by permuterm rotations.

A word marked with a terminator has one rotation for each of its characters.
The rotation that ends with a character leaves all the others as its prefix, so
the words that differ from each other in that character alone share the prefix,
and the word that lacks it has the prefix as a whole rotation.  All rotations
are sorted by that prefix; a scan over the sorted rows meets each prefix range
as one run of rows, at most one row for each letter of the alphabet and one for
the word that lacks it, whatever the table.

A range gives every word in it the number of its neighbours there and the best
of them, not the pairs.  Two words are neighbours in one range only: a replaced
character has one place, and of a run of equal letters only the first counts as
the deleted one.

Edge cases: a null or empty text has no words; a null ``doc_id`` counts as the
empty text in the digest of a run; repeated rows are counted each; a word that
the deletion makes too short is none; among forms of equal count the first in
code-point order is taken; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphospark.session import shuffle_partitions

from .common import Workspace

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SLIP_EVERY = 199
MIN_LENGTH = 6
MIN_COUNT = 5
#: A form is at least so many times as frequent as its variant.
FORM_RATIO = 5
#: Marks the end of a word; sorts before every letter.
END = "$"
#: Distinct words that one task holds before it hands on their counts.
HELD = 300_000
#: Rotations of a range partition of the sort.
RANGE_ROWS = 2_000_000


def slipped(doc_id, run: str) -> str:
    """The lower-cased run, without one of its characters if its digest says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % SLIP_EVERY:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


_LOWER = {c: c + 32 for c in range(65, 91)}


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough.

    Tasks add up counts before the shuffle and hand them on whenever they hold
    ``HELD`` words.
    """
    def count(batches):
        held = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())],
                                             names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for run, n in Counter(RUN.findall(text.translate(_LOWER) if not text.isascii() else text.lower())).items():
                    word = slipped(i, run)
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) > HELD:
                    yield rows()
        if held:
            yield rows()

    return docs.filter("text is not null").select("doc_id", "text").mapInArrow(count, "word string, n bigint") \
        .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, word, n, kind) of every rotation, by what it leaves of the word.

    Kind 0 is a whole rotation.  Kinds 1 and 2 leave out the last character of
    the rotation: 1 if it may count as deleted, 2 if the same letter stands
    before it, so that it is replaced only.
    """
    def turn(batches):
        for batch in batches:
            prefix, at, kind = [], [], []
            for row, w in enumerate(batch.column(0).to_pylist()):
                before = ""
                for i, c in enumerate(w):
                    head = w[:i]
                    prefix += (w[i:] + END + head, w[i + 1:] + END + head)
                    kind += (0, 2 if c == before else 1)
                    before = c
                prefix.append(END + w)
                kind.append(0)
                at += [row] * (2 * len(w) + 1)
            at = pa.array(at, pa.int64())
            for s in range(0, len(at), 65536):
                part = at.slice(s, 65536)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefix[s:s + 65536], pa.string()), batch.column(0).take(part), batch.column(1).take(part),
                     pa.array(kind[s:s + 65536], pa.int8())], names=["prefix", "word", "n", "kind"])

    return words.select("word", "n").mapInArrow(turn, "prefix string, word string, n bigint, kind tinyint")


def _range(rows) -> list[tuple]:
    """(word, neighbours, count of the best, best) of every word of a prefix range that has a neighbour there."""
    whole = [(w, n) for w, n, kind in rows if kind == 0]
    others = [(w, n, kind) for w, n, kind in rows if kind]
    out = []
    first, second = (sorted(((-n, w) for w, n, _ in others))[:2] + [None, None])[:2]
    for w, n, kind in others:
        best = second if first[1] == w else first
        near = len(others) - 1
        if kind == 1 and whole:
            near += 1
            lacking = (-whole[0][1], whole[0][0])
            best = lacking if best is None else min(best, lacking)
        if near:
            out.append((w, near, -best[0], best[1]))
    longer = [(-n, w) for w, n, kind in others if kind == 1]
    if whole and longer:
        best = min(longer)
        out.append((whole[0][0], len(longer), -best[0], best[1]))
    return out


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near, best_n, best) for every prefix range in which a word has neighbours.

    One sort of the rotations by their prefix: equal prefixes are in one
    partition, and one after the other there.
    """
    def scan(batches):
        prefix, rows, out = None, [], []

        def table():
            cols = list(zip(*out)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                names=["word", "near", "best_n", "best"])

        for batch in batches:
            keys, word, n, kind = batch.columns
            # Rows whose prefix neither the row before nor the one after has are alone in their range.
            same = np.zeros(len(batch) + 1, bool)
            if len(batch) > 1:
                same[1:-1] = pc.equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            same[0] = prefix is not None and len(batch) and keys[0].as_py() == prefix
            some = np.flatnonzero(same[:-1] | same[1:])
            if len(batch) and (not len(some) or some[-1] != len(batch) - 1):
                some = np.append(some, len(batch) - 1)  # the next batch may go on with it
            some = pa.array(some)
            for p, w, c, k in zip(*(x.take(some).to_pylist() for x in (keys, word, n, kind))):
                if p != prefix:
                    if len(rows) > 1:
                        out += _range(rows)
                    prefix, rows = p, []
                rows.append((w, c, k))
            yield table()
            out = []
        if len(rows) > 1:
            out += _range(rows)
        yield table()

    turned = rotations(words)
    spark = words.sparkSession
    parts = max(shuffle_partitions(spark), -(-words.count() * 16 // RANGE_ROWS))
    return turned.repartitionByRange(parts, "prefix").sortWithinPartitions("prefix").mapInArrow(
        scan, "word string, near bigint, best_n bigint, best string")


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the texts.

    Counts grow at least ``FORM_RATIO``-fold from word to form, so the chains
    are as long as the logarithm of the largest count; each round of following
    doubles the part that is done.
    """
    ws = Workspace(docs.sparkSession, "spelling")
    words = ws.stage(vocabulary(docs), "words")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    near = ws.stage(neighbours(words).groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.m")).alias("best_n"), "b.best"), "near")
    formed = F.col("best_n") >= FORM_RATIO * F.col("n")
    every = ws.stage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "forms")
    step = every.filter("form is not null").select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n")).first()[0] or 1
    longest, done = 1, 1
    while FORM_RATIO ** (longest + 1) * MIN_COUNT <= most:
        longest += 1
    while done < longest:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = ws.stage(step.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")),
                        f"roots{done}")
        done *= 2
    return every.join(step, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
