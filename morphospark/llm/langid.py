"""Language of a text by the nearest of several centroids per language.

A text becomes a normalised TF-IDF vector of its hashed character n-grams.
Document frequencies cover all learning rows; for each language a bounded
sample of them (``SAMPLE`` rows, chosen by a hash of the id) is clustered by
spherical k-means, one task a language.  A text goes to the language of the
centroid with the largest cosine.  A distance above the language's own limit
(a quantile of the sample's distances) rejects: ``accepted`` is false, and the
nearest language is still named.

Edge cases: a null text or one without a letter is ``und`` with score 0; ties
go to the language that sorts first; texts of any length are read whole; a
language column without values leaves nothing to learn, so every text is ``und``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of the hashed n-gram space, and the n of the n-grams.
DIMS = 1 << 13
GRAMS = (1, 2, 3)
#: Sampled rows per language for the centroids, centroids per language, rounds of k-means.
SAMPLE = 600
CENTROIDS = 4
ROUNDS = 10
#: Share of the sample whose distance a language's limit lets pass.
ACCEPT = 0.995
MAX_LANGUAGES = 500
FOLDS = 5
UNKNOWN = "und"


def held_out_fold():
    """True for the rows that no learning step may see."""
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams of the lower-cased letters, words apart; None without a letter."""
    text = text.lower()
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    plain = (codes >= 97) & (codes <= 122)
    other = codes >= 128
    if other.any():
        letters = plain.copy()
        wide = np.unique(codes[other])
        alpha = wide[[chr(c).isalpha() for c in wide.tolist()]]
        letters[other] = np.isin(codes[other], alpha)
    else:
        letters = plain
    if not letters.any():
        return None
    # Everything but letters is one blank: runs of blanks shrink, and both ends have one.
    shown = np.where(letters, codes, 32)
    keep = np.concatenate(([True], (shown[1:] != 32) | (shown[:-1] != 32)))
    shown = np.concatenate(([32], shown[keep], [32])).astype(np.uint64)
    hashes = []
    for n in GRAMS:
        if len(shown) < n:
            continue
        h = np.full(len(shown) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ shown[k:len(shown) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        hashes.append((h & np.uint64(DIMS - 1)).astype(np.int64))
    return np.bincount(np.concatenate(hashes), minlength=DIMS)


def _vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.sqrt((v * v).sum())
    return (v / norm if norm else v).astype(np.float32)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each n-gram over all rows of ``docs``, and the number of documents.

    Every task adds up its own rows; the driver gets ``DIMS`` sums.
    """
    def run(batches):
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = gram_counts(text)
                if counts is not None:
                    total += counts > 0
                    n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], names=["g", "n"])

    rows = docs.select("text").mapInArrow(run, "g int, n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(DIMS, np.int64), 0
    for g, c in rows:
        if g < 0:
            n = c
        else:
            df[g] = c
    return df, n


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; the first centres are spread out, each far from those before it."""
    centres = [x.mean(axis=0)]
    while len(centres) < min(k, len(x)):
        near = np.max(x @ np.array(centres).T, axis=1)
        centres.append(x[int(np.argmin(near))])
    c = np.array(centres, np.float32)
    for _ in range(ROUNDS):
        c /= np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-12)
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(axis=0)
    return c / np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-12)


def fit(learning: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS):
    """(languages, limits, centroid matrix, idf) learned from (doc_id, text, lang) rows without nulls."""
    df, n = document_frequencies(learning)
    idf = np.log((1 + n) / (1 + df)) + 1
    sizes = {r["lang"]: r["count"] for r in learning.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return [], np.zeros(0), np.zeros((0, DIMS), np.float32), idf
    # A hash threshold per language takes about `sample` texts without sorting or ranking any language; rows of one
    # id and text are one, and a language whose texts all miss its threshold gives the text of the smallest hash.
    part = F.create_map(*[F.lit(y) for k, c in sizes.items() for y in (k, min(1.0, sample / c))])
    draw = learning.select("lang", "text", F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1 << 30)).alias("h"))
    passed = draw.filter(F.col("h") < F.lit(1 << 30) * part[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    least = draw.filter(F.lower("text").rlike(r"\p{L}")).groupBy("lang").agg(F.min(F.struct("h", "text")).alias("least"))
    picked = passed.select("lang", "text").unionByName(
        least.join(passed.select("lang").distinct(), "lang", "left_anti").select("lang", "least.text"))

    def vectors(batches):
        for batch in batches:
            rows = [(lang, gram_counts(text)) for text, lang in zip(*map(pa.Array.to_pylist, batch.columns))]
            rows = [(lang, _vector(c, idf).tobytes()) for lang, c in rows if c is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                              pa.array([r[1] for r in rows], pa.binary())], names=["lang", "v"])

    def cluster(key, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(sorted(rows["v"])), np.float32).reshape(-1, DIMS)
        c = _kmeans(x, centroids)
        limit = float(np.quantile(1 - np.max(x @ c.T, axis=1), ACCEPT))
        return pd.DataFrame({"lang": [key[0]] * len(c), "far": [limit] * len(c), "c": [v.tobytes() for v in c]})

    model = (picked.select("text", "lang").mapInArrow(vectors, "lang string, v binary")
             .groupBy("lang").applyInPandas(cluster, "lang string, far double, c binary").collect())
    model.sort(key=lambda r: (r["lang"], bytes(r["c"])))
    matrix = np.frombuffer(b"".join(bytes(r["c"]) for r in model), np.float32).reshape(-1, DIMS)
    return [r["lang"] for r in model], np.array([r["far"] for r in model]), matrix, idf


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every row, from the text alone."""
    langs, limits, matrix, idf = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, limits, matrix, idf))

    def run(batches):
        names, far, centres, weights = shared.value
        for batch in batches:
            lang, score, good = [], [], []
            for text in batch.column(2).to_pylist():
                counts = gram_counts(text) if text and names else None
                if counts is None:
                    lang.append(UNKNOWN), score.append(0.0), good.append(False)
                    continue
                near = centres @ _vector(counts, weights)
                j = int(np.argmax(near))
                lang.append(names[j])
                score.append(float(min(1.0, max(0.0, near[j]))))
                good.append(bool(1 - near[j] <= far[j] + 1e-6))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(good, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(held_out_fold(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame) -> DataFrame:
    learning = docs.filter(~held_out_fold()).filter("text is not null and lang is not null")
    return predict(docs, fit(learning.select("doc_id", "text", "lang")))
