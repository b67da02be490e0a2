"""The near-duplicate stage: planted near copies, rows without doc_id, one doc_id with several texts, odd columns."""

import random

import brute
import corpus_pipeline
from pyspark.sql import functions as F

from morphospark.llm import simhash

COLS = "doc_id long, text string, n_chars int"


def prose(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], COLS)


def stage(spark, rows):
    return corpus_pipeline.simhash_near_dedup(spark, frame(spark, rows), "").collect()


def test_planted_near_copies(spark):
    rng = random.Random(8)
    rows, i = [], 0
    for _ in range(60):
        words = prose(rng, rng.randint(200, 800))
        for k in range(4):  # from equal texts down to a similarity of about 0.8
            copy = list(words)
            for at in rng.sample(range(len(words)), k * len(words) // 100):
                copy[at] = prose(rng, 1)[0]
            rows.append((i, " ".join(copy)))
            i += 1
    rows += [(i, rows[5][1]), (i + 1, rows[9][1].upper()), (i + 2, None), (i + 3, ""), (i + 4, "  \n")]
    component = brute.components({k: brute.fingerprint(t) for k, t in rows})
    kept = sorted(r.doc_id for r in stage(spark, rows))
    assert kept == sorted(set(component.values()))
    assert 60 < len(kept) < 240


def test_rows_without_doc_id(spark):
    rng = random.Random(10)
    a, b, c = (" ".join(prose(rng, 80)) for _ in range(3))
    kept = stage(spark, [(None, a), (None, b), (None, b), (7, c), (None, c)])
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, a), (0, b), (7, c)])


def test_one_doc_id_with_two_texts(spark):
    rng = random.Random(11)
    a, b, c = sorted(" ".join(prose(rng, 80)) for _ in range(3))
    rows = [(1, a), (1, b), (2, b), (3, c), (3, c), (4, c)]
    assert sorted((r.doc_id, r.text) for r in stage(spark, rows)) == sorted([(1, a), (1, b), (3, c)])
    upper = a.upper()  # two texts of one fingerprint and one doc_id: the first by text stays
    assert [(r.doc_id, r.text) for r in stage(spark, [(1, upper), (1, a)])] == [(1, min(a, upper))]


def test_columns_with_any_name(spark):
    names = ["__node", "__n", "__i", "__c", "__row", "__cleaned", "row", "node", "own", "c", "cleaned", "kept"]
    rng = random.Random(12)
    text = "\n".join(" ".join(prose(rng, 12)) + "." for _ in range(5))
    docs = frame(spark, [(1, text), (2, text), (2, text)]).select("*", *[F.lit(k).alias(x) for k, x in enumerate(names)])
    for made in (corpus_pipeline.quality_rules(spark, docs, ""), corpus_pipeline.simhash_near_dedup(spark, docs, "")):
        assert made.columns == docs.columns
        got = made.collect()
        assert all([r[x] for x in names] == list(range(len(names))) and r.text == text for r in got)
    assert len(got) == 1


def test_links_go_over_rows_without_doc_id(spark, monkeypatch):
    """Fingerprints 0, 7 and 63: the outer two are linked over the middle one, which has no id."""
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "doc_id long, text string")
    made = docs.select("doc_id", F.when(F.col("text") == "a", 0).when(F.col("text") == "b", 7).otherwise(63)
                       .cast("long").alias("fp"))
    monkeypatch.setattr(simhash, "fingerprints", lambda d, s: made)
    assert {(r.doc_id, r.component_id) for r in simhash.components(docs).collect()} == {(1, 1), (None, 1), (3, 1)}


def test_one_doc_id_does_not_link_its_texts(spark):
    rng = random.Random(13)
    a, b = (" ".join(prose(rng, 80)) for _ in range(2))
    rows = [(5, a), (5, b), (6, b), (7, a)]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert len(got) == 4 and set(got.values()) == {5}
    rows = [(5, a), (5, b), (4, b), (7, a)]
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect())
    assert got == [(4, 4), (5, 4), (5, 5), (7, 5)]
