"""Joins of seed hashes: salted sides, full filters, odd rows, repeated items, portions of long texts."""

import random

import numpy as np
import pytest

from morphospark.llm import decontam

ITEM = "the quick brown fox jumps over the lazy dog near the old river bank today"


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string, key string, row int, `a.b` string"),
            spark.createDataFrame(items, "item_id long, text string, key string"))


def found(d, b):
    return sorted(((r.doc_id, r.item_id, r.first_word, r.end_word, r.n_equal, r.n_places)
                   for r in decontam.find_leaks(d, b).collect()), key=str)


@pytest.mark.parametrize("rows", [0, 1_000_000])
def test_sides_broadcast_or_salted(spark, monkeypatch, rows):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", rows)
    docs = [(1, f"so {ITEM} again {ITEM}", "k", 1, "x"), (1, f"so {ITEM} again {ITEM}", "k", 1, "x"),
            (None, ITEM.replace("fox", "cat"), None, None, None), (4, "nothing to see here at all", "k", 2, "y"),
            (5, None, "k", 3, None), (6, "", "k", 4, None)]
    d, b = frames(spark, docs, [(7, ITEM, "k"), (8, ITEM, "k"), (None, ITEM, None), (9, None, "k"), (10, "?", "k")])
    one, other = [(1, i, 1, 16, 15, 2) for i in (7, 8, None)], [(None, i, 0, 15, 14, 1) for i in (7, 8, None)]
    assert found(d, b) == sorted(one * 2 + other, key=str)
    kept = decontam.drop_leaks(d, b)
    assert kept.columns == d.columns
    assert sorted(tuple(r) for r in kept.collect()) == sorted(docs[3:], key=lambda r: r[0])


def test_empty_sides(spark):
    d, b = frames(spark, [(1, ITEM, "k", 1, "x")], [(1, ITEM, "k")])
    assert decontam.find_leaks(d, b.limit(0)).count() == 0 == decontam.find_leaks(d.limit(0), b).count()
    assert decontam.drop_leaks(d, b.limit(0)).count() == 1


def test_full_filter_changes_nothing():
    rng = np.random.default_rng(3)
    held = [rng.integers(0, 9, n).astype(np.uint64) for n in (40, 0, 3, 7, 1)]
    masks = list(enumerate((*decontam.MASKS, *decontam.SHORT)))
    full = decontam.SeedFilter(16, np.arange(1 << 10), np.full(1 << 10, -1, np.int64))
    text, h, at = decontam._hashed(held, masks, full)
    want = [(k, int(x), p) for k, ids in enumerate(held) for m, mask in masks
            for p, x in enumerate(decontam._seeds(ids, mask, m))]
    assert sorted(zip(text.tolist(), h.tolist(), at.tolist())) == sorted(want)
    text, h, at = decontam._hashed(held, masks, None)
    assert {(k, p) for k, p in zip(text.tolist(), at.tolist()) if k in (2, 4)} == {(2, 0), (4, 0)}


def test_portions_cut_no_text(monkeypatch):
    monkeypatch.setattr(decontam, "PORTION", 50)
    rng = random.Random(1)
    texts = [" ".join(rng.choices("abcdefg", k=n)) for n in (0, 10, 60, 45, 5, 200, 0)]
    parts = list(decontam._portions(texts))
    assert [first + k for first, held in parts for k in range(len(held))] == list(range(len(texts)))
    assert [len(x) for _, held in parts for x in held] == [0, 10, 60, 45, 5, 200, 0]
