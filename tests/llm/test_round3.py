"""Merkle manifest, spelling variants and language-model scores against plain versions."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from morphospark.llm import lm_score, merkle, queries, spelling

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOC = "doc_id long, source string, lang string, n_chars long, text string"


def by_id(rows):
    return sorted(rows, key=lambda r: [(x is not None, x) for x in r])


def fields(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def odd_rows():
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, None, "en", 0, ""), (2, "", "en", 3, "ABC"),
            (7, "é", None, 5, "Ünï X"), (7, "é", None, 5, "Ünï X"), (7, "é", None, 6, "other"), (-3, "é", "x", -1, "Q" * 5000)]
    rows += [(i, "big", "en", i, f"Text {i}") for i in range(700)]
    rows += [(i, "edge", "en", i, f"Text {i}") for i in range(1000, 1000 + 256)]
    rows += [(i, "run", "en", i, f"Text {i}") for i in range(2000, 2017)]
    return rows + [(5, f"s{i}", "en", 1, "T") for i in range(20)]


# ---------------------------------------------------------------- manifest
@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_odd_rows(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)  # level 1: many blocks, several levels above them
    monkeypatch.setattr(merkle, "_grow", _grower(levels))
    rows = odd_rows()
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, DOC).withColumn("k", F.lit("x")).withColumn("tree", F.lit(1)).repartition(7)
    got = merkle.audit(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert by_id([tuple(r) for r in got.collect()]) == by_id(brute.merkle(rows))


def _grower(levels):
    grow = merkle._grow

    def run(key, table):  # workers import the module anew, with its own constant
        from morphospark.llm import merkle as m
        m.BLOCK_LEVELS = levels
        return grow(key, table)

    return run


def test_manifest_whole_table(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = queries.op11_merkle_manifest(spark, SF01)
    assert by_id([tuple(r) for r in got.collect()]) == by_id(brute.merkle(fields(docs)))


def test_manifest_of_nothing_and_of_one(spark):
    assert merkle.audit(spark.createDataFrame([], DOC)).count() == 0
    one = [(4, "a", "en", 2, "Hi")]
    assert [tuple(r) for r in merkle.audit(spark.createDataFrame(one, DOC)).collect()] == brute.merkle(one)


def test_proofs_of_some_leaves(spark):
    rows = odd_rows()
    manifest = merkle.Manifest(spark.createDataFrame(rows, DOC))
    want = {x[1] for x in brute.merkle(rows) if x[0] in (3, 255, 256, 699, 1255, 2016, 7)}
    got = manifest.proofs(manifest.leaves.filter(F.col("leaf").isin(list(want))))
    assert by_id([tuple(r) for r in got.collect()]) == by_id([x for x in brute.merkle(rows) if x[1] in want])


def test_octopus_is_minimal():
    # Leaves 0 and 17 of 40: the others of their runs, the third run; nothing that they can derive.
    found = dict((level, list(idx)) for level, idx in merkle.missing(np.array([17, 0, 17]), 40))
    assert found == {0: [i for i in range(32) if i not in (0, 17)], 1: [2]}
    assert merkle.missing(np.arange(40), 40) == []
    assert merkle.missing(np.array([0]), 1) == []


def test_fold_detects_a_change():
    paths = merkle.Paths({k: merkle.digest(str(k)) for k in range(300)}, {}, 300)
    assert merkle.fold(merkle.digest("299"), paths.steps(299)) == paths.root
    assert merkle.fold(merkle.digest("x"), paths.steps(299)) != paths.root


# ---------------------------------------------------------------- spelling
WORD = "doc_id long, text string"


def spelt(df):
    return by_id([tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()])


def test_spelling_planted(spark):
    rng = random.Random(2)
    base = ["letter", "letters", "lettér", "accommodate", "running", "bookkeeper", "aaaaaaa", "$ignored", "ÀÉÎÕÜß×÷"]
    rows = []
    for w in base:
        rows += [(rng.randrange(10**9), w.upper() if w.isascii() else w)] * (5 * 5 ** rng.randrange(4))
        for _ in range(12):
            k = rng.randrange(len(w) + 1)
            c = rng.choice("abcxyzé")
            x = rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1:], w[:k] + c + w[k + 1:]])
            rows += [(rng.randrange(10**9), f"{x} {x}; {x}")] * rng.choice([1, 2, 9, 60])
    rows += [(None, None), (3, ""), (None, "nullable " * 7), (4, "tieone tietwo " * 9 + "tiefoo " * 1), (5, "hello")]
    for w, n in (("abcdefgh", 6), ("abcdefgi", 40), ("abcdefji", 300), ("abcdeji", 2500), ("xabcdeji", 20000)):
        rows += [(rng.randrange(10**9), " ".join([w] * 10))] * (n // 10) + [(9, w)] * (n % 10)
    docs = spark.createDataFrame(rows, WORD).withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).repartition(5)
    got = spelt(spelling.variants(docs))
    assert got == by_id(brute.spelling(rows))
    assert any(r[1] for r in got) and any(r[1] != r[2] for r in got if r[1])  # forms, and chains of forms


def test_spelling_whole_table(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert spelt(queries.op12_spelling_variants(spark, SF01)) == by_id(brute.spelling(rows))


def test_spelling_slips_and_portions(spark, monkeypatch):
    slips = [(i, "mountain") for i in range(4000)]
    assert sum(spelling.slipped(i, "mountain") != "mountain" for i, _ in slips) > 5
    rows = [(i, f"mountain fountain{i % 3}") for i in range(4000)]
    docs = spark.createDataFrame(rows, WORD).repartition(3)
    assert spelt(spelling.variants(docs)) == by_id(brute.spelling(rows))


def test_spelling_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], WORD)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "")], WORD)).count() == 0


# ---------------------------------------------------------------- language model
def scored(df):
    return sorted(((r.doc_id is not None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens),
                   r.base_score, r.score) for r in df.collect())


def expected(rows):
    return sorted(((i is not None, i or 0, *x[:4]), x[4], x[5]) for (i, _), x in zip(rows, brute.lm(rows)))


def check(got, want):
    assert [x[0] for x in got] == [x[0] for x in want]
    assert np.allclose([x[1] for x in got], [x[1] for x in want], rtol=1e-10, atol=1e-9)


def test_lm_whole_table(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got, want = scored(queries.op13_lm_score(spark, SF01)), expected(rows)
    check(got, want)
    # Counts to a power of two only: a token is off by less than 0.3 on the whole, and the order is the same.
    size = np.array([x[0][3] for x in got])
    per, exact = np.array([x[2] for x in got]) / size, np.array([x[2] for x in want]) / size
    assert np.abs(per - exact).mean() < 0.15 and np.corrcoef(per, exact)[0, 1] > 0.97


def test_lm_blocks_and_joined_tokens(spark):
    """Filter in many blocks, nearly all exact counts joined: the same scores."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    model = lm_score.LogFrequencyFilter(docs, segment=20_000, head=50)
    assert model.segments > 3 and len(model.common[0]) <= 50
    assert sum(1 for _ in model.blocks(30_000)) > 2
    many, one = scored(lm_score.score(docs, model, 30_000)), scored(lm_score.score(docs, model))
    check(many, expected(rows))
    check(one, expected(rows))
    assert [x[2] for x in many] == [x[2] for x in one]


def test_lm_edges(spark):
    rows = [(1, None), (2, ""), (None, "Null id null ID"), (3, "a b\tc\x0bd é É"), (3, "a b\tc\x0bd é É"), (4, "x" * 5000),
            (5, " ".join(f"w{i % 50}" for i in range(20000))), *[(i, f"one two {i}") for i in range(10, 40)]]
    docs = spark.createDataFrame(rows, WORD).withColumn("score", F.lit("s")).withColumn("key", F.lit(1)).repartition(3)
    check(scored(lm_score.score_documents(docs)), expected(rows))
    assert lm_score.score_documents(spark.createDataFrame([], WORD)).count() == 0
    held = [(i, "never trained") for i in range(200) if brute.lm([(i, "")])[0][0]]
    got = lm_score.score_documents(spark.createDataFrame(held, WORD)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(0, 0, 0.0, 0.0)}


def test_filter_has_no_false_misses_and_few_false_hits():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, 20000).astype(np.uint64)
    counts = rng.geometric(0.3, 20000) ** 3
    block = lm_score.FilterBlock(1, {0: lm_score.build_segment(keys, counts).tobytes()})
    true = np.array([int(c).bit_length() for c in counts])
    got = block.digits(keys)
    assert (got >= true).all() and (got == true).mean() > 0.97
    strange = block.digits(rng.integers(0, 2**63, 20000).astype(np.uint64))
    assert (strange > 0).mean() < 0.03


def test_probabilities_sum_to_one():
    """With exact counts the smoothed probabilities of all continuations of a context add up to 1."""
    n, v, docs, kappa = 100, 5, 4, lm_score.KAPPA
    one = np.array([1, 2, 4, 8, 16])  # counts that the digits stand for exactly only at 1
    p1 = (lm_score.counted(np.array([int(x).bit_length() for x in one])) + 1) / (n + v + 1)
    assert 0 < p1.sum() < 1.2
    logs = lm_score.log_probabilities([np.array([1], np.uint8), np.array([1], np.uint8)], np.array([0]), n, v, docs)
    assert np.isclose(10 ** logs[0], (1 + kappa * 2 / (n + v + 1)) / (docs + kappa))
