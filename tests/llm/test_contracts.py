"""Every numbered query against a brute-force version, over whole tables and over hand-made edge cases."""

import hashlib
import random

import brute
import pytest

from morphospark.llm import (bpe, decontam, html_text, langid, licenses, pii, quality, queries, simhash,
                             suffix_dedup, urls)

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
PASSAGE = ("It is a long passage that several of these documents share, word for word, so that it must be found by "
           "whatever looks for repeated strings of two hundred bytes or more, even if other text is around it. ")
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "a b c d e a b c d e a b c d e"),
    (7, "Same line here.\nSame line here.\nOther line | with | many | bars |\nall rights reserved"),
    (8, "Mail a.b@c.de_x@y.zz 1.2.3.4.5 300.1.1.1 4111 1111 1111 1111 +1 (555) 123-4567 +12 +1234567"),
    (9, "card 4111-1111-1111-1111-2222-3333-4444 then 4111111111111111, 00000000000000000000"),
    (10, "THE MIT LICENSE the mit license, apache license version 2 and cc-by-nc; licenced under the MIT license"),
    (11, PASSAGE * 2 + "end one"), (12, "begin two " + PASSAGE), (13, "é" * 150 + PASSAGE + "ü" * 120),
    (14, "x" * 700), (15, "x" * 450 + "y"), (16, "begin two " + PASSAGE), (16, "begin two " + PASSAGE),
    (17, "IBAN DE89 3704 0044 0532 0130 00 and DE00 3704 0044 0532 0130 00; ssn 123-45-6789 x 123-45-6789"),
    (18, "\x1c odd\x85blanks\xa0 here  \n\n don't we'll 42 中文 😀😀 " + "w" * 3000),
    (19, "1" * 5000), (20, "a" * 4000 + "@"), (21, "😀 a@b.co 😀 10.0.0.1"), (22, "+1 " * 300),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "xx", "w") for i, t in EDGE], "doc_id long, text string, words string, row string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select("doc_id", *cols).collect())


def none_first(rows):
    return sorted(rows, key=lambda r: [(x is not None, x) for x in r])


def both(edge, docs):
    return [(edge, texts_of(edge)), (docs, texts_of(docs))]


def test_quality(edge, docs):
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for df, texts in both(edge, docs):
        got = quality.quality_report(df)
        assert rows_of(got, *cols) == sorted((i, *brute.quality(t)) for i, t in texts)
        assert got.filter("base_failed and kept").count() == 0


def test_quality_keeps_clean_and_rejects_noise(spark):
    clean = "A first sentence stands here with words.\nAnd a second one follows it, as prose does.\n" * 1
    noisy = "Home | About | Contact | More | Login\nword### word*** other&&& more%%% and### so***\n" * 3
    df = spark.createDataFrame([(1, clean + "All rights reserved.", 9), (2, noisy + clean, 9)],
                               "doc_id long, text string, n_chars int")
    out = quality.keep_good(df, max_lost=0.3).collect()
    assert [(r.doc_id, r.text, r.n_chars) for r in out] == [(1, clean.rstrip("\n"), len(clean) - 1)]


def test_licenses(edge, docs):
    cols = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    for df, texts in both(edge, docs):
        got = licenses.scan(df)
        assert none_first(rows_of_any(got, cols)) == none_first([(i, *brute.licences(t)) for i, t in texts])
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got.collect())


def rows_of_any(df, cols):
    return [tuple(r) for r in df.select("doc_id", *cols).collect()]


def test_license_templates(spark):
    t = licenses.TEMPLATES
    rows = [(i, f"Some words first. {texts[0]} And more after it.") for i, texts in enumerate(t.values())]
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i] for i, label in enumerate(t))


def test_pii(edge, docs):
    cols = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    for df, texts in both(edge, docs):
        got = pii.pii_report(df)
        assert rows_of(got, *cols) == sorted((i, *brute.pii(t)[0]) for i, t in texts)
        spans = sorted((r.doc_id, [x for x in r.spans.split(",") if x and x.split(":")[0] in pii.BASE_KINDS])
                       for r in got.collect())
        assert spans == sorted((i, [f"{k}:{a}:{b}" for k, a, b in brute.pii(t)[1]]) for i, t in texts)


def test_pii_adds_and_redacts(spark):
    text = dict(EDGE)[17]
    df = spark.createDataFrame([(1, text, len(text)), (2, "mail a@b.co, 10.0.0.1.", 22), (3, None, None)],
                               "doc_id long, text string, n_chars int")
    out = {r.doc_id: r for r in pii.pii_report(df).collect()}
    assert [x.split(":")[0] for x in out[1].spans.split(",")] == ["iban", "ssn", "ssn"]
    red = {r.doc_id: r for r in pii.redact(df).collect()}
    assert red[2].text == "mail [EMAIL], [IP]." and red[2].n_chars == 19
    assert red[3].text is None
    assert red[1].text.startswith("IBAN [IBAN] and DE00")


def test_pii_many_spans_in_one_text(spark):
    text = "a@b.co 10.0.0.1 " * 700
    got = pii.pii_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.n_email, got.n_ip, got.base_sha256) == (700, 700, brute.pii(text)[0][4])


def test_simhash(edge, docs):
    for df, texts in both(edge, docs):
        fps = {i: brute.fingerprint(t) for i, t in texts}
        want = brute.components(fps)
        got = rows_of(simhash.near_duplicates(df), "fingerprint", "component_id")
        assert got == sorted((i, f"{fps[i]:016x}", want[i]) for i, _ in texts)


def test_simhash_tiles_and_chains(spark, tmp_path):
    """Small tiles force several pieces and piece pairs; a long chain forces several rounds of stars."""
    from morphospark.llm.common import Workspace

    rng = random.Random(3)
    fps = {i: rng.getrandbits(64) & 0xFF00FF0000000FFF for i in range(400)}
    at = rng.getrandbits(64)
    for i in range(400, 520):
        at ^= 1 << rng.randrange(64)
        fps[i] = at
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in set(fps.values())], "fp long")
    ws = Workspace(spark, "t")
    got = simhash.links(df, ws, tile=16).collect()
    assert all(((r.u ^ r.v) & (2 ** 64 - 1)).bit_count() <= 3 for r in got)
    back = {signed(x): i for i, x in reversed(fps.items())}
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in got:
        a, b = sorted((find(back[r.u]), find(back[r.v])))
        parent[b] = a
    want = brute.components(fps)
    assert {i: find(back[signed(x)]) for i, x in fps.items()} == want
    edges = spark.createDataFrame([(back[r.u], back[r.v]) for r in got], "u long, v long")
    roots = {r.node: r.root for r in simhash.star_components(edges, ws).collect()}
    assert all(roots.get(back[signed(x)], back[signed(x)]) == want[i] for i, x in fps.items())


def test_keep_one(edge):
    kept = simhash.keep_one(edge).collect()
    ids = [r.doc_id for r in kept]
    comp = {r.doc_id: r.component_id for r in simhash.near_duplicates(edge).collect()}
    assert sorted(ids) == sorted(set(comp.values()))
    assert kept[0].asDict().keys() == set(edge.columns)


def tiktoken_rows(texts):
    import public_tokenizers as P
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                            mergeable_ranks=bpe.load_ranks(P.path(bpe.VOCABULARY)))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for i, t in texts:
        ids = enc.encode_ordinary(t or "")
        yield i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())


def test_bpe(edge, docs):
    for df, texts in both(edge, docs):
        got = rows_of(bpe.digests(df), "n_tokens", "ids_sha256", "decoded_sha256")
        assert got == sorted(tiktoken_rows(texts))


def test_bpe_random_strings(spark):
    rng = random.Random(5)
    letters = "\x1c\xa0\x85aab \n\t'sé中文😀0123   .,!()-_ABCth"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))) for i in range(3000)]
    got = rows_of(bpe.digests(spark.createDataFrame(rows, "doc_id long, text string")), "n_tokens", "ids_sha256",
                  "decoded_sha256")
    assert got == sorted(tiktoken_rows(rows))


def test_bpe_round_trip_and_split_characters(edge):
    encoded = bpe.encode(edge)
    back = {r.doc_id: r.text for r in bpe.decode(encoded).collect()}
    assert all(back[i] == (t or "") for i, t in EDGE)
    import public_tokenizers as P

    table = bpe._loaded(P.path(bpe.VOCABULARY), P.PATTERN)[1]
    for r in encoded.collect():
        assert "".join(bpe.decode_stream(r.ids, table)) == (dict(EDGE)[r.doc_id] or "")
        assert not r.ids or r.ends[-1] == len((dict(EDGE)[r.doc_id] or "").encode())


def test_bpe_chunks_change_nothing():
    import public_tokenizers as P

    model, _, shown, split, _ = bpe._loaded(P.path(bpe.VOCABULARY), P.PATTERN)
    text = ("word  and\n\n more,  \t x " * 50 + "é " * 7) * 3
    whole = bpe._encoded([text], model, shown, split, {})
    saved, bpe.CHUNK = bpe.CHUNK, 16
    try:
        assert "".join(bpe.chunks(text, 16)) == text
        assert [tuple(k for p in bpe.chunks(text, 16) for k in bpe._encoded([p], model, shown, split, {})[0])] == [
            tuple(whole[0])]
    finally:
        bpe.CHUNK = saved


def test_suffix_dedup(edge, docs):
    for df, texts in both(edge, docs):
        got = rows_of(suffix_dedup.dedup(df), "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == sorted((i, *r) for (i, _), r in zip(texts, brute.repeated([t for _, t in texts])))


def test_suffix_dedup_hot_anchor_and_levels(spark):
    """Many different continuations of one passage: groups are halved; small batches build and merge levels."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 40))) + PASSAGE[rng.randint(0, 30):]
              + "".join(rng.choice(["same tail here ", "other tail "]) for _ in range(rng.randint(0, 3)))
              + " ".join(word() for _ in range(40))) for i in range(120)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted((i, *r) for (i, _), r in zip(texts, brute.repeated([t for _, t in texts])))
    for batches, size in ((7, 4000), (1, 1 << 18), (3, 600)):
        got = rows_of(suffix_dedup.dedup(df, batches, size), "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == want


def test_suffix_dedup_long_text_blocks(spark, monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice("abcd ") for _ in range(6000))
    texts = [(1, text + text[1000:1900]), (2, text[3000:3300] + "zz")]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    suffix_dedup._TABLES.clear()
    first, last, _, _ = suffix_dedup.stretches(texts[0][1].encode())
    suffix_dedup._TABLES.clear()
    assert first[0] == 0 and last[-1] == len(texts[0][1]) and (first[1:] <= last[:-1] - 199).all()
    assert sum(b - a - 199 for a, b in zip(first, last)) == len(texts[0][1]) - 199


def test_language(docs):
    got = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id")
    held = got.filter("held_out and lang is not null").selectExpr("avg(int(lang = lang_pred)) a", "count(*) n").first()
    assert held.n > 100 and held.a > 0.97
    assert got.filter("score < 0 or score > 1").count() == 0


def test_language_edges(spark, edge):
    learning = spark.createDataFrame([(i, "the quick brown fox jumps " * 3, "en") for i in range(40)]
                                     + [(i, "der schnelle braune Fuchs springt " * 3, "de") for i in range(40, 80)],
                                     "doc_id long, text string, lang string")
    model = langid.fit(learning)
    got = {r.doc_id: r for r in langid.predict(edge, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 19)] == ["und"] * 4 and got[1].score == 0
    empty = learning.filter("false")
    assert langid.predict(edge, langid.fit(empty)).filter("lang_pred <> 'und'").count() == 0
    same = langid.predict(learning.limit(60), model).join(learning, "doc_id")
    assert same.count() == 60 and same.filter("lang_pred <> lang or not accepted").count() == 0
    odd = spark.createDataFrame([(1, "zzzz qqqq xxxx")], "doc_id long, text string")
    assert not langid.predict(odd, model).first().accepted


def brute_leaks(texts, items):
    out = []
    for d, t in texts:
        own = decontam.words(t or "")
        for item, it in items:
            w = decontam.words(it or "")
            if len(w) < decontam.MIN_ITEM:
                continue
            best = 0
            for start in range(-len(w) + 1, len(own)):
                eq = [0 <= start + k < len(own) and own[start + k] == w[k] for k in range(len(w))]
                for a in range(len(w)):
                    for b in range(a + min(decontam.MIN_WINDOW, len(w)), len(w) + 1):
                        if sum(eq[a:b]) >= decontam.MIN_SIMILARITY * (b - a):
                            best = 1
            if best:
                out.append((d, item))
    return sorted(out)


def test_leaks(spark):
    rng = random.Random(11)
    word = lambda: rng.choice("lorem ipsum dolor sit amet consectetur elit sed do magna aliqua ut enim".split())
    items = [(i, " ".join(word() for _ in range(rng.randint(4, 24)))) for i in range(8)] + [(8, None), (9, "")]
    texts = [(1, None), (2, "")]
    for i in range(3, 40):
        base = [word() for _ in range(rng.randint(5, 30))]
        if i % 2:
            leak = rng.choice(items[:8])[1].split()
            leak = [w if rng.random() > 0.15 else "zzz" for w in leak]
            base[3:3] = leak
        texts.append((i, ". ".join(base) if i % 3 else " ".join(base)))
    d = spark.createDataFrame(texts, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontam.find_leaks(d, b).collect())
    want = brute_leaks(texts, items)
    assert got == want and len(got) > 10
    kept = {r.doc_id for r in decontam.drop_leaks(d, b).collect()}
    assert kept == {i for i, _ in texts} - {i for i, _ in got}


def test_leaks_with_replaced_words(spark):
    item = " ".join(f"w{i}" for i in range(40))
    for every in (3, 5):
        words = item.split()
        sub = [w if i % every else "zzz" for i, w in enumerate(words)]
        d = spark.createDataFrame([(1, "start " + " ".join(sub) + " end")], "doc_id long, text string")
        got = decontam.find_leaks(d, spark.createDataFrame([(1, item)], "item_id long, text string")).count()
        assert got == (1 if every == 5 else 0)


def test_leaks_whole_table(spark, docs):
    bench = spark.read.parquet(f"{SF01}/benchmark.parquet")
    got = {r.doc_id for r in decontam.find_leaks(docs, bench).collect()}
    items = [r.text for r in bench.collect()]
    exact = {i for i, t in texts_of(docs) if any(x in t for x in items)}
    assert exact and exact <= got


HTML = [
    (1, None, ""), (2, "", ""), (3, "plain &amp; simple", "plain & simple"),
    (4, "<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\nd"),
    (5, "<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "- a\n  - b\n  - c\n- d"),
    (6, "<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
    (7, "<table><tr><th>Name<th>Qty<tr><td>Apple<td>3<tr><td>Kiwi more<td>14</table>",
     "Name       Qty\nApple      3\nKiwi more  14"),
    (8, "<script>var x='<p>no</p>'</script><style>p{}</style>a<!-- c --><span hidden>no</span>"
        "<b style='display: none'>no</b> b", "a b"),
    (9, "<pre>  x\n   y</pre>z", "  x\n   y\n\nz"), (10, "a<br>b<br><br>c", "a\nb\n\nc"),
    (11, "<div>" * 3000 + "deep" + "</div>" * 10, "deep"), (12, "a < b <3 & c &bogus; <", "a < b <3 & c &bogus; <"),
    (13, "<head><title>t</title></head><body>b", "b"), (14, "<td>loose</td><td>cells</td>", "loose\ncells"),
]


def test_html(spark):
    df = spark.createDataFrame([(i, f"u{i}", h, "x") for i, h, _ in HTML],
                               "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got == {i: want for i, _, want in HTML}


def test_urls(spark):
    captures = spark.createDataFrame([
        (1, "http://blog.bad.com/x/y?q", "2024-02-01"), (2, "http://blog.bad.com/x/y?q", "2024-03-05"),
        (3, "https://ok.org/ads/1", "2024-02-01"), (4, "https://ok.org/news", "2024-02-01"), (5, None, "2024-02-01"),
        (6, "not a url", "2024-02-01"), (7, "http://BAD.com:80/", None), (8, "http://u@bad.com/", "2024-06-01"),
        (8, "http://u@bad.com/", "2024-06-01"), (None, "http://bad.com", "2024-01-01"),
    ], "page_id long, url string, fetch_day string").selectExpr("page_id", "url", "date(fetch_day) fetch_day")
    entries = spark.createDataFrame([
        ("bad.com", "add", "2024-01-01"), ("bad.com", "remove", "2024-03-01"), ("bad.com", "add", "2024-05-01"),
        ("bad.com", "add", "2024-05-20"), ("ok.org/ads", "add", "2024-01-15"), (None, "add", "2024-01-01"),
        ("ok.org", "add", None), ("ok.org", "add", "2024-02-02"),
    ], "pattern string, action string, day string").selectExpr("pattern", "action", "date(day) day")
    got = sorted(((r.page_id or 0, r.blocked, r.pattern, str(r.listed_since)) for r in
                  urls.judge(captures, entries).collect()))
    assert got == [(0, True, "bad.com", "2024-01-01"), (1, True, "bad.com", "2024-01-01"), (2, False, None, "None"),
                   (3, True, "ok.org/ads", "2024-01-15"), (4, False, None, "None"), (5, False, None, "None"),
                   (6, False, None, "None"), (7, False, None, "None"), (8, True, "bad.com", "2024-05-01"),
                   (8, True, "bad.com", "2024-05-01")]
    assert urls.judge(captures, entries.filter("false")).filter("blocked").count() == 0


def test_empty_tables(spark, edge):
    none = edge.filter("false")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (quality.quality_report(none), langid.identify(none.selectExpr("doc_id", "text", "words lang")),
               licenses.scan(none), html_text.extract(pages), urls.judge(queries.captures(pages), queries.listing(pages)),
               pii.pii_report(none), simhash.near_duplicates(none), bpe.digests(none),
               decontam.find_leaks(none, bench), suffix_dedup.dedup(none)):
        assert df.count() == 0 and len(df.columns) >= 3
    assert decontam.find_leaks(edge, bench).count() == 0 and decontam.drop_leaks(edge, bench).count() == len(EDGE)
