"""Every row of the corpus pipeline against a plain version of its five stages."""

import hashlib
import random
import re
from collections import Counter

import brute
from test_contracts import tiktoken_rows

import corpus_pipeline
from morphospark.llm import decontam, pii, quality

SF001 = "/root/testdata/sf0.001"
ANY = {k: re.compile(getattr(quality, k), re.ASCII) for k in ("BOILERPLATE", "NAVIGATION", "MENU", "NOISE")}


def line_stays(line):
    end = re.sub(r"[\x09-\x0D]", " ", line).rstrip(" ")[-1:]
    return not end or end in quality.TERMINAL and not any(p.search(line) for p in ANY.values())


def cleaned(text):
    """The text without its failing lines; None if the document goes."""
    text = text or ""
    lines = text.split("\n")
    lost = sum(len(x) for x in lines if not line_stays(x))
    if brute.quality(text)[-1] or lost > quality.MAX_LOST * len(text):
        return None
    return "\n".join(x for x in lines if line_stays(x))


def leaks(text, item):
    own, w = decontam.words(text), decontam.words(item or "")
    least = min(decontam.MIN_WINDOW, len(w))
    if len(w) < decontam.MIN_ITEM or sum((Counter(own) & Counter(w)).values()) < decontam.MIN_SIMILARITY * least:
        return False
    for start in range(-len(w) + 1, len(own)):
        eq = [0 <= start + k < len(own) and own[start + k] == w[k] for k in range(len(w))]
        if sum(eq) >= decontam.MIN_SIMILARITY * least and any(
                sum(eq[a:b]) >= decontam.MIN_SIMILARITY * (b - a)
                for a in range(len(w)) for b in range(a + least, len(w) + 1)):
            return True
    return False


def redacted(text):
    spans = [(a, b, kind) for kind, a, b in brute.pii(text)[1]]
    for m in re.finditer(pii.PATTERNS["iban"], text):
        s = m[0].replace(" ", "")
        if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
            spans.append((m.start(), m.end(), "iban"))
    for m in re.finditer(pii.PATTERNS["ssn"], text):
        if re.search(pii.CONTEXT["ssn"], text[max(0, m.start() - pii.CONTEXT_CHARS):m.start()].lower()):
            spans.append((m.start(), m.end(), "ssn"))
    out, at = "", 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += f"{text[at:a]}[{kind.upper()}]"
        at = max(at, b)
    return out + text[at:]


def plain_pipeline(docs, items):
    """Rows of the last stage from (doc_id, text) pairs and benchmark texts."""
    good = {i: t for i, t in ((i, cleaned(t)) for i, t in docs) if t is not None}
    component = brute.components({i: brute.fingerprint(t) for i, t in good.items()})
    one = {i: t for i, t in good.items() if component[i] == i}
    clean = {i: t for i, t in one.items() if not any(leaks(t, x) for x in items)}
    return sorted(tiktoken_rows([(i, redacted(t)) for i, t in clean.items()]))


def rows(spark, folder):
    return sorted(tuple(r) for r in corpus_pipeline.run(spark, str(folder)).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())


def test_pipeline_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    got = rows(spark, SF001)
    assert 0 < len(got) < len(docs)
    assert got == plain_pipeline(docs, items)


def test_pipeline_planted_cases(spark, tmp_path):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    prose = lambda: "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(5))
    item = " ".join(word() for _ in range(30))
    texts = {i: prose() for i in range(1, 21)}
    texts[21] = texts[3]                                        # exact copy
    texts[22] = texts[4] + "\nHome | About | Contact | More"    # equal once its menu line is gone
    texts[23] = f"{prose()}\n{item}.\n{prose()}"                # benchmark passage
    texts[24] = "Home | About | Contact | More | Login\n" * 6   # no prose
    texts[25] = prose() + "\nWrite to some.one@example.org, or to 10.0.0.1."
    texts[26], texts[27] = None, ""
    cols = "doc_id long, text string, n_chars int, words string"
    data = [(i, t, len(t or ""), "x") for i, t in texts.items()] + [(5, texts[5], len(texts[5]), "x")]
    spark.createDataFrame(data, cols).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    got = rows(spark, tmp_path)
    assert got == plain_pipeline([(i, t) for i, t, *_ in data], [item, None, ""])
    assert [r[0] for r in got] == [*range(1, 21), 25]
    sha = {r[0]: r[3] for r in got}
    assert sha[25] == hashlib.sha256(texts[25].replace("some.one@example.org", "[EMAIL]").replace(
        "10.0.0.1", "[IP]").encode()).hexdigest()


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows(spark, tmp_path) == []
