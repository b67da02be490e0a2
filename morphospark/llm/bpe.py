"""Byte-level BPE with the tokenizers library over Arrow batches, and its decoding.

A rank file (base64 token, rank) becomes a tokenizers model: each byte is shown
as a printable character (the byte table), each token's merge is the pair into
which the lower ranks split it, and whole words that are tokens are taken as
they are.  Each match of the split pattern is encoded by itself.  Decoding reverses the byte table; a character split over tokens is
put together again because bytes are joined before they are read as UTF-8.

Long texts are encoded in chunks cut before a blank that follows a non-blank.
No match of the split pattern spans such a place and its look-ahead never
passes it, so the ids are those of the whole text and memory stays bounded.

Edge cases: a null or empty text has no ids and decodes to no bytes; repeated
rows are each encoded; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_or_empty

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK = 1 << 16
#: Pieces whose ids a task remembers before it starts anew.
MAX_KNOWN = 300_000
#: Rows whose ids are held at a time.
ROWS = 256
#: A longer run is encoded each time instead of being kept.
MAX_RUN = 64
_CUT = re.compile(r"(?<=\S)(?=[ \n\t\r])")
_RUN = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: Blanks of Unicode beyond those four; a text with one is split whole.
_ODD_BLANK = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def byte_table() -> list[str]:
    """Character for each byte: printable Latin-1 stands for itself, the rest from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return [chr(b) if b in set(printable) else chr(0x100 + rest.index(b)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _parts(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What the merges of lower rank than the token's own make of it."""
    own = ranks[token]
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = min(((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1)))
        if best >= own:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def build(path: str):
    """The tokenizers model of a rank file; it takes the matches of the split pattern one by one."""
    from tokenizers import models

    ranks = load_ranks(path)
    shown = byte_table()
    name = {t: "".join(shown[b] for b in t) for t in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            parts = _parts(token, ranks)
            if len(parts) == 2:
                merges.append((name[parts[0]], name[parts[1]]))
    return models.BPE(vocab={name[k]: r for k, r in ranks.items()}, merges=merges, ignore_merges=True)


def token_bytes(path: str, model) -> list[bytes]:
    """Bytes of each id, by reversing the byte table on the model's own token strings."""
    back = {c: b for b, c in enumerate(byte_table())}
    return [bytes(back[c] for c in model.id_to_token(i)) for i in range(max(load_ranks(path).values()) + 1)]


def chunks(text: str, size: int = CHUNK):
    """Pieces of about ``size`` characters; every cut stands before a blank that follows a non-blank."""
    at = 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if not m:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


def decode_stream(ids, table):
    """Text of ids one by one: a character split over tokens comes out with its last byte."""
    import codecs

    reader = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        yield reader.decode(table[i])
    yield reader.decode(b"", True)


def _encoded(texts, model, shown, split, known):
    """Ids of each text.

    Texts repeat their words, so a task splits and encodes only the runs of
    blanks plus one word that it has not met and keeps their ids, up to
    ``MAX_KNOWN`` of them.
    """
    blank = shown[32]

    def piece_ids(x):
        """Ids of one match of the split pattern."""
        if x.isascii() and x[-1:].isalpha():  # a word: only its leading space needs the table
            x = blank + x[1:] if x[0] == " " else x
        else:
            x = x.encode().decode("latin-1").translate(shown)
        return tuple([k.id for k in model.tokenize(x)])

    def run_ids(x):
        word = x[1:] if x[0] == " " else x
        if word.isalpha():  # letters with at most a space before them are one match
            return piece_ids(x)
        if word[-1:] in (".", ",", ";", ":", "!", "?") and word[:-1].isalpha():
            both = [known.get(y) or known.setdefault(y, piece_ids(y)) for y in (x[:-1], x[-1])]
            return both[0] + both[1]
        return tuple(k for y in split(x) for k in piece_ids(y))

    out = []
    for text in texts:
        ids: list[int] = []
        for part in chunks(text):
            for x in [part] if _ODD_BLANK.search(part) else _RUN.findall(part):
                own = known.get(x)
                if own is None:
                    own = run_ids(x) if x else ()
                    if len(x) <= MAX_RUN:
                        known[x] = own
                ids += own
        if len(known) > MAX_KNOWN:
            known.clear()
        out.append(ids)
    return out


_LOADED: dict = {}


def _loaded(path, pattern):
    """What a Python worker keeps over its tasks: model, byte tables, splitter, known pieces."""
    import regex

    if (path, pattern) not in _LOADED:
        model = build(path)
        shown = {b: c for b, c in enumerate(byte_table())}
        _LOADED[path, pattern] = (model, token_bytes(path, model), shown, regex.compile(pattern).findall, {})
    return _LOADED[path, pattern]


def _map(docs: DataFrame, schema: str, per_batch, path: str | None, pattern: str | None) -> DataFrame:
    import public_tokenizers as P

    path, pattern = path or P.path(VOCABULARY), pattern or P.PATTERN
    def run(batches):
        model, table, shown, split, known = _loaded(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                yield per_batch(rows.column(0), _encoded(rows.column(1).to_pylist(), model, shown, split, known), table)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids, ends: the byte offset at which each token ends."""
    def per_batch(doc_ids, ids, table):
        ends = []
        for own in ids:
            at, row = 0, []
            for i in own:
                at += len(table[i])
                row.append(at)
            ends.append(row)
        return pa.RecordBatch.from_arrays(
            [doc_ids, pa.array(ids, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int64()))],
            names=["doc_id", "ids", "ends"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _map(docs, f"doc_id {kind}, ids array<int>, ends array<bigint>", per_batch, path, pattern)


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None,
            with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids): encoded, decoded again, and both hashed."""
    def per_batch(doc_ids, ids, table):
        n = [len(x) for x in ids]
        text_hash = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]
        byte_hash = [hashlib.sha256(b"".join([table[i] for i in x])).hexdigest() for x in ids]
        cols = {"doc_id": doc_ids, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(text_hash, pa.string()),
                "decoded_sha256": pa.array(byte_hash, pa.string())}
        if with_ids:
            cols["ids"] = pa.array(ids, pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _map(docs, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
                + ", ids array<int>" * with_ids, per_batch, path, pattern)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, text from (doc_id, ids); bytes that are no UTF-8 become the replacement character."""
    import public_tokenizers as P

    path, pattern = path or P.path(VOCABULARY), pattern or P.PATTERN

    def run(batches):
        table = _loaded(path, pattern)[1]
        for batch in batches:
            texts = [None if x is None else b"".join([table[i] for i in x]).decode("utf-8", "replace")
                     for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


__all__ = ["build", "byte_table", "chunks", "decode", "decode_stream", "digests", "encode", "token_bytes"]
