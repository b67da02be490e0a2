"""Personal data: regular expressions propose, checksums confirm, context adjusts.

DataFrame functions only, all inside the row: no shuffle.  Positions are code
points, ends exclusive; they come from the lengths of the pieces between the
matches.  Proposals are leftmost and never overlap within a kind; a proposal
that its validator drops is not retried.

Edge cases: a null text counts as empty and has no span; long texts are scanned
whole; repeated rows are each scanned; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, text_or_empty

#: Kinds in the order of the span list.  The patterns are those of the contract, written so that the Java
#: engine scans a run of characters once: no start inside a run, possessive loops, digit counts in place.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": (r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
             r"(?![A-Za-z0-9])"),
    "ssn": r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE_KINDS = ("email", "ip", "card", "phone")
#: Score of a confirmed span without context, and the words that raise it when one stands shortly before.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT = {
    "email": r"mail|contact|write to|courriel|correo|kontakt",
    "ip": r"\bip\b|address|server|host|adresse",
    "card": r"card|visa|credit|kredit|carte|tarjeta|payment",
    "phone": r"phone|tel|call|fax|mobile|handy|appel|llama",
    "iban": r"iban|account|konto|compte|cuenta|bank",
    "ssn": r"ssn|social security|tax id|taxpayer",
}
CONTEXT_BONUS = 0.1
#: A kind without checksum that is only a digit pattern needs its context word to count.
SSN_BONUS = 0.4
MIN_SCORE = 0.5
CONTEXT_CHARS = 40
BLOCK = 256
_SPAN = "array<struct<s:int,e:int,v:string>>"


def _located(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` as array<struct<s, e, v>>.

    Start positions are a running sum over pieces and matches, taken in blocks
    so that a text with very many matches does not copy its whole list at each.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    steps = F.zip_with(F.transform(pieces, F.length), found,
                       lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    steps = F.filter(steps, lambda x: x["m"].isNotNull())

    def step(acc, x):
        start = acc["pos"] + x["p"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(
            start.alias("s"), end.alias("e"), x["m"].alias("v")))).alias("out"))

    def block(acc, rows):
        inner = F.aggregate(rows, F.struct(acc["pos"].alias("pos"), F.array().cast(_SPAN).alias("out")), step)
        return F.transform(F.array(inner), lambda r: F.struct(
            r["pos"].alias("pos"), F.concat(acc["out"], F.array(r["out"])).alias("out")))[0]

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")),
                         lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.flatten(F.aggregate(blocks, zero, block)["out"])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn_ok(v: Column) -> Column:
    rev = F.reverse(_digits(v))

    def add(total, i):
        d = rev.substr(i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(rev)), F.lit(0), add) % 10 == 0


def mod97_ok(v: Column) -> Column:
    s = F.regexp_replace(v, " ", "")
    turned = F.concat(s.substr(F.lit(5), F.length(s)), s.substr(F.lit(1), F.lit(4)))

    def add(rest, i):
        c = F.ascii(turned.substr(i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _small_parts(v: Column) -> Column:
    def small(p):
        p = F.regexp_replace(p, "^0+", "")
        return (F.length(p) <= 2) | ((F.length(p) == 3) & (p <= "255"))

    return F.forall(F.split(v, r"\."), small)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": _small_parts,
    "card": luhn_ok,
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
    "iban": mod97_ok,
    "ssn": lambda v: F.lit(True),
}
#: A character without which a text cannot hold a match of the kind.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-"}
_QUICK = {"card": r"[0-9](?:[ -]?[0-9]){15}", "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
          "ip": r"[0-9]\.[0-9]", "ssn": r"[0-9]-[0-9]{2}-[0-9]", "email": r"@[A-Za-z0-9-]++\.", "phone": r"\+[0-9]"}


def _scored(kind: str) -> Column:
    """Confirmed spans of one kind with their scores; weak kinds need their context to be there at all."""
    bonus = SSN_BONUS if kind == "ssn" else CONTEXT_BONUS

    def score(x):
        start = F.greatest(x["s"] - CONTEXT_CHARS, F.lit(0))
        near = F.lower(F.col("text").substr(start + 1, x["s"] - start))
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"),
                        F.when(near.rlike(CONTEXT[kind]), F.lit(round(SCORES[kind] + bonus, 2)))
                        .otherwise(F.lit(SCORES[kind])).alias("score"))

    good = F.transform(F.filter(f"raw_{kind}", lambda x: VALID[kind](x["v"])), score)
    return good if kind in BASE_KINDS else F.filter(good, lambda x: x["score"] >= MIN_SCORE)


def find_spans(docs: DataFrame) -> DataFrame:
    """(row, text, spans) with spans array<struct<kind, s, e, score>>, by kind as listed, then start."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_or_empty().alias("text"))
    none = F.array().cast(_SPAN)
    for kind, pattern in PATTERNS.items():
        may = F.col("text").rlike(_QUICK[kind])
        if _NEEDS[kind]:
            may = F.contains(F.col("text"), F.lit(_NEEDS[kind])) & may
        d = d.withColumn(f"raw_{kind}", F.when(may, _located(F.col("text"), pattern)).otherwise(none))
    return settled(d.select("row", "text", F.concat(*[_scored(kind) for kind in PATTERNS]).alias("spans")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    d = find_spans(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return d.select(
        F.col("row.doc_id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda x: F.format_number(x["score"], 2)), ",").alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """Documents with every span replaced by its kind in brackets; overlapping spans become one."""
    d = find_spans(docs)
    ordered = F.sort_array(F.transform("spans", lambda x: F.struct(x["s"], x["e"], x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        fresh = x["s"] >= acc["pos"]
        put = F.when(fresh, F.array(F.col("text").substr(acc["pos"] + 1, x["s"] - acc["pos"]),
                                    F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))
        return F.struct(F.greatest(x["e"], acc["pos"]).alias("pos"),
                        F.concat(acc["out"], F.coalesce(put, F.array().cast("array<string>"))).alias("out"))

    d = d.withColumn("done", F.when(F.size("spans") > 0, F.aggregate(ordered, start, step)))
    new = F.when(F.col("done").isNull(), F.col("row.text")).otherwise(
        F.concat(F.array_join("done.out", ""), F.col("text").substr(F.col("done.pos") + 1, F.length("text"))))
    return d.select(*[new.alias(c) if c == "text"
                      else F.when(F.col("done").isNull(), F.col(f"row.`{c}`"))
                      .otherwise(F.length(new).cast(docs.schema[c].dataType)).alias(c) if c == "n_chars"
                      else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
