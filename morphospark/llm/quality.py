"""Line-first quality rules, with DataFrame functions only.

Each line is judged on its own by a punctuation, a navigation and a
boilerplate rule; failing lines go, and a document that loses more than
``max_lost`` of its characters to them is rejected.  Everything is computed
inside the row, so there is no shuffle and a hot source or key changes nothing.

Edge cases: a null or empty text has no words and fails the base rule; texts of
any length are handled whole; repeated rows are judged alike, each for itself;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, squeezed, text_or_empty, words_of

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOST = 0.3

#: Line ends that count as the end of a sentence.
TERMINAL = [".", "!", "?", "…", ":", ";", ")", "]", '"', "'", "”", "’", "»", "。", "！", "？",
            "」", "』", "》", "）", "；", "：", "।", "॥", "؟", "۔", "؛", "።", "։", "។", "။"]
#: Three or more runs of doubled symbols in a line: markup or shouting, not prose.
NOISE = r"(?:[#*$%&<>!=~^]{2,}[^#*$%&<>!=~^]+){2}[#*$%&<>!=~^]{2,}"
#: Three or more separators in a line: a menu, a breadcrumb trail or a table row.
NAVIGATION = r"(?:[|»›•→][^|»›•→]*+){3}"
#: A whole line of menu words.
MENU = (r"(?i)^\W*(?:(?:home|menu|login|log in|sign in|sign up|register|search|contact|about|next|"
        r"previous|back|share|print|top|more|skip to content)\W*)+$")
#: Phrases of legal and site boilerplate.
BOILERPLATE = (r"(?i)all rights reserved|tous droits r[ée]serv[ée]s|alle rechte vorbehalten|"
               r"todos los derechos reservados|privacy policy|cookie policy|uses? cookies|"
               r"terms of (?:use|service)|subscribe to our|enable javascript|lorem ipsum|^\W*(?:©|copyright )")


def _line_verdict(line: Column) -> Column:
    """'' for a line that stays, else the rule that removes it; blank lines stay."""
    end = F.substring(F.rtrim(F.regexp_replace(line, r"[\x09-\x0D]", " ")), -1, 1)
    return (F.when(end == "", F.lit(""))
            .when(line.rlike(BOILERPLATE), F.lit("boilerplate"))
            .when(line.rlike(NAVIGATION) | line.rlike(MENU), F.lit("navigation"))
            .when(~end.isin(TERMINAL) | line.rlike(NOISE), F.lit("punctuation"))
            .otherwise(F.lit("")))


def clean_lines(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """(row, doc_id, cleaned, base signals, line counts, verdicts) for every row of ``docs``.

    ``row`` is the input row as a struct, so its columns cannot clash with ours.
    """
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                    F.col("doc_id"), text_or_empty().alias("text"))
    d = d.withColumn("squeezed", squeezed(F.col("text")))
    d = d.withColumn("words", words_of(F.col("squeezed")))
    d = d.withColumn("lines", F.split("text", "\n"))
    n = F.size("words")

    def window_hash(i: Column) -> Column:
        return F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)])

    d = d.select(
        "*", n.cast("long").alias("n_words"),
        F.when(n == 0, F.lit(0)).otherwise(F.length("squeezed") - n + 1).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS.replace("[", "[^"), "")).cast("long").alias("n_symbols"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window_hash))
        .otherwise(F.array().cast("array<bigint>")).alias("windows"),
        F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("full_lines"),
        F.transform("lines", lambda x: F.struct(_line_verdict(x).alias("rule"), F.length(x).alias("chars"),
                                                x.alias("line"))).alias("judged"))
    # Only a text with a repeated window sorts its windows to find where the repeats stand.
    d = d.withColumn("ranked", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))))
        .otherwise(F.array().cast("array<struct<h:bigint,at:int>>")))
    d = d.withColumn("starts", F.sort_array(F.transform(
        F.filter(F.transform("ranked", lambda x, i: F.struct(
            x["at"].alias("at"),
            (F.coalesce(F.get("ranked", i - 1)["h"] == x["h"], F.lit(False))
             | F.coalesce(F.get("ranked", i + 1)["h"] == x["h"], F.lit(False))).alias("twice"))),
            lambda x: x["twice"]), lambda x: x["at"])))
    covered = F.transform("starts", lambda x, i: F.least(
        F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - x, F.lit(WINDOW))).cast("long"))
    rule_count = lambda rule: F.size(F.filter("judged", lambda x: x["rule"] == rule)).cast("long")
    d = d.select(
        "row", "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        rule_count("punctuation").alias("n_punctuation_lines"),
        rule_count("navigation").alias("n_navigation_lines"),
        rule_count("boilerplate").alias("n_boilerplate_lines"),
        F.aggregate("judged", F.lit(0).cast("long"),
                    lambda a, x: a + F.when(x["rule"] != "", x["chars"]).otherwise(0)).alias("lost_chars"),
        F.length("text").cast("long").alias("n_chars"),
        F.array_join(F.transform(F.filter("judged", lambda x: x["rule"] == ""), lambda x: x["line"]), "\n")
        .alias("cleaned"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    d = d.withColumn("base_failed", failed)
    return settled(d.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= F.lit(max_lost) * F.col("n_chars"))))


def quality_report(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """One row per document: base signals, lines removed by each rule, and the verdict."""
    return clean_lines(docs, max_lost).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_punctuation_lines", "n_navigation_lines", "n_boilerplate_lines", "lost_chars")


def keep_good(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """Documents that pass, with the text left after line cleaning; all columns stay."""
    kept = clean_lines(docs, max_lost).filter("kept")
    return kept.select(*[F.col("cleaned").alias(c) if c == "text"
                         else F.length("cleaned").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
                         else F.col("row").getField(c).alias(c) for c in docs.columns])
