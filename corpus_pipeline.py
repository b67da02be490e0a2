"""A corpus pipeline of five operators: cleaning, near-duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  All but the last return the columns of ``documents``; the last returns
one row of tokens per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from morphospark.llm import bpe, decontam, pii, quality, simhash
from morphospark.llm.common import Workspace, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; so do documents that fail the base rules or lose too much text.

    A null or empty text fails; repeated rows are each judged; other columns,
    whatever their names, stay as they are, but for ``n_chars``, which is counted anew.
    """
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that fingerprints of three-word shingles at most three bits apart link.

    The smallest doc_id stays, rows without one last, then the first text; null
    and empty texts are one group, repeated rows too.
    """
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; a null text holds none, and a null item is in none."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind; a null text stays null."""
    return pii.redact(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of the bytes they decode to; a null text has none."""
    return bpe.digests(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: Fingerprints, leak search and tokens cannot be put in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ws = Workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = ws.stage(stage(spark, docs, sf_dir), name)
        if k:
            ws.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
