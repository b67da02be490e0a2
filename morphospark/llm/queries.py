"""The numbered queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, decontam, html_text, langid, licenses, lm_score, merkle, pii, quality, simhash, spelling,
               suffix_dedup, urls)
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


#: The base phrases of the contract and their labels.
LICENSE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), LICENSE_PHRASES)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def _number(*parts):
    """A number below 2^32 from the MD5 of a text: the same in Spark and in SQL."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("long")


def captures(pages: DataFrame) -> DataFrame:
    """Captures (page_id, url, fetch_day): pages carry no date, so their id gives each a day of 2024."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (_number(F.lit("day"), F.col("page_id").cast("string"))
                                                        % 365).cast("int"))
    return pages.select("page_id", "url", day.alias("fetch_day"))


def listing(pages: DataFrame) -> DataFrame:
    """Dated list entries for a part of the hosts and of the first paths that the pages have.

    A quarter of the hosts is added, taken off and added again; so is a sixth of
    the pairs of host and first path.  The same rule in SQL is in the oracle.
    """
    host = urls.host_of(F.col("url"))
    keys = pages.select(host.alias("host"), F.get(F.filter(F.split(urls.path_of(F.col("url")), "/"),
                                                           lambda x: x != ""), F.lit(0)).alias("first"))
    hosts = keys.filter("host <> ''").select(F.col("host").alias("pattern"), F.lit(4).alias("every"))
    paths = keys.filter("host <> '' and first is not null").select(
        F.concat_ws("/", "host", "first").alias("pattern"), F.lit(6).alias("every"))
    chosen = hosts.unionByName(paths).distinct().filter(_number(F.lit("pick"), F.col("pattern")) % F.col("every") == 0)
    start = (_number(F.lit("add"), F.col("pattern")) % 200).cast("int")
    pause = start + 20 + (_number(F.lit("off"), F.col("pattern")) % 60).cast("int")
    again = pause + 20 + (_number(F.lit("again"), F.col("pattern")) % 100).cast("int")
    origin = F.lit("2024-01-01").cast("date")
    return chosen.select("pattern", F.explode(F.array(*[
        F.struct(F.lit(a).alias("action"), F.date_add(origin, d).alias("day"))
        for a, d in (("add", start), ("remove", pause), ("add", again))])).alias("e")).select(
            "pattern", "e.action", "e.day")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(captures(pages), listing(pages))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_language_id, op3_license_scan, op4_html_extraction, op5_url_filter, op6_pii, op7_simhash,
    op8_byte_bpe, op9_decontamination, op10_suffix_dedup, op11_merkle_manifest, op12_spelling_variants, op13_lm_score)}
