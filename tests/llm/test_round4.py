"""Fixes of the round after r03."""

import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from morphospark.llm import licenses, queries, suffix_dedup
from morphospark.llm.common import Workspace


def test_license_phrases_of_the_contract(spark, tmp_path):
    texts = ["the MIT license", "It is under the MIT License, and the mit license; UNDER THE MIT LICENSE", None,
             "under the mit licence", "apache license version 2 cc-by-nc"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op3_license_scan(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == [
        (3, 0, None, None, ""), (14, 2, 2, 10, "mit"), (0, 0, None, None, ""), (4, 0, None, None, ""),
        (7, 2, 0, 4, "apache-2,cc-by-nc")]


def test_license_phrases_of_a_word(spark):
    df = spark.createDataFrame([(1, "mit or mpl, by mit")], "doc_id long, text string")
    r = licenses.scan(df, {"mit": "mit", "by mit": "by-mit"}).first()
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (3, 0, 4, "by-mit,mit")


def test_a_level_takes_four_bytes_a_window_besides_its_text():
    rng = np.random.default_rng(0)
    bodies = [rng.integers(97, 101, 3000, np.uint8).tobytes() for _ in range(4)]
    t = pa.table({"body": bodies, "a": pa.array([2000] * 4, pa.int32()), "p": pa.array([0] * 4, pa.int32()),
                  "q": pa.array([2001] * 4, pa.int32()), "s1": pa.array(range(4), pa.int64()), "s2": pa.array([7] * 4, pa.int64())})
    level = suffix_dedup.Level.build(t)
    table = level.table(3)
    assert table.nbytes <= 4 * 3000 + 4 * len(level.place) + 500
    again = suffix_dedup.Level.load(table, 0)
    every = again.hits(np.ones(len(again.place), bool)).to_pylist()
    assert every == [{"s1": i, "s2": 7, "lo": 0, "hi": 2000 + suffix_dedup.MATCH} for i in range(4)]
    both = suffix_dedup.Level.merge(level, again)
    assert (both.strings[1:] >= both.strings[:-1]).all() and both.hits(np.ones(len(both.place), bool)).num_rows == 4


def test_row_groups_of_large_rows_are_bounded(spark):
    ws = Workspace(spark, "groups")
    large = spark.range(0, 60, 1, 1).select("id", F.expr("cast(concat_ws('', transform(sequence(1, 6000), i -> sha2(concat(id, ':', i), 512))) as binary)").alias("body"))
    ws.stage(large, "large", suffix_dedup.GROUP_BYTES)
    meta = pq.ParquetFile(glob.glob(f"{ws.base.removeprefix('file:')}/large/*.parquet")[0]).metadata
    sizes = [meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)]
    assert len(sizes) > 1 and max(sizes) <= suffix_dedup.GROUP_BYTES + (2 << 20)
    ws.drop("large")
