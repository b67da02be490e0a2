import os
import tempfile

from pyspark.sql import functions as F

from morphospark.plans.curate import annotate
from morphospark.sources import driver_tables as D
from morphospark.streaming import curate_stream, running_counts
from morphospark.streaming.curate_stream import read_object_stream

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="ms-stream-src-")
    objs = D.objects(spark, SF)
    objs.repartition(3).write.mode("overwrite").parquet(src)
    stream = read_object_stream(spark, src, objs.schema, max_files_per_trigger=1)
    cur = curate_stream(stream, D.images(spark, SF), drop_list=D.DROP_LIST)
    q1 = cur.writeStream.format("memory").queryName("ms_cur").outputMode("append").start()
    q2 = running_counts(cur).writeStream.format("memory").queryName("ms_counts").outputMode("complete").start()
    q1.processAllAvailable()
    q2.processAllAvailable()
    got = spark.sql("SELECT * FROM ms_cur")
    want = annotate(spark.read.parquet(src), D.images(spark, SF)).drop(*D.DROP_LIST)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want.select(*got.columns)).count() == 0
    counts = {(r.Drug, r.Cell, r["Conc /uM"]): r.Nuclei for r in spark.sql("SELECT * FROM ms_counts").collect()}
    batch = {(r.Drug, r.Cell, r["Conc /uM"]): r["count"]
             for r in want.groupBy("Drug", "Cell", "`Conc /uM`").count().collect()}
    assert counts == batch
    q1.stop()
    q2.stop()


def test_start_curation_available_now(spark):
    from morphospark.streaming.curate_stream import start_curation

    src = tempfile.mkdtemp(prefix="ms-stream-src-")
    sink = tempfile.mkdtemp(prefix="ms-stream-sink-") + "/out"
    objs = D.objects(spark, SF)
    objs.repartition(2).write.mode("overwrite").parquet(src)
    q = start_curation(spark, src, objs.schema, sink, images=D.images(spark, SF),
                       drop_list=D.DROP_LIST, name="ms_job_" + os.path.basename(src).replace("-", "_"))
    q.awaitTermination(300)
    out = spark.read.parquet(sink)
    want = annotate(spark.read.parquet(src), D.images(spark, SF)).drop(*D.DROP_LIST)
    assert out.count() == want.count() > 0
    assert set(out.columns) == set(want.columns)
