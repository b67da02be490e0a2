"""Session helpers: a tuned local/test session and the checkpoint directory."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(app: str = "morphospark", cpus: int | str | None = None,
              shuffle_partitions: int | None = None,
              driver_memory: str = "8g") -> SparkSession:
    """Local session used by tests and the bench; a cluster passes its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "*")
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else os.cpu_count() or 8)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is
    used as is.  Only a local-mode session with no setting (tests) gets a
    private scratch folder; on a cluster a missing setting is an error, since
    a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS/S3)")
    path = tempfile.mkdtemp(prefix="morphospark-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def workers_find_package(spark: SparkSession) -> None:
    """Put this package on the path of the Python workers.

    Workers of a local session get the folder that holds it, from whatever
    directory the driver was started in; executors elsewhere get a zip of it,
    once a session, through Spark.
    """
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if sc.master.startswith("local"):
        sc.environment["PYTHONPATH"] = root
    elif spark.conf.get("morphospark.shipped", None) != sc.applicationId:
        import shutil

        base = os.path.join(tempfile.mkdtemp(prefix="morphospark-zip-"), "morphospark")
        sc.addPyFile(shutil.make_archive(base, "zip", root, "morphospark"))
        spark.conf.set("morphospark.shipped", sc.applicationId)


def shuffle_partitions(spark: SparkSession) -> int:
    value = spark.conf.get("spark.sql.shuffle.partitions", "200")
    try:
        return max(1, int(value))
    except ValueError:  # "auto" on some platforms
        return max(1, spark.sparkContext.defaultParallelism)


def stage(df, name: str = "stage"):
    """Materialise ``df`` as Parquet in the shared checkpoint folder and read it back.

    One write job (a reliable ``Dataset.checkpoint`` computes its plan twice
    unless persisted, and stores serialized rows); the re-read is a columnar
    scan with pruning and pushdown, and lineage is cut, so losing an executor
    later cannot force recomputation of the upstream plan.
    """
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def concurrently(spark: SparkSession, work, task, parallel: int = 4, name=str) -> list:
    """Results of ``task`` over ``work``, in order; ``parallel`` of them submit jobs at a time.

    Each runs in a thread with its own job group and scheduler pool, both called
    ``name(item)``, so that independent small jobs share the executors instead
    of waiting for one another, and one can be cancelled by itself.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    def one(item):
        label = name(item)
        spark.sparkContext.setJobGroup(label, label, interruptOnCancel=True)
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", label)
        return task(item)

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        return list(pool.map(lambda item: inheritable_thread_target(spark)(one)(item), work))
