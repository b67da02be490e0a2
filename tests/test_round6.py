from morphospark.operators import models


def test_a_fit_has_all_cores_and_few_tasks(spark, monkeypatch):
    """F16: rows in one file, and rows in more pieces than cores."""
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(models, "LEAST_FIT_ROWS", 10)
    for pieces in (1, 40):
        parts = models.dealt(spark.range(0, 1000, 1, pieces)).rdd.glom().map(len).collect()
        assert len(parts) == cores and max(parts) < 2 * 1000 / cores and sum(parts) == 1000
    monkeypatch.setattr(models, "FIT_ROWS", 50)
    assert models.dealt(spark.range(0, 1000, 1, 1)).rdd.getNumPartitions() == 20
