from pyspark.sql import functions as F

from conftest import SF001
from morphospark.plans import catalog
from morphospark.plans.curate import median_per_organoid


def test_medians_alone_stage_no_cells(spark, monkeypatch):
    """one pass over the objects, with the rows and features of the medians of staged cells."""
    objects = catalog.D.objects
    holed = lambda *a: objects(*a).withColumn(  # noqa: E731  (a null in some object drops the feature everywhere)
        "l_tax", F.when(F.col("ImageNumber") % 50 > 0, F.col("l_tax")))
    for made in (objects, holed):
        monkeypatch.setattr(catalog, "_MEMO", {})
        monkeypatch.setattr(catalog.D, "objects", made)
        alone = catalog.organoids(spark, SF001)
        assert not any(k[2] == "cells" for k in catalog._MEMO)
        want = median_per_organoid(catalog.cells(spark, SF001))
        assert alone.features == want.features and alone.keys == want.keys
        assert ("l_tax" in alone.features) == (made is objects)
        assert alone.select().exceptAll(want.select()).count() == want.select().exceptAll(alone.select()).count() == 0
        assert want.df.count() > 0
