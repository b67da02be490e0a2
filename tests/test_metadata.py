import pytest
from pyspark.sql import functions as F

from morphospark.functions.metadata import add_path_metadata
from morphospark.plans.curate import annotate


def _parse(spark, paths, **kw):
    df = spark.createDataFrame([(p,) for p in paths], "Metadata_FileLocation string")
    return add_path_metadata(df, **kw).collect()


def test_full_path(spark):
    r = _parse(spark, ["/data/190711_plate_ISO49_Dabrafenib_0_041uM/img_Position_3.tif"])[0]
    assert (r.Date, r.Cell, r.Drug, r.Replicate, r["Conc /uM"]) == ("190711", "ISO49", "Dabrafenib", "3", 0.041)


def test_default_replicate_and_number(spark):
    r = _parse(spark, ["/x/190711_a_ISO34_5FU_10uM/z.tif"])[0]
    assert r.Replicate == "1" and r["Conc /uM"] == 10.0 and r.Drug == "5FU"


def test_dash_and_control(spark):
    rows = _parse(spark, ["/x/190711_a_ISO34_Vem_3-330uM/z.tif", "/x/190711_a_ISO34_Vem_0uM/z.tif"])
    assert rows[0]["Conc /uM"] == 3.33 and rows[0].Drug == "Vem"
    assert rows[1].Drug == "Control"


def test_no_match_dropped(spark):
    df = spark.createDataFrame([(1, 1, "nomatch"), (1, 2, "/x/190711_a_ISO49_5FU_1uM/z.tif"),
                                (1, 3, "/x/190711_a_ISO34_5FU_1uM/z.tif")],
                               "ImageNumber long, ObjectNumber long, Metadata_FileLocation string")
    out = annotate(df).collect()
    assert [r.ObjectNumber for r in out] == [2]  # null keys dropped, 5FU+ISO34 excluded


def test_strict_and_quarantine(spark):
    df = spark.createDataFrame([("/x/190711_a_ISO34_Vem_1_2_3uM/z.tif",)], "Metadata_FileLocation string")
    assert add_path_metadata(df, strict=False).first()["Conc /uM"] is None
    with pytest.raises(Exception):
        add_path_metadata(df, strict=True).collect()


def test_rounding_half_even(spark):
    df = spark.createDataFrame([("/x/1_a_ISO34_D_0_0125uM/z.tif",), ("/x/1_a_ISO34_D_0_0135uM/z.tif",)],
                               "Metadata_FileLocation string")
    vals = [r["Conc /uM"] for r in add_path_metadata(df).collect()]
    assert vals == [0.012, 0.014]
