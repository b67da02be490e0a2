import json
import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphospark.featureset import FeatureSet
from morphospark.functions.stats import t_two_sided_p
from morphospark.operators import dose as DS
from morphospark.operators import report as RP
from morphospark.operators.joins import suffix_join
from morphospark.operators.plotdata import bootstrap_mean_ci, kde_grid, poisson1_thresholds
from morphospark.operators.similarity import similarity_summary
from morphospark.sources.droplist import load_drop_list
from morphospark.sources.readers import read_csv
from morphospark.sources.schema_check import schema_conformance


def test_left_join_keeps_unmatched_objects(spark):
    objs = spark.createDataFrame([(1, 1, 2.0), (9, 1, 3.0)], "ImageNumber long, ObjectNumber long, x double")
    imgs = spark.createDataFrame([(1, 5.0), (2, 6.0)], "ImageNumber long, x double")
    out = {r.ImageNumber: r.x_Image for r in suffix_join(objs, imgs, "ImageNumber", "left", ("", "_Image")).collect()}
    assert out == {1: 5.0, 9: None}


def test_report_zero_division(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "a"), ("c", "a")], "truth string, pred string")
    rep = {r.label: r for r in RP.per_class_report(df, "truth", "pred").collect()}
    assert rep["b"].precision == 0.0 and rep["b"]["f1-score"] == 0.0
    assert rep["a"].precision == 0.5 and rep["a"].recall == 1.0
    assert RP.balanced_accuracy(df, "truth", "pred").first()[0] == pytest.approx(1 / 3)
    cc = RP.confusion_counts(df, "truth", "pred")
    assert cc.count() == 9 and cc.filter("count = 0").count() == 6


def test_pair_min_symmetric(spark):
    long = spark.createDataFrame([("A", "B", 0.2), ("B", "A", 0.3), ("A", "A", 0.9)],
                                 "Drug string, `Predicted Drug` string, Similarity double")
    out = {(r.Drug, r["Predicted Drug"]): r.Similarity for r in similarity_summary(long).collect()}
    assert out == {("A", "B"): 0.2, ("B", "A"): 0.2}


def test_line_fit_edge_cases(spark):
    rows = [("ctrl", 0.0, 1.0), ("ctrl", 0.0, 2.0), ("two", 1.0, 1.0), ("two", 2.0, 3.0),
            ("flat", 1.0, 5.0), ("flat", 2.0, 5.0), ("flat", 3.0, 5.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    out = {r.g: r for r in DS.add_ec50(DS.line_fit(df, ["g"], "x", "y", with_pvalue=True)).collect()}
    assert out["ctrl"].m is None and out["ctrl"].R is None and out["ctrl"]["EC50 /uM"] is None
    assert out["two"].R == 1.0 and out["two"].stderr == 0.0 and out["two"].pvalue == 0.0
    assert out["flat"].R == 0.0 and out["flat"].m == 0.0 and out["flat"].pvalue == pytest.approx(1.0)


def test_pvalue_closed_forms():
    # df = 1: p = 1 - 2/pi * atan(|t|); df = 2: p = 1 - |t| / sqrt(2 + t^2)
    for r, n in [(0.3, 3), (0.9, 3), (-0.5, 4), (0.1, 4)]:
        df = n - 2
        t = r * math.sqrt(df / ((1 - r) * (1 + r)))
        want = 1 - 2 / math.pi * math.atan(abs(t)) if df == 1 else 1 - abs(t) / math.sqrt(2 + t * t)
        assert t_two_sided_p(r, n) == pytest.approx(want, abs=1e-12)
    # 5 % critical value of t with 10 degrees of freedom is 2.228
    t = 2.228138851986
    r = t / math.sqrt(10 + t * t)
    assert t_two_sided_p(r, 12) == pytest.approx(0.05, abs=1e-9)


def test_csv_reader_and_lists(spark):
    d = tempfile.mkdtemp(prefix="ms-csv-")
    with open(os.path.join(d, "objs.csv"), "w") as fh:
        fh.write("ImageNumber,ObjectNumber,Metadata_FileLocation,AreaShape_Area,Bad\n")
        fh.write("1,1,/x/1_a_ISO34_D_1uM/z.tif,2.5,NaN\n1,2,/x/1_a_ISO34_D_1uM/z.tif,NA,3\n")
    df = read_csv(spark, os.path.join(d, "objs.csv"))
    rows = df.orderBy("ObjectNumber").collect()
    assert rows[0].Bad is None and rows[1].AreaShape_Area is None and rows[1].Bad == 3.0
    assert dict(df.dtypes)["ImageNumber"] == "bigint"
    with open(os.path.join(d, "drop.json"), "w") as fh:
        json.dump(["Bad", "Bad", "Missing"], fh)
    assert load_drop_list(os.path.join(d, "drop.json")) == ["Bad", "Missing"]
    sc = {(r.column, r.status) for r in schema_conformance(spark, df, ["ImageNumber", "Other_x"]).collect()}
    assert ("Other_x", "missing") in sc and ("Bad", "extra") in sc


def test_bootstrap_and_kde(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "g", float(v)) for i, v in enumerate(rng.normal(10, 2, 400))]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    b = bootstrap_mean_ci(df, "g", "v", ["id"], replicates=300).first()
    assert b.ci_low < b.mean < b.ci_high and (b.ci_high - b.ci_low) < 1.0
    assert poisson1_thresholds()[0] == pytest.approx(math.exp(-1))
    k = kde_grid(df, "g", "v", points=200).toPandas().sort_values("x")
    area = np.trapezoid(k["density"], k["x"])
    assert area == pytest.approx(1.0, abs=0.02)
