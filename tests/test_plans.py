"""Plan-shape regressions for the scale properties, and E2/E3 plans."""

import numpy as np
from pyspark.sql import functions as F

from morphospark.featureset import ORGANOID_KEYS, FeatureSet
from morphospark.operators import models as M
from morphospark.operators.aggregate import _median_builtin
from morphospark.plans.classification import prepare_profiles
from morphospark.plans.curate import annotate
from morphospark.sources import driver_tables as D

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_path_regex_evaluated_once(spark):
    objs = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr(
        "l_orderkey AS ImageNumber", "l_linenumber AS ObjectNumber",
        "concat('/d/950102_p_ISO34_5FU_0_04uM/i', l_partkey, '.tif') AS Metadata_FileLocation")
    plan = _plan(annotate(objs))
    assert plan.count("regexp_replace(") == 1 and "regexp_extract(" not in plan


def test_median_reuses_image_partitioning(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ann = annotate(D.objects(spark, SF, threshold=10**9), D.images(spark, SF))
        med = _median_builtin(ann, ORGANOID_KEYS, ["l_quantity"])
        plan = _plan(med)
        # big side: by l_partkey (part join) and l_orderkey (ranking); nothing before the aggregate
        assert plan.count("Exchange hashpartitioning(l_orderkey") == 1
        assert "Exchange hashpartitioning(Date" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_prepare_profiles_and_selection(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "A" if i % 2 else "B", float(rng.normal(3 if i % 2 else -3, 1)), float(rng.lognormal()),
             float(rng.normal())) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, y string, a double, b double, c double")
    fs = FeatureSet(df, ("id", "y"), ("a", "b", "c"))
    prep = prepare_profiles(fs, seed=1).df.toPandas()
    assert 0 < len(prep) <= 600 and abs(prep["b"].mean()) < 1e-9
    sel, imp = M.select_from_model(fs, "y", with_pca=False, num_trees=20, max_depth=4)
    assert "a" in sel.features
    clf = M.Classifier(fs, "y", num_trees=20, max_depth=4)
    pi = {r.feature: r.importance for r in M.permutation_importance(clf, fs, "y", ["id"]).collect()}
    assert pi["a"] > 0.2 and abs(pi["c"]) < 0.1


def test_rfe_and_pca_variants(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "Control" if i % 3 == 0 else "D", 0.05 if i % 3 else 0.0, float(rng.normal(2 if i % 3 else -2, 1)),
             float(rng.normal()), float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, Drug string, `Conc /uM` double, a double, b double, c double")
    fs = FeatureSet(df, ("id", "Drug", "Conc /uM"), ("a", "b", "c"))
    kept, ranking = M.recursive_feature_elimination(fs, "Drug", keep=1, num_trees=20, max_depth=4)
    assert kept == ["a"] and ranking.count() == 3
    from morphospark.plans.classification import pca_variants

    out = pca_variants(None, fs, dose=0.05)
    counts = {r.variant: r["count"] for r in out.groupBy("variant").count().collect()}
    assert counts == {"per_organoid": 300, "per_organoid_0.05uM": 200, "per_organoid_0.05uM_control": 300}


def test_job_on_csv_exports(spark):
    import json
    import os
    import tempfile

    from morphospark.plans import catalog as C
    from morphospark.plans.jobs import run

    d = tempfile.mkdtemp(prefix="ms-job-")
    D.objects(spark, SF).coalesce(1).write.option("header", True).csv(f"{d}/objects")
    D.images(spark, SF).drop("o_orderstatus", "o_orderpriority", "o_orderdate").coalesce(1) \
        .write.option("header", True).csv(f"{d}/images")
    with open(f"{d}/drop.json", "w") as fh:
        json.dump(list(D.DROP_LIST) + list(D.DROP_LIST), fh)
    info = run(spark, f"{d}/objects", f"{d}/images", f"{d}/drop.json", f"{d}/out", with_pvalue=False)
    assert info["features"] == ["l_quantity", "l_extendedprice", "l_tax", "p_size", "p_retailprice", "o_totalprice"]
    got = {(r.Drug, r.Cell): r.n for r in spark.read.parquet(f"{d}/out/ec50").collect()}
    want = {(r.Drug, r.Cell): r.n for r in C.flagship(spark, SF).collect()}
    assert got == want
    assert os.path.isdir(f"{d}/out/euclid")
