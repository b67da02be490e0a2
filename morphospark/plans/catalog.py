"""Registered queries: each callable (spark, sf_dir) -> DataFrame runs a
library operator over the driver tables, and ``ORACLE`` holds the DuckDB
statement computing the same result.  Derived doubles are rounded to 6
places (``stable``) so both engines can be compared value by value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphospark.featureset import FeatureSet, q
from morphospark.plans import oracle_algebra as OA
from morphospark.plans import oracle_sql as O
from morphospark.plans.curate import curate_objects, curate_with_medians, median_per_organoid
from morphospark.plans.dose_response import DISTANCE, distance_table, dose_response
from morphospark.sources import driver_tables as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_MEMO: dict = {}


def stable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column to ``digits`` places for comparison across
    engines, as round(x * 10^d) / 10^d on the double - the arithmetic DuckDB's
    round(x, d) performs - so exact half-way values round alike on both sides."""
    scale = float(10 ** digits)
    return df.select(*[
        (F.round(F.col(q(f.name)).cast("double") * scale, 0) / scale).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(q(f.name))
        for f in df.schema.fields])


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _memo(spark: SparkSession, sf_dir: str, key: str, build):
    k = (spark.sparkContext.applicationId, sf_dir, key)
    if k not in _MEMO:
        _MEMO[k] = build()
    return _MEMO[k]


def cells(spark: SparkSession, sf_dir: str) -> FeatureSet:
    """Curated per-object table of the binding (checkpointed once per session)."""
    def build():
        return curate_objects(D.objects(spark, sf_dir), D.images(spark, sf_dir),
                              drop_list=D.DROP_LIST)
    return _memo(spark, sf_dir, "cells", build)


def organoids(spark: SparkSession, sf_dir: str) -> FeatureSet:
    """Medians of ``cells``; in one pass over the objects, with no table of cells, if that is not there yet."""
    def build():
        if (spark.sparkContext.applicationId, sf_dir, "cells") in _MEMO:
            return median_per_organoid(cells(spark, sf_dir))
        kept, med = curate_with_medians(D.objects(spark, sf_dir), D.images(spark, sf_dir), drop_list=D.DROP_LIST,
                                        image_keys=D.image_keys(spark, sf_dir))
        # a feature with a null in some object is none of the cells', so it has no medians here
        feats = tuple(c for c in med.features if c in kept.features)
        return FeatureSet(med.df.select(*[q(c) for c in med.keys + feats]), med.keys, feats)
    return _memo(spark, sf_dir, "organoids", build)


# --------------------------------------------------------------------------
# E3 flagship: curate -> median per organoid -> norm -> line + EC50
# --------------------------------------------------------------------------
_LINE_COLS = ["n", "m", "c", "R", "stderr", "R2", "EC50 /uM", "CI", "EC50_err"]


@register("dose_response_ec50", O.with_(O.OBJECTS, O.META, O.CELLS, O.ORGANOIDS, O.DIST,
                                        O.line_ctes("dist", "Drug, Cell", '"Conc /uM"',
                                                    '"Euclidean distance"')) + """
SELECT Drug, Cell, n, round(m, 6) AS m, round(c, 6) AS c, round(R, 6) AS R,
       round(stderr, 6) AS stderr, round(R * R, 6) AS R2,
       round(abs((0.5 - c) / nullif(m, 0)), 6) AS "EC50 /uM",
       round(2.58 * stderr, 6) AS CI,
       round(abs((0.5 - c) / nullif(m, 0)) * (2.58 * stderr), 6) AS EC50_err
FROM fit""")
def q_dose_response_ec50(spark, sf_dir):
    out = dose_response(organoids(spark, sf_dir))
    return stable(out.select("Drug", "Cell", *[q(c) for c in _LINE_COLS]))


@register("dose_response_pvalue", O.with_(O.OBJECTS, O.META, O.CELLS, O.ORGANOIDS, O.DIST, O.line_ctes(
    "dist", "Drug, Cell", '"Conc /uM"', '"Euclidean distance"'), OA.t_tail_ctes("fit", "Drug, Cell")) + """
SELECT Drug, Cell, n, round(m, 6) AS m, round(c, 6) AS c, round(R, 6) AS R, round(stderr, 6) AS stderr,
       round(R * R, 6) AS R2, round(abs((0.5 - c) / nullif(m, 0)), 6) AS "EC50 /uM", round(2.58 * stderr, 6) AS CI,
       round(abs((0.5 - c) / nullif(m, 0)) * (2.58 * stderr), 6) AS EC50_err, round(pvalue, 6) AS pvalue
FROM fit LEFT JOIN tails USING (Drug, Cell)""")
def q_dose_response_pvalue(spark, sf_dir):
    out = dose_response(organoids(spark, sf_dir), with_pvalue=True)
    return stable(out.select("Drug", "Cell", *[q(c) for c in _LINE_COLS], "pvalue"))


@register("median_per_organoid", O.with_(O.OBJECTS, O.META, O.CELLS, O.ORGANOIDS) +
          "SELECT " + O.ORG_KEYS_SQL + ", " + ", ".join(f"round({c}, 6) AS {c}" for c in O.FEATURES)
          + " FROM organoids")
def q_median_per_organoid(spark, sf_dir):
    fs = organoids(spark, sf_dir)
    return stable(fs.select())


@register("euclid_distance_table", O.with_(O.OBJECTS, O.META, O.CELLS, O.ORGANOIDS, O.DIST) +
          "SELECT " + O.ORG_KEYS_SQL + ', round("Euclidean distance", 6) AS "Euclidean distance" FROM dist')
def q_euclid_distance_table(spark, sf_dir):
    return stable(distance_table(organoids(spark, sf_dir)))


@register("curate_objects", O.with_(O.OBJECTS, O.META, O.CELLS) +
          "SELECT ImageNumber, ObjectNumber, Date, Drug, Cell, Replicate, \"Conc /uM\", "
          + ", ".join(O.FEATURES) + " FROM cells")
def q_curate_objects(spark, sf_dir):
    return stable(cells(spark, sf_dir).select())


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 from the files in one pass over the objects (fused curation + median)."""
    from morphospark.plans.curate import curate_with_medians

    _cells, medians = curate_with_medians(D.objects(spark, sf_dir), D.images(spark, sf_dir),
                                          drop_list=D.DROP_LIST, image_keys=D.image_keys(spark, sf_dir))
    out = dose_response(medians)
    return stable(out.select("Drug", "Cell", *[q(c) for c in _LINE_COLS]))


# --------------------------------------------------------------------------
# Curation-side aggregates and joins
# --------------------------------------------------------------------------
from morphospark.featureset import ORGANOID_KEYS  # noqa: E402
from morphospark.functions.numeric import l2_norm  # noqa: E402
from morphospark.operators import aggregate as A  # noqa: E402
from morphospark.operators import dose as DS  # noqa: E402
from morphospark.operators import ranking as RK  # noqa: E402
from morphospark.operators import report as RP  # noqa: E402
from morphospark.operators import scale as SC  # noqa: E402
from morphospark.operators.joins import sized_broadcast, suffix_join  # noqa: E402
from morphospark.operators.rows import cross_section  # noqa: E402

_ORG = O.with_(*O.ORG_CHAIN)
_FEATS_SQL = ", ".join(O.FEATURES)


@register("organoid_summary", _ORG + "SELECT Drug, Cell, \"Conc /uM\", count(l_quantity) AS Organoids, "
          + ", ".join(f"count({c}) AS {c}" for c in O.FEATURES[1:])
          + " FROM organoids GROUP BY Drug, Cell, \"Conc /uM\"")
def q_organoid_summary(spark, sf_dir):
    fs = organoids(spark, sf_dir)
    return A.count_non_null(fs.df, ["Drug", "Cell", "Conc /uM"], list(fs.features), first_name="Organoids")


@register("nuclei_summary", O.with_(O.OBJECTS, O.META, O.CELLS)
          + "SELECT Drug, Cell, \"Conc /uM\", count(l_quantity) AS Nuclei, "
          + ", ".join(f"count({c}) AS {c}" for c in O.FEATURES[1:])
          + " FROM cells GROUP BY Drug, Cell, \"Conc /uM\"")
def q_nuclei_summary(spark, sf_dir):
    fs = cells(spark, sf_dir)
    return A.count_non_null(fs.df, ["Drug", "Cell", "Conc /uM"], list(fs.features), first_name="Nuclei")


@register("object_totals", _ORG + "SELECT (SELECT count(l_quantity) FROM cells) AS Nuclei, "
          "(SELECT count(l_quantity) FROM organoids) AS Organoids")
def q_object_totals(spark, sf_dir):
    n = A.object_total(cells(spark, sf_dir).df, "l_quantity", "Nuclei")
    o = A.object_total(organoids(spark, sf_dir).df, "l_quantity", "Organoids")
    return n.unionByName(o, allowMissingColumns=True).agg(
        F.max("Nuclei").alias("Nuclei"), F.max("Organoids").alias("Organoids"))


@register("date_drug_counts", _ORG + "SELECT Date, Drug, Cell, count(*) AS size FROM organoids GROUP BY ALL")
def q_date_drug_counts(spark, sf_dir):
    return A.group_size(organoids(spark, sf_dir).df, ["Date", "Drug", "Cell"])


@register("largest_organoid_per_image", O.with_(O.ORGANOID_PARENTS) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY ImageNumber ORDER BY AreaShape_Area DESC, ObjectNumber) AS rn
      FROM org)
SELECT ImageNumber, ObjectNumber, round(AreaShape_Area, 6) AS AreaShape_Area,
       round(l_extendedprice, 6) AS l_extendedprice, Children_Count FROM r WHERE rn = 1""")
def q_largest_organoid_per_image(spark, sf_dir):
    org = D.organoids(spark, sf_dir)
    return stable(A.row_of_group_max(org, "ImageNumber", "AreaShape_Area", "ObjectNumber"))


@register("objects_join_organoids", O.with_(O.OBJECTS, O.ORGANOID_PARENTS) + """
SELECT o.ImageNumber, o.ObjectNumber, o.Metadata_FileLocation, o.l_linenumber, o.l_partkey,
       o.l_quantity, round(o.l_extendedprice, 6) AS l_extendedprice, o.l_tax, o.p_size,
       o.p_retailprice, round(g.AreaShape_Area, 6) AS AreaShape_Area,
       round(g.l_extendedprice, 6) AS l_extendedprice_Organoid, g.Children_Count
FROM objects o JOIN org g ON o.ObjectNumber = g.ObjectNumber AND o.ImageNumber = g.ImageNumber""")
def q_objects_join_organoids(spark, sf_dir):
    j = suffix_join(D.objects(spark, sf_dir), D.organoids(spark, sf_dir),
                    on=["ObjectNumber", "ImageNumber"], how="inner", suffixes=("", "_Organoid"))
    return stable(j)


@register("parent_child_join", O.with_(O.OBJECTS, O.ORGANOID_PARENTS) + """
SELECT g.ImageNumber, g.ObjectNumber AS ObjectNumber_Organoid, round(g.AreaShape_Area, 6) AS AreaShape_Area,
       round(g.l_extendedprice, 6) AS l_extendedprice_Organoid, g.Children_Count,
       o.ObjectNumber AS ObjectNumber_Nuclei, o.l_linenumber, o.l_partkey, o.l_quantity,
       round(o.l_extendedprice, 6) AS l_extendedprice_Nuclei, o.l_tax, o.p_size, o.p_retailprice
FROM org g JOIN objects o ON g.ObjectNumber = o.l_linenumber AND g.ImageNumber = o.ImageNumber""")
def q_parent_child_join(spark, sf_dir):
    objs = D.objects(spark, sf_dir).drop("Metadata_FileLocation")
    j = suffix_join(D.organoids(spark, sf_dir), objs, on=["ObjectNumber", "ImageNumber"],
                    right_on=["l_linenumber", "ImageNumber"], how="inner",
                    suffixes=("_Organoid", "_Nuclei"), keep_right_keys=True)
    return stable(j)


# --------------------------------------------------------------------------
# Feature ~ dose correlation (E5)
# --------------------------------------------------------------------------
_CORR = """corr AS (
  SELECT Drug, Features,
         covar_pop("Conc /uM", _v) / nullif(stddev_pop("Conc /uM") * stddev_pop(_v), 0) AS Correlation
  FROM """ + O.tall("cells", 'Drug, "Conc /uM"') + """ GROUP BY Drug, Features
)"""
_CELLS = O.with_(O.OBJECTS, O.META, O.CELLS)


def _drug_corr(spark, sf_dir):
    fs = cells(spark, sf_dir)
    return DS.feature_dose_correlation(fs.df, fs.features, by=["Drug"])


@register("feature_dose_correlation", _CELLS + "," + _CORR +
          " SELECT Drug, Features, round(Correlation, 6) AS Correlation FROM corr")
def q_feature_dose_correlation(spark, sf_dir):
    return stable(_drug_corr(spark, sf_dir))


@register("feature_dose_correlation_overall", _CELLS + """,
c AS (SELECT Features, covar_pop("Conc /uM", _v) / nullif(stddev_pop("Conc /uM") * stddev_pop(_v), 0) AS Correlation
      FROM """ + O.tall("cells", '"Conc /uM"') + """ GROUP BY Features)
SELECT Features, round(Correlation, 6) AS Correlation,
       round(CASE WHEN stddev_pop(Correlation) OVER () = 0 THEN 0.0
             ELSE (Correlation - avg(Correlation) OVER ()) / stddev_pop(Correlation) OVER () END, 6)
         AS Correlation_scaled
FROM c""")
def q_feature_dose_correlation_overall(spark, sf_dir):
    fs = cells(spark, sf_dir)
    c = DS.feature_dose_correlation(fs.df, fs.features, by=())
    return stable(DS.standardise_column(c, "Correlation", "Correlation_scaled"))


@register("best_correlator", _CELLS + "," + _CORR + """,
r AS (SELECT *, row_number() OVER (PARTITION BY Drug ORDER BY Correlation DESC, Features DESC) AS rn
      FROM corr WHERE Correlation IS NOT NULL)
SELECT Drug, Features, round(Correlation, 6) AS Correlation FROM r WHERE rn = 1""")
def q_best_correlator(spark, sf_dir):
    return stable(DS.best_per_group(_drug_corr(spark, sf_dir)))


@register("best_correlator_values", O.with_(*O.ORG_CHAIN) + "," + _CORR + """,
r AS (SELECT *, row_number() OVER (PARTITION BY Drug ORDER BY Correlation DESC, Features DESC) AS rn
      FROM corr WHERE Correlation IS NOT NULL),
best AS (SELECT Drug, Features AS Feature FROM r WHERE rn = 1),
t AS """ + O.tall("organoids", O.ORG_KEYS_SQL, name="Feature", value="Magnitude") + """
SELECT t.Date, t.Drug, t.Cell, t.Replicate, t."Conc /uM", t.ImageNumber, t.Feature,
       round(t.Magnitude, 6) AS Magnitude
FROM t JOIN best b ON t.Drug = b.Drug AND t.Feature = b.Feature""")
def q_best_correlator_values(spark, sf_dir):
    best = DS.best_per_group(_drug_corr(spark, sf_dir))
    org = organoids(spark, sf_dir)
    return stable(DS.best_feature_values(org.df, ORGANOID_KEYS, org.features, best))


# --------------------------------------------------------------------------
# Scaling (MM7 at fixed lambda, MM8, MM9, MM20)
# --------------------------------------------------------------------------
FIXED_LAMBDAS = {"l_quantity": 0.0, "l_extendedprice": 0.5, "l_tax": 2.0, "p_size": 1.0,
                 "p_retailprice": -1.0, "o_totalprice": 1.5}


def _std_sql(src="organoids"):
    return ("std AS (SELECT " + O.ORG_KEYS_SQL + ", " + ", ".join(
        f"{O.zscore_sql(c)} AS {c}" for c in O.FEATURES) + f" FROM {src})")


@register("standard_scaled_organoids", _ORG + "," + _std_sql() + " SELECT " + O.ORG_KEYS_SQL + ", "
          + ", ".join(f"round({c}, 6) AS {c}" for c in O.FEATURES) + " FROM std")
def q_standard_scaled_organoids(spark, sf_dir):
    return stable(SC.standard_scale(organoids(spark, sf_dir)).select())


@register("yeo_johnson_fixed", _ORG + "," + _std_sql() + ",\nyj AS (SELECT " + O.ORG_KEYS_SQL + ", "
          + ", ".join(f"{O.yj_sql(c, FIXED_LAMBDAS[c])} AS {c}" for c in O.FEATURES) + " FROM std)\n"
          + "SELECT " + O.ORG_KEYS_SQL + ", " + ", ".join(f"round({O.zscore_sql(c)}, 6) AS {c}" for c in O.FEATURES)
          + " FROM yj")
def q_yeo_johnson_fixed(spark, sf_dir):
    std = SC.standard_scale(organoids(spark, sf_dir))
    return stable(SC.apply_yeo_johnson(std, FIXED_LAMBDAS).select())


@register("yeo_johnson_lambdas", _ORG + ",\nt AS " + O.tall("organoids", "ImageNumber", name="feature") + ",\n"
          + OA.likelihood_peak_ctes("t") + '\nSELECT feature, round(lam, 3) AS "lambda" FROM peak')
def q_yeo_johnson_lambdas(spark, sf_dir):
    """MM7: the fitted exponents; three places, as the likelihood is flat at its peak."""
    fs = organoids(spark, sf_dir)
    lam = SC.fit_yeo_johnson(fs)
    return stable(spark.createDataFrame([(c, lam[c]) for c in fs.features], "feature string, lambda double"), 3)


PROFILE_LAMBDAS = [-4 + 0.5 * k for k in range(21)]


@register("yeo_johnson_profile", _ORG + ",\nt AS " + O.tall("organoids", "ImageNumber", name="feature") + """,
l AS (SELECT CAST(unnest(range(0, 21)) * 0.5 - 4.0 AS DOUBLE) AS lam),
p AS (SELECT feature, lam, CASE WHEN lam = 0 THEN ln(_v + 1) ELSE pow(_v + 1, lam) / lam END AS y,
             ln(_v + 1) AS a FROM t, l)
SELECT feature, lam AS "lambda", round(-0.5 * ln(var_pop(y)) + (lam - 1) * avg(a), 6) AS loglik
FROM p GROUP BY feature, lam""")
def q_yeo_johnson_profile(spark, sf_dir):
    """MM7: the likelihood that the fit maximises, on a grid (all features of the binding are positive)."""
    return stable(SC.yeo_johnson_likelihood(organoids(spark, sf_dir), PROFILE_LAMBDAS))


@register("power_transformed_organoids")
def q_power_transformed_organoids(spark, sf_dir):
    fs, _ = SC.power_transform(organoids(spark, sf_dir))
    return stable(fs.select())


@register("robust_scaled_organoids", _ORG + ",\nqs AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.25) AS {c}_q1, median({c}) AS {c}_med, quantile_cont({c}, 0.75) AS {c}_q3"
    for c in O.FEATURES) + " FROM organoids)\nSELECT " + O.ORG_KEYS_SQL + ", " + ", ".join(
    f"round(CASE WHEN {c}_q3 - {c}_q1 = 0 THEN {c} - {c}_med ELSE ({c} - {c}_med) / ({c}_q3 - {c}_q1) END, 6) AS {c}"
    for c in O.FEATURES) + " FROM organoids, qs")
def q_robust_scaled_organoids(spark, sf_dir):
    return stable(SC.robust_scale(organoids(spark, sf_dir)).select())


@register("normalized_organoids", _ORG + ",\nn AS (SELECT *, sqrt(" + " + ".join(f"{c}*{c}" for c in O.FEATURES)
          + ") AS _norm FROM organoids)\nSELECT " + O.ORG_KEYS_SQL + ", " + ", ".join(
              f"round(CASE WHEN _norm = 0 THEN {c} ELSE {c} / _norm END, 6) AS {c}" for c in O.FEATURES)
          + " FROM n")
def q_normalized_organoids(spark, sf_dir):
    return stable(SC.normalize_rows(organoids(spark, sf_dir)).select())


@register("sigma_clip_report", _ORG + ",\nt AS " + O.tall("organoids", "ImageNumber", name="feature") + """,
z AS (SELECT feature, CASE WHEN stddev_pop(_v) OVER (PARTITION BY feature) = 0 THEN 0.0
        ELSE abs((_v - avg(_v) OVER (PARTITION BY feature)) / stddev_pop(_v) OVER (PARTITION BY feature)) END AS az
      FROM t)
SELECT feature, round(max(az), 6) AS max_abs_z, NOT (max(az) > 3.0) AS kept FROM z GROUP BY feature""")
def q_sigma_clip_report(spark, sf_dir):
    return stable(SC.sigma_clip_report(organoids(spark, sf_dir), 3.0))


# --------------------------------------------------------------------------
# Ordering, splits, balancing, label codes
# --------------------------------------------------------------------------
def _org_hash():
    return RK.hash_order_key(["ImageNumber", "Date", "Drug", "Cell", "Replicate",
                              F.format_string("%.3f", F.col("`Conc /uM`"))], seed=0)


@register("balanced_heads", _ORG + ",\nh AS (SELECT " + O.ORG_KEYS_SQL + ", " + O.ORG_HASH + """ AS _h FROM organoids),
r AS (SELECT *, row_number() OVER (PARTITION BY Drug ORDER BY _h) AS rn, count(*) OVER (PARTITION BY Drug) AS cnt FROM h)
SELECT """ + O.ORG_KEYS_SQL + " FROM r WHERE rn <= (SELECT min(cnt) FROM r)")
def q_balanced_heads(spark, sf_dir):
    df = organoids(spark, sf_dir).df.select(*[q(k) for k in ORGANOID_KEYS]).withColumn("_h", _org_hash())
    return RK.balanced_heads(df, "Drug", ["_h"]).drop("_h")


@register("ordered_split_by_date", _ORG + ",\nh AS (SELECT " + O.ORG_KEYS_SQL + ", " + O.ORG_HASH + """ AS _h
  FROM organoids WHERE Cell = 'ISO49'),
r AS (SELECT *, row_number() OVER (ORDER BY Date, _h) AS rn, count(*) OVER () AS n FROM h)
SELECT Date, Drug, Replicate, "Conc /uM", ImageNumber, rn <= n - ceil(n / 2.0) AS is_train FROM r""")
def q_ordered_split_by_date(spark, sf_dir):
    df = cross_section(organoids(spark, sf_dir).df, "Cell", "ISO49")
    df = df.select("Date", "Drug", "Replicate", "`Conc /uM`", "ImageNumber").withColumn(
        "Cell", F.lit("ISO49")).withColumn("_h", _org_hash())
    return RK.split_flag_ordered(df, ["Date", "_h"]).drop("_h", "Cell")


@register("label_codes", _ORG + """
SELECT Drug, CAST(dense_rank() OVER (ORDER BY Drug) - 1 AS BIGINT) AS label_code
FROM (SELECT DISTINCT Drug FROM organoids)""")
def q_label_codes(spark, sf_dir):
    df = organoids(spark, sf_dir).df.select("Drug").distinct()
    return RK.label_codes(df, "Drug")


@register("importance_cumsum", _CELLS + """,
c AS (SELECT Features AS Feature, abs(covar_pop("Conc /uM", _v) / nullif(stddev_pop("Conc /uM") * stddev_pop(_v), 0)) AS a
      FROM """ + O.tall("cells", '"Conc /uM"') + """ GROUP BY Features),
imp AS (SELECT Feature, a / sum(a) OVER () AS importance FROM c)
SELECT Feature, round(importance, 6) AS importance,
       round(sum(importance) OVER (ORDER BY importance DESC, Feature ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6)
         AS cumulative_importance
FROM imp""")
def q_importance_cumsum(spark, sf_dir):
    fs = cells(spark, sf_dir)
    c = DS.feature_dose_correlation(fs.df, fs.features, by=()).select(
        F.col("Features").alias("Feature"), F.abs("Correlation").alias("a"))
    total = c.agg(F.sum("a")).first()[0]
    imp = c.select("Feature", (F.col("a") / F.lit(total)).alias("importance"))
    return stable(RK.running_total(imp, "importance", "importance", "Feature"))


@register("top_correlations", _CELLS + "," + _CORR + """
SELECT Drug, Features, round(Correlation, 6) AS Correlation FROM corr
WHERE Correlation IS NOT NULL ORDER BY abs(Correlation) DESC, Drug, Features LIMIT 10""")
def q_top_correlations(spark, sf_dir):
    c = _drug_corr(spark, sf_dir).filter(F.col("Correlation").isNotNull())
    return stable(RK.top_k(c, [F.abs("Correlation").desc(), F.col("Drug"), F.col("Features")], 10))


@register("dose_cross_section_with_control", _ORG + """
SELECT """ + O.ORG_KEYS_SQL + ", round(l_quantity, 6) AS l_quantity FROM organoids WHERE \"Conc /uM\" = 0.05 "
          "UNION ALL SELECT " + O.ORG_KEYS_SQL + ", round(l_quantity, 6) AS l_quantity FROM organoids WHERE Drug = 'Control'")
def q_dose_cross_section_with_control(spark, sf_dir):
    df = organoids(spark, sf_dir).df.select(*[q(k) for k in ORGANOID_KEYS], "l_quantity")
    a = cross_section(df, "Conc /uM", 0.05, drop_level=False)
    b = cross_section(df, "Drug", "Control", drop_level=False)
    return stable(a.unionByName(b))


@register("drug_set_minus", _ORG + """
SELECT DISTINCT Drug FROM organoids WHERE Drug NOT IN ('Control', 'Vemurafenib')""")
def q_drug_set_minus(spark, sf_dir):
    from morphospark.operators.reshape import label_set_minus

    return label_set_minus(organoids(spark, sf_dir).df, "Drug", ["Control", "Vemurafenib"])


# --------------------------------------------------------------------------
# Reports over a deterministic classifier
# --------------------------------------------------------------------------
def lang_rule():
    """Keyword rule over the whole text (a deterministic stand-in classifier)."""
    return (F.when(F.instr("text", " the ") > 0, "en").when(F.instr("text", " der ") > 0, "de")
            .when(F.instr("text", " el ") > 0, "es").when(F.instr("text", " le ") > 0, "fr")
            .otherwise("en"))


def predictions(spark, sf_dir):
    d = D.table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", F.col("lang").alias("truth"), lang_rule().alias("pred"))


_PRED = O.with_(O.PREDICTIONS)


@register("confusion_counts", _PRED + """,
cl AS (SELECT truth AS c FROM preds UNION SELECT pred FROM preds),
g AS (SELECT a.c AS truth, b.c AS pred FROM cl a, cl b),
cnt AS (SELECT truth, pred, count(*) AS n FROM preds GROUP BY ALL)
SELECT g.truth, g.pred, coalesce(cnt.n, 0) AS count FROM g LEFT JOIN cnt USING (truth, pred)""")
def q_confusion_counts(spark, sf_dir):
    return RP.confusion_counts(predictions(spark, sf_dir), "truth", "pred")


_REPORT_SQL = _PRED + "," + O.CLASS_COUNTS + """,
rep AS (SELECT label,
   coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0.0) AS precision,
   coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0.0) AS recall, CAST(support AS DOUBLE) AS support
 FROM cls2),
rep2 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS "f1-score" FROM rep)"""


@register("classification_report", _REPORT_SQL + """
SELECT label, Metric, round(Score, 6) AS Score FROM
(UNPIVOT rep2 ON precision, recall, "f1-score", support INTO NAME Metric VALUE Score)""")
def q_classification_report(spark, sf_dir):
    return stable(RP.report_tall(predictions(spark, sf_dir), "truth", "pred"))


@register("roc_auc_hard", _PRED + "," + O.CLASS_COUNTS + """
SELECT label, round(CAST(tp AS DOUBLE) / nullif(support, 0), 6) AS tpr,
       round(CAST(predicted - tp AS DOUBLE) / nullif(n_total - support, 0), 6) AS fpr,
       round((1 + CAST(tp AS DOUBLE) / nullif(support, 0) - CAST(predicted - tp AS DOUBLE) / nullif(n_total - support, 0)) / 2, 6) AS auc
FROM cls2""")
def q_roc_auc_hard(spark, sf_dir):
    return stable(RP.roc_auc_hard(predictions(spark, sf_dir), "truth", "pred"))


@register("balanced_accuracy", _PRED + "," + O.CLASS_COUNTS + """
SELECT round(avg(CAST(tp AS DOUBLE) / support), 6) AS balanced_accuracy FROM cls2 WHERE support > 0""")
def q_balanced_accuracy(spark, sf_dir):
    return stable(RP.balanced_accuracy(predictions(spark, sf_dir), "truth", "pred"))


@register("accuracy", _PRED + """
SELECT round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM preds""")
def q_accuracy(spark, sf_dir):
    return stable(RP.accuracy_table(predictions(spark, sf_dir), "truth", "pred"))


@register("accuracy_per_source", _PRED + """
SELECT source, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM preds GROUP BY source""")
def q_accuracy_per_source(spark, sf_dir):
    return stable(A.group_accuracy(predictions(spark, sf_dir), ["source"], "truth", "pred"))


@register("predicted_fraction", _PRED + """,
w AS (SELECT truth, count(*) FILTER (WHERE pred = 'de') AS de, count(*) FILTER (WHERE pred = 'en') AS en,
             count(*) FILTER (WHERE pred = 'es') AS es, count(*) FILTER (WHERE pred = 'fr') AS fr
      FROM preds GROUP BY truth)
SELECT truth, round(de / nullif(en, 0), 6) AS de, round(en / nullif(en, 0), 6) AS en,
       round(es / nullif(en, 0), 6) AS es, round(fr / nullif(en, 0), 6) AS fr FROM w""")
def q_predicted_fraction(spark, sf_dir):
    return stable(RP.predicted_fraction(predictions(spark, sf_dir), ["truth"], "pred", "en",
                                        classes=["de", "en", "es", "fr"]))


# --------------------------------------------------------------------------
# Feature scores (MM13, MM14) on the per-object table, label = Drug
# --------------------------------------------------------------------------
from morphospark.operators import ensembles as EN  # noqa: E402
from morphospark.operators import models as M  # noqa: E402
from morphospark.operators import outliers as OUT  # noqa: E402
from morphospark.operators import similarity as SIM  # noqa: E402
from morphospark.operators.importance import permutation_importance  # noqa: E402
from morphospark.operators.ransac import ransac_inliers  # noqa: E402

_TALL_DRUG = "t AS " + O.tall("cells", "Drug", name="feature")


@register("anova_f_scores", _CELLS + "," + _TALL_DRUG + """,
g AS (SELECT feature, Drug, count(*) AS n, avg(_v) AS m, var_pop(_v) AS v FROM t GROUP BY ALL),
tot AS (SELECT feature, count(*) AS ntot, avg(_v) AS mu FROM t GROUP BY feature),
s AS (SELECT g.feature, sum(n * (m - mu) * (m - mu)) AS ssb, sum(n * v) AS ssw, count(*) AS k, any_value(ntot) AS ntot
      FROM g JOIN tot USING (feature) GROUP BY g.feature)
SELECT feature, round((ssb / (k - 1)) / nullif(ssw / (ntot - k), 0), 6) AS F FROM s""")
def q_anova_f_scores(spark, sf_dir):
    return stable(M.anova_f(cells(spark, sf_dir), "Drug"))


@register("chi2_scores", _CELLS + "," + _TALL_DRUG + """,
cls AS (SELECT Drug, count(*) / (SELECT count(*) FROM cells) AS p FROM cells GROUP BY Drug),
obs AS (SELECT feature, Drug, sum(_v) AS o FROM t GROUP BY ALL),
tot AS (SELECT feature, sum(_v) AS tt FROM t GROUP BY feature)
SELECT feature, round(sum((o - p * tt) * (o - p * tt) / nullif(p * tt, 0)), 6) AS chi2
FROM obs JOIN tot USING (feature) JOIN cls USING (Drug) GROUP BY feature""")
def q_chi2_scores(spark, sf_dir):
    return stable(M.chi2_scores(cells(spark, sf_dir), "Drug"))


@register("mutual_info_binned", _CELLS + "," + _TALL_DRUG + """,
r AS (SELECT feature, Drug, rank() OVER (PARTITION BY feature ORDER BY _v) AS rn,
             count(*) OVER (PARTITION BY feature) AS n FROM t),
b AS (SELECT feature, Drug, n, floor((rn - 1) * 10 / n) AS bin FROM r),
j AS (SELECT feature, bin, Drug, count(*) AS c, any_value(n) AS n FROM b GROUP BY ALL),
pb AS (SELECT feature, bin, sum(c) AS cb FROM j GROUP BY ALL),
py AS (SELECT feature, Drug, sum(c) AS cy FROM j GROUP BY ALL)
SELECT feature, round(sum((c / n) * ln((c * n) / (cb * cy))), 6) AS mutual_info
FROM j JOIN pb USING (feature, bin) JOIN py USING (feature, Drug) GROUP BY feature""")
def q_mutual_info_binned(spark, sf_dir):
    return stable(M.mutual_information_binned(cells(spark, sf_dir), "Drug", bins=10))


# --------------------------------------------------------------------------
# Outliers, PCA, clustering, classification, similarity (model-based: rows)
# --------------------------------------------------------------------------
# forest settings of the registered model queries (library default depth: 12)
RF_TREES, RF_DEPTH = 100, 8


def scaled_organoids(spark, sf_dir):
    return _memo(spark, sf_dir, "scaled", lambda: SC.standard_scale(organoids(spark, sf_dir)))


@register("isolation_forest_scores")
def q_isolation_forest_scores(spark, sf_dir):
    fs = organoids(spark, sf_dir)
    model = OUT.fit_isolation_forest(fs, n_trees=100, max_samples=256, seed=0)
    return OUT.score_isolation_forest(fs, model).select(*[q(k) for k in ORGANOID_KEYS], "anomaly_score")


@register("isolation_inliers")
def q_isolation_inliers(spark, sf_dir):
    return OUT.isolation_inliers(organoids(spark, sf_dir), seed=0).select()


@register("pca_organoids", _ORG + "," + _std_sql() + ",\n" + OA.component_ctes("std", O.FEATURES, "pc") + "\n"
          + OA.scores_sql("std", O.FEATURES, "pc", O.ORG_KEYS_SQL))
def q_pca_organoids(spark, sf_dir):
    out, _ = M.pca(scaled_organoids(spark, sf_dir), k=2)
    return stable(out.select())


@register("kmeans_on_pcs")
def q_kmeans_on_pcs(spark, sf_dir):
    pcs, _ = M.pca(scaled_organoids(spark, sf_dir), k=2)
    k = pcs.df.select("Drug").distinct().count()
    labelled, _ = M.kmeans_labels(pcs, k=k, seed=0)
    return labelled.select(*[q(c) for c in ORGANOID_KEYS], "PC1", "PC2", "cluster")


def _study(spark, sf_dir):
    """MM5 over all cell lines, doses and drugs, medians in hash order, three folds in each half (run once a session)."""
    from morphospark.plans.classification import classification_study

    return _memo(spark, sf_dir, "study", lambda: classification_study(
        scaled_organoids(spark, sf_dir), None, None, variables=["Conc /uM", "Drug"], seed=0, cv=3,
        population_names=["Median per Organoid unsorted"], num_trees=RF_TREES, max_depth=RF_DEPTH))


@register("classification_study_drug")
def q_classification_study_drug(spark, sf_dir):
    return stable(_study(spark, sf_dir)[0])


@register("classification_study_scores")
def q_classification_study_scores(spark, sf_dir):
    """The score table of the study: hold-out accuracy, and the mean of the folds in either half."""
    return stable(_study(spark, sf_dir)[1])


@register("pairwise_similarity")
def q_pairwise_similarity(spark, sf_dir):
    """MM3 for every cell line."""
    return stable(SIM.similarity_of_lines(scaled_organoids(spark, sf_dir), SIM.pairwise_similarity, SIM.similarity_summary,
                                          label="Drug", seed=0, num_trees=RF_TREES, max_depth=RF_DEPTH))


@register("leave_one_out_similarity")
def q_leave_one_out_similarity(spark, sf_dir):
    """MM2 for every cell line."""
    return stable(SIM.similarity_of_lines(scaled_organoids(spark, sf_dir), SIM.leave_one_out_similarity,
                                          lambda long: SIM.pair_mean(long, exclude_self=False),
                                          label="Drug", seed=0, num_trees=RF_TREES, max_depth=RF_DEPTH))


# --------------------------------------------------------------------------
# Post-model similarity operators on a deterministic score table (SQL)
# --------------------------------------------------------------------------
KEYWORDS = {"de": " der ", "en": " the ", "es": " el ", "fr": " le "}


def keyword_shares(spark, sf_dir) -> DataFrame:
    """(doc_id, Drug=lang, Predicted Drug, Similarity): each language's share
    of all keyword hits in the whole text - a probability-like score table."""
    d = D.table(spark, sf_dir, "documents")
    counts = {k: F.regexp_count("text", F.lit(w)) for k, w in KEYWORDS.items()}
    total = sum(counts.values(), F.lit(0))
    cls = F.explode(F.array(*[F.struct(F.lit(k).alias("p"), c.alias("c")) for k, c in counts.items()]))
    long = d.select("doc_id", F.col("lang").alias("Drug"), total.alias("_t"), cls.alias("_x"))
    return long.select("doc_id", "Drug", F.col("_x.p").alias("Predicted Drug"),
                       F.try_divide(F.col("_x.c").cast("double"), F.nullif(F.col("_t"), F.lit(0)).cast("double"))
                       .alias("Similarity"))


@register("similarity_pairs_min", O.with_(O.SHARES, O.SIM_POST) +
          'SELECT "Predicted Drug", Drug, round(Similarity, 6) AS Similarity FROM mined')
def q_similarity_pairs_min(spark, sf_dir):
    return stable(SIM.similarity_summary(keyword_shares(spark, sf_dir)))


@register("similarity_square_triangle", O.with_(O.SHARES, O.SIM_POST) + """
SELECT Drug, """ + ", ".join(
    f"round(max(CASE WHEN \"Predicted Drug\" = '{k}' AND Drug >= '{k}' THEN Similarity END), 6) AS {k}"
    for k in ["de", "en", "es", "fr"]) + " FROM mined GROUP BY Drug")
def q_similarity_square_triangle(spark, sf_dir):
    pairs = SIM.similarity_summary(keyword_shares(spark, sf_dir))
    return stable(SIM.similarity_square(pairs, triangle=True, labels=sorted(KEYWORDS)))


# --------------------------------------------------------------------------
# Plot-data tables (D1, D3, D4, D5) on events: value by event_type
# --------------------------------------------------------------------------
from morphospark.operators import plotdata as PD  # noqa: E402

BOOT_REPLICATES = 1000


def events_x(spark, sf_dir):
    e = D.table(spark, sf_dir, "events")
    return e.select("event_id", "event_type", "value", F.dayofmonth("ts").cast("double").alias("day"))


_SEED = "('0x' || substr(md5(concat_ws('|', CAST(event_id AS VARCHAR), 'boot0')), 1, 8))::BIGINT"


def _spread_sql(x: str) -> str:
    """The 32-bit finaliser of the bootstrap weights; products need 64 bits and more."""
    for shift, factor in ((16, PD.SPREAD[1]), (13, PD.SPREAD[2])):
        x = f"((xor({x}, {x} >> {shift})::HUGEINT * {factor}) % 4294967296)::BIGINT"
    return f"xor({x}, {x} >> 16)"


@register("bootstrap_mean_ci", O.with_(O.EVENTS_X) + f""",
seeds AS (SELECT event_type, value, {_SEED} AS s FROM events_x WHERE value IS NOT NULL),
reps AS (SELECT event_type, value, _rep, xor(s, ((_rep::HUGEINT * {PD.SPREAD[0]}) % 4294967296)::BIGINT) AS x
         FROM (SELECT *, unnest(range(0, {BOOT_REPLICATES})) AS _rep FROM seeds)),
u AS (SELECT event_type, _rep, value, {_spread_sql("x")} / 4294967296.0 AS u FROM reps),
w AS (SELECT event_type, _rep, value, {O.poisson_weight_sql("u", PD.poisson1_thresholds())} AS _w FROM u),
m AS (SELECT event_type, _rep, sum(_w * value) / nullif(sum(_w), 0) AS _m FROM w GROUP BY ALL),
ci AS (SELECT event_type, quantile_cont(_m, 0.025) AS ci_low, quantile_cont(_m, 0.975) AS ci_high FROM m GROUP BY ALL),
base AS (SELECT event_type, avg(value) AS mean, count(value) AS n FROM events_x GROUP BY ALL)
SELECT base.event_type, round(mean, 6) AS mean, n, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high
FROM base LEFT JOIN ci USING (event_type)""")
def q_bootstrap_mean_ci(spark, sf_dir):
    return stable(PD.bootstrap_mean_ci(events_x(spark, sf_dir), "event_type", "value", ["event_id"],
                                       replicates=BOOT_REPLICATES, seed=0))


@register("kde_violin_grid", O.with_(O.EVENTS_X) + """,
st AS (SELECT event_type, count(value) AS _n, stddev_samp(value) AS _sd, min(value) AS _lo, max(value) AS _hi
       FROM events_x GROUP BY ALL),
st2 AS (SELECT *, _sd * pow(CAST(_n AS DOUBLE), -0.2) AS _h FROM st),
st3 AS (SELECT *, _lo - 2.0 * _h AS _g0, (_hi - _lo + 2 * 2.0 * _h) / 99 AS _step FROM st2 WHERE _h > 0),
g AS (SELECT event_type, unnest(range(0, 100)) AS i FROM st3),
j AS (SELECT e.event_type, g.i, e.value, s._g0, s._step, s._n, s._h FROM events_x e JOIN st3 s USING (event_type)
      JOIN g USING (event_type) WHERE e.value IS NOT NULL)
SELECT event_type, CAST(i AS INTEGER) AS i, round(_g0 + i * _step, 6) AS x,
       round(sum(exp(-((_g0 + i * _step - value) * (_g0 + i * _step - value)) / (2 * _h * _h))) / (any_value(_n) * any_value(_h) * sqrt(2 * pi())), 6) AS density
FROM j GROUP BY event_type, i, _g0, _step""")
def q_kde_violin_grid(spark, sf_dir):
    return stable(PD.kde_grid(events_x(spark, sf_dir), "event_type", "value", points=100))


# The oracle spells out the order statistics and the interpolation
# lo * (1 - d) + hi * d (Spark's percentile arithmetic): DuckDB's built-in
# quantile_cont resolves exact binary midpoints differently by code path.
@register("boxen_letter_values", O.with_(O.EVENTS_X) + """,
n AS (SELECT event_type, count(value) AS n FROM events_x WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i
      FROM events_x WHERE value IS NOT NULL),
k AS (SELECT *, unnest(range(1, 1 + greatest(1, CAST(floor(log2(n)) AS INTEGER) - 3))) AS d FROM n),
ps AS (SELECT event_type, n, unnest([pow(0.5::DOUBLE, d + 1), 1 - pow(0.5::DOUBLE, d + 1)]) AS p FROM k),
pos AS (SELECT event_type, p, n, p * (n - 1) AS h FROM ps),
pos2 AS (SELECT *, floor(h) AS lo_i, ceil(h) AS hi_i, h - floor(h) AS w FROM pos),
qv AS (SELECT pos2.event_type, pos2.p, pos2.n, rl.value * (1 - w) + rh.value * w AS value
       FROM pos2 JOIN r rl ON rl.event_type = pos2.event_type AND rl.i = pos2.lo_i
                 JOIN r rh ON rh.event_type = pos2.event_type AND rh.i = pos2.hi_i)
SELECT event_type, CAST(round(-log2(least(p, 1 - p))) AS INTEGER) - 1 AS depth,
       CASE WHEN p < 0.5 THEN 'lower' ELSE 'upper' END AS side, round(p, 6) AS p, round(value, 6) AS value, n
FROM qv
WHERE CAST(round(-log2(least(p, 1 - p))) AS INTEGER) - 1 <= greatest(1, CAST(floor(log2(n)) AS INTEGER) - 3)""")
def q_boxen_letter_values(spark, sf_dir):
    return stable(PD.letter_values(events_x(spark, sf_dir), "event_type", "value"))


@register("binned_estimates", O.with_(O.EVENTS_X) + """,
c AS (SELECT event_type, unnest(range(0, 9)) AS bin,
             unnest(quantile_cont(day, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS x_bin
      FROM events_x GROUP BY event_type),
d AS (SELECT e.event_id, e.event_type, e.value, c.bin, c.x_bin,
             row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.day - c.x_bin), c.bin) AS rn
      FROM events_x e JOIN c USING (event_type))
SELECT event_type, CAST(bin AS INTEGER) AS bin, round(x_bin, 6) AS x_bin, round(median(value), 6) AS estimate
FROM d WHERE rn = 1 GROUP BY event_type, bin, x_bin""")
def q_binned_estimates(spark, sf_dir):
    return stable(PD.binned_estimates(events_x(spark, sf_dir), "event_type", "day", "value", bins=9))


@register("facet_lines", O.with_(O.EVENTS_X, O.line_ctes("events_x", "event_type", "day", "value")) + """
SELECT event_type, n, round(m, 6) AS m, round(c, 6) AS c, round(R, 6) AS R, round(stderr, 6) AS stderr FROM fit""")
def q_facet_lines(spark, sf_dir):
    return stable(PD.facet_lines(events_x(spark, sf_dir), "event_type", "day", "value"))


# --------------------------------------------------------------------------
# Reference-profile distances/correlations, KS, fingerprints
# --------------------------------------------------------------------------
from morphospark.operators import distance as DIST  # noqa: E402

_CTRL_REF = """ref AS (SELECT Cell, """ + ", ".join(f"median({c}) AS r_{c}" for c in O.FEATURES) + """
  FROM organoids WHERE Drug = 'Control' GROUP BY Cell)"""


@register("distance_to_control_profile", _ORG + "," + _CTRL_REF + """
SELECT """ + ", ".join(f"o.{k}" if k != '"Conc /uM"' else 'o."Conc /uM"' for k in O.ORG_KEYS_SQL.split(", ")) + """,
  round(sqrt(""" + " + ".join(f"(o.{c} - r.r_{c}) * (o.{c} - r.r_{c})" for c in O.FEATURES) + """), 6) AS distance
FROM organoids o JOIN ref r ON o.Cell = r.Cell""")
def q_distance_to_control_profile(spark, sf_dir):
    fs = organoids(spark, sf_dir)
    ref = DIST.reference_profiles(fs, ["Cell"], F.col("Drug") == "Control")
    return stable(DIST.distance_to_reference(fs, ref, ["Cell"]))


@register("dose_line_to_lowest_dose", _ORG + """,
low AS (SELECT Drug, Cell, min("Conc /uM") AS d0 FROM organoids WHERE Drug <> 'Control' GROUP BY ALL),
ref AS (SELECT o.Drug, o.Cell, """ + ", ".join(f"median(o.{c}) AS r_{c}" for c in O.FEATURES) + """
  FROM organoids o JOIN low l ON o.Drug = l.Drug AND o.Cell = l.Cell AND o."Conc /uM" = l.d0 GROUP BY ALL),
dd AS (SELECT o.Drug, o.Cell, o."Conc /uM", o.ImageNumber, sqrt(""" + " + ".join(
    f"(o.{c} - r.r_{c}) * (o.{c} - r.r_{c})" for c in O.FEATURES) + """) AS distance
  FROM organoids o JOIN ref r ON o.Drug = r.Drug AND o.Cell = r.Cell),
per_image AS (SELECT Drug, Cell, "Conc /uM", ImageNumber, avg(distance) AS distance FROM dd GROUP BY ALL),
""" + O.line_ctes("per_image", "Drug, Cell", '"Conc /uM"', "distance") + """
SELECT Drug, Cell, n, round(m, 6) AS m, round(c, 6) AS c, round(R, 6) AS R, round(stderr, 6) AS stderr FROM fit""")
def q_dose_line_to_lowest_dose(spark, sf_dir):
    """A25/A26 re-aimed: distance to the same drug's lowest-dose median
    profile, mean per (drug, cell, dose, image), then the line per drug."""
    fs = organoids(spark, sf_dir)
    treated = fs.df.filter(F.col("Drug") != "Control")
    low = treated.groupBy("Drug", "Cell").agg(F.min("`Conc /uM`").alias("_d0"))
    lowest = treated.join(sized_broadcast(low), ["Drug", "Cell"]).filter(F.col("`Conc /uM`") == F.col("_d0")).drop("_d0")
    ref = DIST.reference_profiles(FeatureSet(lowest, fs.keys, fs.features), ["Drug", "Cell"])
    d = DIST.distance_to_reference(FeatureSet(treated, fs.keys, fs.features), ref, ["Drug", "Cell"])
    per_image = d.groupBy("Drug", "Cell", "`Conc /uM`", "ImageNumber").agg(F.avg("distance").alias("distance"))
    return stable(DS.line_fit(per_image, ["Drug", "Cell"], "Conc /uM", "distance"))


@register("correlation_to_control_profile", _ORG + "," + _CTRL_REF + """,
t AS """ + O.tall("organoids", O.ORG_KEYS_SQL, name="feature") + """,
rt AS (UNPIVOT ref ON """ + ", ".join(f"r_{c} AS '{c}'" for c in O.FEATURES) + """ INTO NAME feature VALUE _r)
SELECT t.Date, t.Drug, t.Cell, t.Replicate, t."Conc /uM", t.ImageNumber,
       round(covar_pop(_v, _r) / nullif(stddev_pop(_v) * stddev_pop(_r), 0), 6) AS correlation
FROM t JOIN rt ON t.Cell = rt.Cell AND t.feature = rt.feature
GROUP BY t.Date, t.Drug, t.Cell, t.Replicate, t."Conc /uM", t.ImageNumber""")
def q_correlation_to_control_profile(spark, sf_dir):
    fs = organoids(spark, sf_dir)
    ref = DIST.reference_profiles(fs, ["Cell"], F.col("Drug") == "Control")
    return stable(DIST.correlation_to_reference(fs, ref, ["Cell"]))


@register("embedding_centroid_distances", """
WITH e AS (SELECT vec_id, CAST(label AS VARCHAR) AS Drug, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
el AS (SELECT vec_id, Drug, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM e),
c AS (SELECT Drug AS centroid_label, i, avg(x) AS cx FROM el GROUP BY ALL)
SELECT el.vec_id, el.Drug, c.centroid_label, round(sqrt(sum((x - cx) * (x - cx))), 6) AS distance
FROM el JOIN c ON el.i = c.i GROUP BY el.vec_id, el.Drug, c.centroid_label""")
def q_embedding_centroid_distances(spark, sf_dir):
    prof = D.embeddings_profiles(spark, sf_dir)
    return stable(DIST.centroid_distances(prof, "vec_id", "Drug", "features"))


@register("ks_control_vs_top_dose", _CELLS + """,
s AS (SELECT *, CASE WHEN Drug = 'Control' THEN 'a' WHEN "Conc /uM" = 0.1 THEN 'b' END AS _s FROM cells),
t AS """ + O.tall("(SELECT * FROM s WHERE _s IS NOT NULL)", "_s", name="feature") + """,
c AS (SELECT feature, _v, _s,
        count(*) FILTER (WHERE _s = 'a') OVER w AS ca, count(*) FILTER (WHERE _s = 'b') OVER w AS cb
      FROM t WINDOW w AS (PARTITION BY feature ORDER BY _v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
n AS (SELECT feature, count(*) FILTER (WHERE _s = 'a') AS n_a, count(*) FILTER (WHERE _s = 'b') AS n_b FROM t GROUP BY feature)
SELECT feature, round(max(abs(ca / n_a - cb / n_b)), 6) AS ks_statistic, any_value(n_a) AS n_a, any_value(n_b) AS n_b
FROM c JOIN n USING (feature) GROUP BY feature""")
def q_ks_control_vs_top_dose(spark, sf_dir):
    fs = cells(spark, sf_dir)
    return stable(DIST.ks_two_sample(fs, F.col("Drug") == "Control", F.col("`Conc /uM`") == 0.1))


@register("fingerprint_medians", _ORG + ",\nfp AS (SELECT Drug, " + ", ".join(f"median({c}) AS {c}" for c in O.FEATURES)
          + " FROM organoids GROUP BY Drug)\nSELECT Drug, feature, round(median, 6) AS median FROM (UNPIVOT fp ON "
          + ", ".join(O.FEATURES) + " INTO NAME feature VALUE median)")
def q_fingerprint_medians(spark, sf_dir):
    tall, _ = DIST.fingerprints(organoids(spark, sf_dir), "Drug")
    return stable(tall)


@register("fingerprint_bounds", _ORG + ",\nt AS " + O.tall("organoids", "Drug", name="feature") + """
SELECT round(avg(_v), 6) AS mean, round(stddev_pop(_v), 6) AS std, round(avg(_v) - 3 * stddev_pop(_v), 6) AS lower,
       round(avg(_v) + 3 * stddev_pop(_v), 6) AS upper FROM t""")
def q_fingerprint_bounds(spark, sf_dir):
    _, bounds = DIST.fingerprints(organoids(spark, sf_dir), "Drug")
    return stable(bounds)


# --------------------------------------------------------------------------
# Extra bench stages (fn(spark, sf_dir, cells, organoids), timed runs)
# --------------------------------------------------------------------------
def _noop(df):
    df.write.format("noop").mode("overwrite").save()


def _bench_isolation(spark, sf_dir, cells_fs, orgs):
    model = OUT.fit_isolation_forest(orgs, n_trees=100, max_samples=256, seed=0)
    _noop(OUT.score_isolation_forest(orgs, model))


def _bench_classification(spark, sf_dir, cells_fs, orgs):
    from morphospark.plans.classification import classify_one, populations

    std = SC.standard_scale(orgs)
    fs, order = populations(std, None, "ISO49")["Median per Organoid unsorted"]
    rep, _ = classify_one(fs, order, "Drug", seed=0, cv=0, num_trees=RF_TREES, max_depth=RF_DEPTH)
    rep.collect()


def _bench_similarity(spark, sf_dir, cells_fs, orgs):
    std = SC.standard_scale(orgs)
    sub = FeatureSet(std.df.filter(F.col("Cell") == "ISO49"), std.keys, std.features)
    SIM.similarity_summary(SIM.pairwise_similarity(sub, "Drug", seed=0, num_trees=RF_TREES,
                                                   max_depth=RF_DEPTH)).collect()


def _bench_ks(spark, sf_dir, cells_fs, orgs):
    DIST.ks_two_sample(cells_fs, F.col("Drug") == "Control", F.col("`Conc /uM`") == 0.1).collect()


def _bench_distance(spark, sf_dir, cells_fs, orgs):
    ref = DIST.reference_profiles(orgs, ["Cell"], F.col("Drug") == "Control")
    _noop(DIST.distance_to_reference(orgs, ref, ["Cell"]))


BENCH_EXTRA = {
    "isolation_forest_fit_score": (_bench_isolation, 3),
    "distance_to_control_profile": (_bench_distance, 3),
    "ks_control_vs_top_dose": (_bench_ks, 3),
    "classification_holdout_drug": (_bench_classification, 1),
    "pairwise_similarity": (_bench_similarity, 1),
}


# --------------------------------------------------------------------------
# Small operators: W4 hash split, P19 mask, P2 column regex, P17/J11
# --------------------------------------------------------------------------
@register("random_split_flags", _ORG + ",\nh AS (SELECT " + O.ORG_KEYS_SQL + ", ('0x' || substr(" + O.ORG_HASH.replace("'0'", "'7'")
          + ", 1, 8))::BIGINT / 4294967296.0 AS u FROM organoids)\nSELECT " + O.ORG_KEYS_SQL + ", u >= 0.25 AS is_train FROM h")
def q_random_split_flags(spark, sf_dir):
    df = organoids(spark, sf_dir).df.select(*[q(k) for k in ORGANOID_KEYS])
    keys = ["ImageNumber", "Date", "Drug", "Cell", "Replicate", F.format_string("%.3f", F.col("`Conc /uM`"))]
    return RK.random_split_flag(df, keys, test_fraction=0.25, seed=7)


@register("mask_outside_sigma", _ORG + ",\nz AS (SELECT " + O.ORG_KEYS_SQL + ", " + ", ".join(
    f"{c}, {O.zscore_sql(c)} AS z_{c}" for c in O.FEATURES) + " FROM organoids)\nSELECT " + O.ORG_KEYS_SQL + ", "
    + ", ".join(f"round(CASE WHEN abs(z_{c}) > 2.0 THEN NULL ELSE {c} END, 6) AS {c}" for c in O.FEATURES) + " FROM z")
def q_mask_outside_sigma(spark, sf_dir):
    """P19 (pandas ``mask``) as used by the sigma clip: values beyond 2 std -> null."""
    fs = organoids(spark, sf_dir)
    return stable(SC.mask_beyond_sigma(fs, 2.0).select())


@register("drop_columns_matching", _ORG + "SELECT " + O.ORG_KEYS_SQL + ", "
          + ", ".join(f"round({c}, 6) AS {c}" for c in O.FEATURES if "price" not in c) + " FROM organoids")
def q_drop_columns_matching(spark, sf_dir):
    from morphospark.operators.columns import filter_columns_regex

    return stable(filter_columns_regex(organoids(spark, sf_dir).select(), r"^((?!price).)*$"))


@register("distance_table_min_count", O.with_(*O.ORG_CHAIN, O.DIST) + """,
keep AS (SELECT Drug, Cell FROM dist GROUP BY Drug, Cell HAVING count("Euclidean distance") > 2000)
SELECT """ + O.ORG_KEYS_SQL + ', round("Euclidean distance", 6) AS "Euclidean distance" FROM dist SEMI JOIN keep USING (Drug, Cell)')
def q_distance_table_min_count(spark, sf_dir):
    return stable(distance_table(organoids(spark, sf_dir), min_group_count=2000))


@register("huber_dose_weights")
def q_huber_dose_weights(spark, sf_dir):
    """MM17: Huber regression of log10 dose on the scaled features (treated rows)."""
    fs = scaled_organoids(spark, sf_dir)
    treated = FeatureSet(fs.df.filter(F.col("`Conc /uM`") > 0), fs.keys, fs.features)
    w = M.huber_weights(treated, F.log10(F.col("`Conc /uM`")))
    return spark.createDataFrame(sorted(w.items()), "feature string, weight double")


_CONTROL_NORM = (",\nctrl AS (SELECT *, sqrt(" + " + ".join(f"{c}*{c}" for c in O.FEATURES)
                 + ") AS _norm FROM std WHERE Drug = 'Control'),\n"
                 "ctrl2 AS (SELECT *, (SELECT median(_norm) FROM ctrl) AS _target FROM ctrl),\n"
                 + OA.solve_ctes("ctrl2", O.FEATURES, "_target"))


@register("control_norm_weights", _ORG + "," + _std_sql() + _CONTROL_NORM
          + "\nSELECT feature, round(weight, 6) AS weight FROM ls")
def q_control_norm_weights(spark, sf_dir):
    """MM19: control rows regressed (no intercept) onto their median norm."""
    fs = scaled_organoids(spark, sf_dir)
    ctrl = fs.df.filter(F.col("Drug") == "Control")
    med = A.group_median(ctrl.withColumn("_all", F.lit(1)).withColumn("_norm", l2_norm(fs.features)),
                         ["_all"], ["_norm"]).first()["_norm"]
    w = M.no_intercept_weights(FeatureSet(ctrl, fs.keys, fs.features), F.lit(med))
    return stable(spark.createDataFrame(sorted(w.items()), "feature string, weight double"))


@register("ransac_inliers")
def q_ransac_inliers(spark, sf_dir):
    """MM18: RANSAC of log10 dose on the scaled features of treated rows."""
    fs = scaled_organoids(spark, sf_dir)
    treated = fs.df.filter(F.col("`Conc /uM`") > 0).withColumn("_logdose", F.log10(F.col("`Conc /uM`")))
    inl, _coef = ransac_inliers(FeatureSet(treated, fs.keys, fs.features), "_logdose",
                                  ["ImageNumber", "Date", "Drug", "Cell", "Replicate", "Conc /uM"], candidates=100, seed=0)
    return inl.select(*[q(k) for k in ORGANOID_KEYS])


# --------------------------------------------------------------------------
# E2 preparation, selection, clustering extras
# --------------------------------------------------------------------------
@register("prepared_profiles")
def q_prepared_profiles(spark, sf_dir):
    """MM6 then MM7 on the organoid medians (the reference's E2 order)."""
    from morphospark.plans.classification import prepare_profiles

    return stable(prepare_profiles(organoids(spark, sf_dir), seed=0).select())


@register("selected_components")
def q_selected_components(spark, sf_dir):
    """MM11: PCA -> forest on Drug -> components with importance >= mean."""
    fs = scaled_organoids(spark, sf_dir)
    sel, imp = M.select_from_model(fs, "Drug", seed=0, with_pca=True, num_trees=RF_TREES, max_depth=RF_DEPTH)
    return stable(imp.withColumn("selected", F.col("Feature").isin(list(sel.features))))


@register("permutation_importance_drug")
def q_permutation_importance_drug(spark, sf_dir):
    """MM25: accuracy drop per permuted feature, forest on Drug (cell line ISO49)."""
    fs = scaled_organoids(spark, sf_dir)
    sub = FeatureSet(fs.df.filter(F.col("Cell") == "ISO49"), fs.keys, fs.features)
    clf = M.Classifier(sub, "Drug", seed=0, num_trees=RF_TREES, max_depth=RF_DEPTH)
    return stable(permutation_importance(clf, sub, "Drug", list(ORGANOID_KEYS), seed=0))


@register("kmeans_grid_labels")
def q_kmeans_grid_labels(spark, sf_dir):
    """MM15: k-means (k = number of drugs) on two PCs, labels on a 500 x 500 grid."""
    pcs, _ = M.pca(scaled_organoids(spark, sf_dir), k=2)
    k = pcs.df.select("Drug").distinct().count()
    _, grid = M.kmeans_labels(pcs, k=k, seed=0, grid=500)
    return grid


@register("cluster_homogeneity")
def q_cluster_homogeneity(spark, sf_dir):
    """Homogeneity of k-means clusters with respect to Drug."""
    pcs, _ = M.pca(scaled_organoids(spark, sf_dir), k=2)
    k = pcs.df.select("Drug").distinct().count()
    labelled, _ = M.kmeans_labels(pcs, k=k, seed=0)
    h = M.cluster_homogeneity(labelled, "Drug", "cluster")
    return labelled.agg(F.count(F.lit(1)).alias("n")).withColumn("homogeneity", F.lit(h))


@register("label_code_correlation", _CELLS + """,
codes AS (SELECT Drug, CAST(dense_rank() OVER (ORDER BY Drug) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT Drug FROM cells)),
t AS """ + O.tall("(SELECT c.*, k.code FROM cells c JOIN codes k USING (Drug))", "code", name="Features") + """
SELECT Features, round(covar_pop(code, _v) / nullif(stddev_pop(code) * stddev_pop(_v), 0), 6) AS Correlation
FROM t GROUP BY Features""")
def q_label_code_correlation(spark, sf_dir):
    fs = cells(spark, sf_dir)
    coded = RK.label_codes(fs.df, "Drug", out="code").withColumn("code", F.col("code").cast("double"))
    return stable(DS.label_code_correlation(coded, fs.features, "code"))


@register("max_correlation_over_doses", _ORG + "," + _CTRL_REF + """,
prof AS (SELECT Drug, Cell, "Conc /uM", """ + ", ".join(f"median({c}) AS {c}" for c in O.FEATURES) + """
  FROM organoids GROUP BY Drug, Cell, "Conc /uM"),
t AS """ + O.tall("prof", 'Drug, Cell, "Conc /uM"', name="feature") + """,
rt AS (UNPIVOT ref ON """ + ", ".join(f"r_{c} AS '{c}'" for c in O.FEATURES) + """ INTO NAME feature VALUE _r),
r AS (SELECT t.Drug, t.Cell, t."Conc /uM", covar_pop(_v, _r) / nullif(stddev_pop(_v) * stddev_pop(_r), 0) AS r
      FROM t JOIN rt ON t.Cell = rt.Cell AND t.feature = rt.feature GROUP BY t.Drug, t.Cell, t."Conc /uM")
SELECT Drug, Cell, round(max(r), 6) AS max_correlation FROM r GROUP BY Drug, Cell""")
def q_max_correlation_over_doses(spark, sf_dir):
    fs = organoids(spark, sf_dir)
    ref = DIST.reference_profiles(fs, ["Cell"], F.col("Drug") == "Control")
    return stable(DIST.max_correlation_over_doses(fs, ref, ["Cell"]))


# --------------------------------------------------------------------------
# Tree ensembles and votes (MM24), codes in order of appearance (W5), elimination with folds (MM14)
# --------------------------------------------------------------------------
_VOTE_KEYS = ["ImageNumber", "Date", "Drug", "Cell", "Replicate", "Conc /uM"]


@register("tree_ensembles_holdout")
def q_tree_ensembles_holdout(spark, sf_dir):
    """MM24: extra trees, bagged trees and their soft vote on every cell line, scored on the hold-out half."""
    fs = scaled_organoids(spark, sf_dir)
    out = []
    for cell in sorted(r[0] for r in fs.df.select("Cell").distinct().collect()):
        flagged = RK.split_flag_ordered(fs.df.filter(F.col("Cell") == cell).withColumn("_h", _org_hash()), ["_h"])
        train = FeatureSet(flagged.filter("is_train"), fs.keys, fs.features)
        test = FeatureSet(flagged.filter(~F.col("is_train")), fs.keys, fs.features)
        extra = EN.extra_trees(train, "Drug", _VOTE_KEYS, trees=RF_TREES, max_depth=RF_DEPTH)
        bags = EN.bagged_trees(train, "Drug", _VOTE_KEYS, trees=25, max_depth=RF_DEPTH)
        tables = {"extra trees": extra.predict_proba_long(test, _VOTE_KEYS),
                  "bagged trees": bags.predict_proba_long(test, _VOTE_KEYS)}
        tables["soft vote"] = EN.soft_vote(list(tables.values()), _VOTE_KEYS)
        for name, table in tables.items():
            hit = (F.col("predicted") == F.col("Drug")).cast("double")
            out.append(EN.most_probable(table, _VOTE_KEYS).agg(F.count(F.lit(1)).alias("n_test"), F.avg(hit).alias("accuracy"))
                       .withColumns({"Cell": F.lit(cell), "estimator": F.lit(name)}))
    from morphospark.operators.reshape import union_all

    return stable(union_all(*out))


@register("soft_vote_languages", O.with_(O.SHARES) + """,
a AS (SELECT doc_id, "Predicted Drug" AS class, coalesce(Similarity, 0) AS p FROM sim),
b AS (SELECT doc_id, lang AS class, 1.0 AS p FROM documents),
u AS (SELECT doc_id, class, 2.0 * p AS p FROM a UNION ALL SELECT doc_id, class, p FROM b),
v AS (SELECT doc_id, class, sum(p) / 3.0 AS p FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, class) AS rn FROM v)
SELECT doc_id, class AS predicted, round(p, 6) AS probability FROM r WHERE rn = 1""")
def q_soft_vote_languages(spark, sf_dir):
    """MM24 voting on two probability tables: keyword shares (weight 2) and the given language (weight 1)."""
    shares = keyword_shares(spark, sf_dir).select("doc_id", F.col("`Predicted Drug`").alias("class"),
                                                  F.coalesce("Similarity", F.lit(0.0)).alias("probability"))
    given = D.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("class"), F.lit(1.0).alias("probability"))
    return stable(EN.most_probable(EN.soft_vote([shares, given], ["doc_id"], [2.0, 1.0]), ["doc_id"]))


@register("date_codes_by_appearance", _ORG + """,
f AS (SELECT Date, min(ImageNumber) AS first FROM organoids GROUP BY Date),
c AS (SELECT Date, row_number() OVER (ORDER BY first, Date) - 1 AS code FROM f)
SELECT ImageNumber, o.Date, o.Drug, o.Cell, o.Replicate, o."Conc /uM", CAST(code AS BIGINT) AS label_code
FROM organoids o JOIN c ON o.Date = c.Date""")
def q_date_codes_by_appearance(spark, sf_dir):
    """W5 (pd.factorize): a code for each date in the order in which the images first show it."""
    df = organoids(spark, sf_dir).df.select(*[q(k) for k in ORGANOID_KEYS])
    return RK.label_codes(df, "Date", order=["ImageNumber", "Date"])


@register("elimination_curve")
def q_elimination_curve(spark, sf_dir):
    """MM14: recursive elimination on every cell line's rows together, three folds, accuracy by number of features."""
    fs = scaled_organoids(spark, sf_dir)
    ordered = fs.with_df(fs.df.withColumn("_h", _org_hash()))
    _, curve = M.elimination_curve(ordered, "Drug", ["_h"], folds=3, seed=0, num_trees=20, max_depth=RF_DEPTH)
    return stable(curve)


# --------------------------------------------------------------------------
# E3 whole: isolation, power transform, feature source, median, norm, line, EC50
# --------------------------------------------------------------------------
_YJ_CELLS = ("yjc AS (SELECT " + O.ORG_KEYS_SQL + ", " + ", ".join(
    f"{O.yj_sql(c, FIXED_LAMBDAS[c])} AS {c}" for c in O.FEATURES) + " FROM cells),\nzc AS (SELECT " + O.ORG_KEYS_SQL + ", "
    + ", ".join(f"{O.zscore_sql(c)} AS {c}" for c in O.FEATURES) + " FROM yjc),\nzo AS (SELECT " + O.ORG_KEYS_SQL + ", "
    + ", ".join(f"median({c}) AS {c}" for c in O.FEATURES) + " FROM zc GROUP BY ALL),\nzd AS (SELECT " + O.ORG_KEYS_SQL
    + ", sqrt(" + " + ".join(f"{c}*{c}" for c in O.FEATURES) + ') AS "Euclidean distance" FROM zo)')


@register("dose_response_scaled", _CELLS + "," + _YJ_CELLS + ",\n" + O.line_ctes("zd", "Drug, Cell", '"Conc /uM"', '"Euclidean distance"') + """
SELECT Drug, Cell, n, round(m, 6) AS m, round(c, 6) AS c, round(R, 6) AS R, round(stderr, 6) AS stderr,
       round(abs((0.5 - c) / nullif(m, 0)), 6) AS "EC50 /uM", 'scaled' AS Source
FROM fit""")
def q_dose_response_scaled(spark, sf_dir):
    """E3 on objects scaled at fixed exponents (every step but the model fits)."""
    from morphospark.plans.dose_response import prepared_dose_response

    out = prepared_dose_response(cells(spark, sf_dir), "scaled", isolate=False, lambdas=FIXED_LAMBDAS)
    return stable(out.select("Drug", "Cell", "n", "m", "c", "R", "stderr", "`EC50 /uM`", "Source"))


@register("dose_response_prepared")
def q_dose_response_prepared(spark, sf_dir):
    """E3 as the reference runs it, for each feature source: inlying objects, fitted power transform, p-values."""
    from morphospark.operators.reshape import union_all
    from morphospark.plans.dose_response import profiles, scaled_objects

    scaled = scaled_objects(cells(spark, sf_dir), seed=0)
    out = []
    for source in ("scaled", "weighted", "selected"):
        name, medians = profiles(scaled, source, seed=0, num_trees=RF_TREES, max_depth=RF_DEPTH)
        out.append(dose_response(medians, with_pvalue=True).withColumn("Source", F.lit(name)))
    return stable(union_all(*out).select("Source", "Drug", "Cell", *[q(c) for c in _LINE_COLS], "pvalue"))


from morphospark.plans import catalog_more  # noqa: E402,F401  (registers its queries here)
