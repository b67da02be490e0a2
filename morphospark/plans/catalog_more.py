"""Further registered queries: incomplete tables, CSV round trips, lookups by key,
label-sized reshapes, folds, selections and component variants."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from morphospark.featureset import ORGANOID_KEYS, FeatureSet, q
from morphospark.functions.numeric import binarize, log10_dose
from morphospark.operators import aggregate as A
from morphospark.operators import columns as CO
from morphospark.operators import distance as DIST
from morphospark.operators import joins as J
from morphospark.operators import models as M
from morphospark.operators import ranking as RK
from morphospark.operators import reshape as RS
from morphospark.operators import rows as R
from morphospark.operators import scale as SC
from morphospark.plans import catalog as C
from morphospark.plans import oracle_algebra as OA
from morphospark.plans import oracle_sql as O
from morphospark.plans.catalog import register, stable
from morphospark.plans.curate import curate_objects, median_per_organoid
from morphospark.session import concurrently, ensure_checkpoint_dir, stage
from morphospark.sources import driver_tables as D
from morphospark.sources.readers import read_csv
from morphospark.sources.writers import write_table, write_without_null_columns

_ORG = O.with_(*O.ORG_CHAIN)
_KEYS = O.ORG_KEYS_SQL
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in O.FEATURES)


# --------------------------------------------------------------------------
# Incomplete tables: P5, P11, R1, medians of features with gaps
# --------------------------------------------------------------------------
def _lacking_features(spark, sf_dir):
    """Objects without a tax in one row of seven, but for the first object of an image."""
    gap = (F.col("ObjectNumber") > 1) & (F.col("l_partkey") % 7 == 0)
    return D.objects(spark, sf_dir).withColumn("l_tax", F.when(~gap, F.col("l_tax")))


def _lacking_paths(spark, sf_dir):
    """Objects that also lack the file path in one image of 89."""
    return _lacking_features(spark, sf_dir).withColumn(
        "Metadata_FileLocation", F.when(F.col("ImageNumber") % 89 != 0, F.col("Metadata_FileLocation")))


_GAPS = O.with_(O.OBJECTS.replace("objects AS (", "whole AS (", 1), """objects AS (
  SELECT * REPLACE (CASE WHEN ObjectNumber > 1 AND l_partkey % 7 = 0 THEN NULL ELSE l_tax END AS l_tax) FROM whole
)""", O.META, O.CELLS)


@register("curate_incomplete_objects", _GAPS + """
SELECT ImageNumber, ObjectNumber, Date, Drug, Cell, Replicate, "Conc /uM", """
          + ", ".join(c for c in O.FEATURES if c != "l_tax") + " FROM cells WHERE ImageNumber % 89 <> 0")
def q_curate_incomplete_objects(spark, sf_dir):
    """E1 where a feature and some paths are missing: the feature goes (P5), and so do the rows without keys."""
    return stable(curate_objects(_lacking_paths(spark, sf_dir), D.images(spark, sf_dir), drop_list=D.DROP_LIST).select())


@register("median_incomplete_objects", _GAPS + ",\n" + O.ORGANOIDS + f"\nSELECT {_KEYS}, {_ROUNDED} FROM organoids")
def q_median_incomplete_objects(spark, sf_dir):
    """A2 over features with gaps: the median of the values there are; the feature stays, as every group has one."""
    fs = curate_objects(_lacking_features(spark, sf_dir), D.images(spark, sf_dir), drop_list=D.DROP_LIST, drop_nulls=False)
    return stable(median_per_organoid(fs).select())


# --------------------------------------------------------------------------
# CSV exports: S1, S3, S8
# --------------------------------------------------------------------------
def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"


@register("csv_two_headers", """
SELECT o_orderkey AS ImageNumber, o_orderstatus, round(CAST(o_totalprice AS DOUBLE), 6) AS o_totalprice,
       CASE WHEN o_orderstatus <> 'F' THEN CAST(o_custkey AS DOUBLE) END AS o_custkey FROM orders""")
def q_csv_two_headers(spark, sf_dir):
    """S1 on exports of two layouts (another column order, a column more), written as CSV and united by name."""
    orders = D.images(spark, sf_dir)
    path = _folder(spark, "csv")
    write_table(orders.filter("o_orderstatus = 'F'").select("o_totalprice", "ImageNumber", "o_orderstatus"), path, "csv")
    write_table(orders.filter("o_orderstatus <> 'F'").select("o_orderstatus", "ImageNumber", "o_custkey", "o_totalprice"),
                path, "csv", mode="append")
    return stable(read_csv(spark, path, unite_headers=True).select(
        "ImageNumber", "o_orderstatus", "o_totalprice", "o_custkey"))


@register("csv_without_null_columns", _GAPS + """
SELECT ImageNumber, ObjectNumber, Date, Drug, Cell, Replicate, "Conc /uM", """
          + ", ".join(f"round({c}, 6) AS {c}" for c in O.FEATURES if c != "l_tax") + " FROM cells")
def q_csv_without_null_columns(spark, sf_dir):
    """S3: the object table without its incomplete columns, written as CSV and read again."""
    fs = curate_objects(_lacking_features(spark, sf_dir), D.images(spark, sf_dir), drop_list=D.DROP_LIST, drop_nulls=False)
    path = _folder(spark, "csv")
    write_without_null_columns(fs.select(), path, "csv")
    return stable(read_csv(spark, path, string_columns=("Date", "Drug", "Cell", "Replicate")))


# --------------------------------------------------------------------------
# Lookups and row filters: J6, J12, P2b, P14, P16, P20, F8, F12
# --------------------------------------------------------------------------
_TOP_KEYS = """,
r AS (SELECT ImageNumber, ObjectNumber, row_number() OVER (PARTITION BY ImageNumber ORDER BY AreaShape_Area DESC,
        ObjectNumber) AS rn FROM org)"""


def _largest(spark, sf_dir):
    return A.row_of_group_max(D.organoids(spark, sf_dir), "ImageNumber", "AreaShape_Area", "ObjectNumber")


@register("nuclei_of_largest_organoid", O.with_(O.OBJECTS, O.ORGANOID_PARENTS) + _TOP_KEYS + """
SELECT o.ImageNumber, o.ObjectNumber, o.l_linenumber, o.l_quantity, round(o.l_extendedprice, 6) AS l_extendedprice
FROM objects o SEMI JOIN (SELECT * FROM r WHERE rn = 1) k
  ON o.ImageNumber = k.ImageNumber AND o.l_linenumber = k.ObjectNumber""")
def q_nuclei_of_largest_organoid(spark, sf_dir):
    """Objects looked up by computed keys, those of the largest parent of their image."""
    keys = _largest(spark, sf_dir).select("ImageNumber", F.col("ObjectNumber").cast("int").alias("l_linenumber"))
    objects = D.objects(spark, sf_dir).select("ImageNumber", "ObjectNumber", "l_linenumber", "l_quantity", "l_extendedprice")
    return stable(J.semi_join(objects, keys, ["ImageNumber", "l_linenumber"]).select(objects.columns))


@register("dates_without_control", _ORG + f"""
SELECT {_KEYS} FROM organoids WHERE Date NOT IN (SELECT Date FROM organoids WHERE Drug = 'Control')""")
def q_dates_without_control(spark, sf_dir):
    """Rows left when those of other keys are held out, by an anti-join."""
    keys = CO.key_table(C.organoids(spark, sf_dir).df, ORGANOID_KEYS)
    return J.semi_join(keys, R.where_expr(keys, "Drug = 'Control'"), "Date", anti=True).select(keys.columns)


@register("two_dose_rows", _ORG + f"""
SELECT {_KEYS}, round(l_quantity, 6) AS l_quantity FROM organoids
WHERE "Conc /uM" IN (0.0, 0.04) AND Drug NOT IN ('5FU')""")
def q_two_dose_rows(spark, sf_dir):
    """Two doses, all drugs but one."""
    df = C.organoids(spark, sf_dir).df.select(*[q(k) for k in ORGANOID_KEYS], "l_quantity")
    return stable(R.isin(R.isin(df, "Conc /uM", [0.0, 0.04]), "Drug", ["5FU"], negate=True))


@register("log_dose_rows", _ORG + f"""
SELECT {_KEYS}, round(log10("Conc /uM"), 6) AS log_dose FROM organoids WHERE "Conc /uM" > 0""")
def q_log_dose_rows(spark, sf_dir):
    """F8 and P20: the logarithm of the dose; rows without one are dropped."""
    keys = CO.key_table(C.organoids(spark, sf_dir).df, ORGANOID_KEYS)
    return stable(R.drop_null_rows(CO.add_columns(keys, {"log_dose": log10_dose("Conc /uM")}), ["log_dose"]))


_FLAGS = ("5FU", "Control", "Dabrafenib", "Vemurafenib")


@register("drug_flags", _ORG + f"SELECT {_KEYS}, " + ", ".join(
    f"CAST(Drug = '{d}' AS INT) AS \"is_{d}\"" for d in _FLAGS) + " FROM organoids")
def q_drug_flags(spark, sf_dir):
    """one 0/1 column for each drug."""
    keys = CO.key_table(C.organoids(spark, sf_dir).df, ORGANOID_KEYS)
    return CO.add_columns(keys, binarize("Drug", _FLAGS))


@register("nuclei_columns", O.with_(O.OBJECTS, O.ORGANOID_PARENTS) + """
SELECT o.ImageNumber, o.ObjectNumber, o.Metadata_FileLocation, o.l_linenumber, o.l_partkey, o.l_quantity,
       round(o.l_extendedprice, 6) AS l_extendedprice, o.l_tax, o.p_size, o.p_retailprice,
       round(g.AreaShape_Area, 6) AS AreaShape_Area, g.Children_Count
FROM objects o JOIN org g ON o.ObjectNumber = g.ObjectNumber AND o.ImageNumber = g.ImageNumber""")
def q_nuclei_columns(spark, sf_dir):
    """The joined table without the columns whose name marks them as the parent's."""
    j = J.suffix_join(D.objects(spark, sf_dir), D.organoids(spark, sf_dir), on=["ObjectNumber", "ImageNumber"],
                      how="inner", suffixes=("", "_Organoid"))
    return stable(CO.drop_columns_containing(j, "_Organoid"))


# --------------------------------------------------------------------------
# Label-sized reshapes: R-5, R-7
# --------------------------------------------------------------------------
_DRUG_MEDIANS = ",\nmd AS (SELECT Drug, " + ", ".join(f"median({c}) AS {c}" for c in O.FEATURES) + \
    " FROM organoids GROUP BY Drug),\nmt AS " + O.tall("md", "Drug", name="key")


@register("drug_medians_transposed", _ORG + _DRUG_MEDIANS + "\nSELECT key, " + ", ".join(
    f"round(max(CASE WHEN Drug = '{d}' THEN _v END), 6) AS \"{d}\"" for d in _FLAGS) + " FROM mt GROUP BY key")
def q_drug_medians_transposed(spark, sf_dir):
    """R-5: the median profile of each drug, a row a feature."""
    fs = C.organoids(spark, sf_dir)
    return stable(RS.transpose_small(A.group_median(fs.df, ["Drug"], list(fs.features)), "Drug"))


@register("control_profile_repeated", _ORG + ",\nmc AS (SELECT Cell, " + ", ".join(
    f"median({c}) AS {c}" for c in O.FEATURES) + " FROM organoids WHERE Drug = 'Control' GROUP BY Cell)\nSELECT Cell, "
    + _ROUNDED + ", CAST(unnest(range(0, 3)) AS INT) AS repeat FROM mc")
def q_control_profile_repeated(spark, sf_dir):
    """R-7: each control profile three times."""
    ref = DIST.reference_profiles(C.organoids(spark, sf_dir), ["Cell"], F.col("Drug") == "Control")
    return stable(RS.repeat_rows(ref, 3))


# --------------------------------------------------------------------------
# Folds, selections, homogeneity, components of populations: MM4, MM14, A28, MM16
# --------------------------------------------------------------------------
_FOLDS = 5


@register("stratified_fold_ids", _ORG + f""",
h AS (SELECT {_KEYS}, {O.ORG_HASH} AS _h FROM organoids),
c AS (SELECT Drug, count(*) AS n, min(_h) AS first FROM h GROUP BY Drug),
s AS (SELECT *, sum(n) OVER (ORDER BY first, Drug) - n AS start FROM c),
f AS (SELECT *, unnest(range(0, {_FOLDS})) AS fold FROM s),
g AS (SELECT *, len(range((fold - start + {_FOLDS} * n * 1000)::BIGINT % {_FOLDS}, n::BIGINT, {_FOLDS})) AS share FROM f),
e AS (SELECT *, sum(share) OVER (PARTITION BY Drug ORDER BY fold) AS upto FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY Drug ORDER BY _h) AS rn FROM h)
SELECT r.Date, r.Drug, r.Cell, r.Replicate, r."Conc /uM", r.ImageNumber, CAST(e.fold AS INT) AS fold
FROM r JOIN e ON r.Drug = e.Drug AND r.rn <= e.upto AND r.rn > e.upto - e.share""")
def q_stratified_fold_ids(spark, sf_dir):
    """MM4: the unshuffled stratified folds that the cross-validated scores use."""
    keys = CO.key_table(C.organoids(spark, sf_dir).df, ORGANOID_KEYS).withColumn("_h", C._org_hash())
    return M.stratified_folds(keys, "Drug", ["_h"], _FOLDS).drop("_h")


@register("features_by_percentile", C._CELLS + "," + C._TALL_DRUG + """,
g AS (SELECT feature, Drug, count(*) AS n, avg(_v) AS m, var_pop(_v) AS v FROM t GROUP BY ALL),
a AS (SELECT feature, sum(n) AS nt, sum(n * m) / sum(n) AS mu FROM g GROUP BY feature),
f AS (SELECT feature, (sum(n * (m - mu) * (m - mu)) / (count(*) - 1)) / nullif(sum(n * v) / (any_value(nt) - count(*)), 0) AS F
      FROM g JOIN a USING (feature) GROUP BY feature),
k AS (SELECT *, row_number() OVER (ORDER BY F DESC NULLS LAST, feature) AS rn, count(*) OVER () AS p FROM f)
SELECT feature, rn <= greatest(1, floor(p * 50 / 100)) AS selected FROM k""")
def q_features_by_percentile(spark, sf_dir):
    """MM14: the half of the features with the larger F."""
    scores = M.anova_f(C.cells(spark, sf_dir), "Drug")
    return scores.select("feature", F.col("feature").isin(M.select_percentile(scores, 50.0)).alias("selected"))


@register("language_homogeneity", O.with_(O.PREDICTIONS) + """,
n AS (SELECT count(*) AS n FROM preds),
j AS (SELECT truth, pred, count(*) AS c FROM preds GROUP BY ALL),
t AS (SELECT truth, sum(c) AS ct FROM j GROUP BY truth),
k AS (SELECT pred, sum(c) AS ck FROM j GROUP BY pred),
hc AS (SELECT -sum((ct / n) * ln(ct / n)) AS h FROM t, n),
hk AS (SELECT -sum((c / n) * ln(c / ck)) AS h FROM j JOIN k USING (pred), n)
SELECT n, round(CASE WHEN hc.h = 0 THEN 1.0 ELSE 1 - hk.h / hc.h END, 6) AS homogeneity FROM n, hc, hk""")
def q_language_homogeneity(spark, sf_dir):
    """A28 on given clusters: how far the keyword rule's classes keep to one language."""
    preds = C.predictions(spark, sf_dir)
    h = M.cluster_homogeneity(preds, "truth", "pred")
    return stable(preds.agg(F.count(F.lit(1)).alias("n")).withColumn("homogeneity", F.lit(h)))


_DOSE = 0.05
_POPULATIONS = {"per_organoid": "organoids",
                f"per_organoid_{_DOSE}uM": f'(SELECT * FROM organoids WHERE "Conc /uM" = {_DOSE})',
                f"per_organoid_{_DOSE}uM_control": f'(SELECT * FROM organoids WHERE "Conc /uM" = {_DOSE} OR Drug = \'Control\')'}


def _variants_sql() -> str:
    ctes, parts = [], []
    for i, (name, rows) in enumerate(_POPULATIONS.items()):
        z = f"SELECT {_KEYS}, " + ", ".join(f"{O.zscore_sql(c)} AS {c}" for c in O.FEATURES) + f" FROM {rows}"
        ctes += [f"z{i} AS MATERIALIZED ({z})", OA.component_ctes(f"z{i}", O.FEATURES, f"pc{i}_")]
        parts.append(OA.scores_sql(f"z{i}", O.FEATURES, f"pc{i}_", _KEYS, f", '{name}' AS variant"))
    return _ORG + ",\n" + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(parts)


@register("pca_of_populations", _variants_sql())
def q_pca_of_populations(spark, sf_dir):
    """MM16: components of all medians, of one dose, and of one dose with the controls."""
    from morphospark.plans.classification import pca_variants

    return stable(pca_variants(None, C.organoids(spark, sf_dir), _DOSE))


# --------------------------------------------------------------------------
# Wide profiles: 64 features of the embeddings (J8, A2, MM8, MM13, A16)
# --------------------------------------------------------------------------
_DIMS = 64
_WIDE = [f"f{i:02d}" for i in range(_DIMS)]
_WIDE_SQL = "WITH wide AS (SELECT vec_id, CAST(label AS VARCHAR) AS Drug, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(_WIDE)) + " FROM embeddings)"
_WIDE_MEDIANS = ", ".join(f"median({c}) AS {c}" for c in _WIDE)


def _wide(spark, sf_dir) -> FeatureSet:
    return FeatureSet(D.embeddings_wide(spark, sf_dir, _DIMS), ("vec_id", "Drug"), tuple(_WIDE))


@register("wide_medians", _WIDE_SQL + f" SELECT Drug, {', '.join(f'round(median({c}), 6) AS {c}' for c in _WIDE)} FROM wide GROUP BY Drug")
def q_wide_medians(spark, sf_dir):
    """A2 over 64 features: the median profile of each label."""
    return stable(A.group_median(_wide(spark, sf_dir).df, ["Drug"], _WIDE))


@register("wide_standard_scaled", _WIDE_SQL + " SELECT vec_id, Drug, " + ", ".join(
    f"round({O.zscore_sql(c)}, 6) AS {c}" for c in _WIDE) + " FROM wide")
def q_wide_standard_scaled(spark, sf_dir):
    """MM8 over 64 features: one aggregate for all means and deviations."""
    return stable(SC.standard_scale(_wide(spark, sf_dir)).select())


@register("wide_anova_f", _WIDE_SQL + ",\nt AS (UNPIVOT wide ON " + ", ".join(_WIDE) + """ INTO NAME feature VALUE _v),
g AS (SELECT feature, Drug, count(*) AS n, avg(_v) AS m, var_pop(_v) AS v FROM t GROUP BY ALL),
a AS (SELECT feature, avg(_v) AS mu, count(*) AS nt FROM t GROUP BY feature)
SELECT feature, round((sum(n * (m - mu) * (m - mu)) / (count(*) - 1)) / nullif(sum(n * v) / (any_value(nt) - count(*)), 0), 6)
       AS F FROM g JOIN a USING (feature) GROUP BY feature""")
def q_wide_anova_f(spark, sf_dir):
    """MM13 over 64 features."""
    return stable(M.anova_f(_wide(spark, sf_dir), "Drug"))


@register("wide_distance_to_own_median", _WIDE_SQL + f""",
ref AS (SELECT Drug, {_WIDE_MEDIANS} FROM wide GROUP BY Drug)
SELECT w.vec_id, w.Drug, round(sqrt(""" + " + ".join(f"(w.{c} - r.{c}) * (w.{c} - r.{c})" for c in _WIDE)
          + "), 6) AS distance FROM wide w JOIN ref r ON w.Drug = r.Drug")
def q_wide_distance_to_own_median(spark, sf_dir):
    """J9 over 64 features: distance of each profile to the median profile of its label."""
    fs = _wide(spark, sf_dir)
    return stable(DIST.distance_to_reference(fs, DIST.reference_profiles(fs, ["Drug"]), ["Drug"]))


@register("embedding_nearest_centroid", """WITH x AS (SELECT vec_id, CAST(label AS VARCHAR) AS Drug, CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings),
e AS (SELECT Drug, unnest(v) AS _x, unnest(range(0, len(v))) AS i FROM x),
m AS (SELECT Drug, i, avg(_x) AS _x FROM e GROUP BY ALL),
c AS (SELECT Drug AS nearest, list(_x ORDER BY i) AS c FROM m GROUP BY Drug),
d AS (SELECT x.vec_id, x.Drug, c.nearest, list_distance(x.v, c.c) AS distance FROM x, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, nearest) AS rn FROM d)
SELECT vec_id, Drug, nearest, round(distance, 6) AS distance FROM r WHERE rn = 1""")
def q_embedding_nearest_centroid(spark, sf_dir):
    """J8, a row a profile: the class centroid nearest to it."""
    return stable(DIST.nearest_centroid(D.embeddings_profiles(spark, sf_dir), "vec_id", "Drug", "features"))


# --------------------------------------------------------------------------
# Other estimators (MM24)
# --------------------------------------------------------------------------
@register("logistic_class_totals", _ORG + """
SELECT Drug, count(*) AS n, true AS totals_met FROM organoids GROUP BY Drug""")
def q_logistic_class_totals(spark, sf_dir):
    """MM24 logistic regression on all medians: at the largest likelihood the probabilities of a class add up to
    its rows; ``totals_met`` says whether they do, to one row in a thousand."""
    fs = C.scaled_organoids(spark, sf_dir)
    clf = M.Classifier(fs, "Drug", estimator="logistic_regression")
    sums = clf.predict_proba_long(fs, keep=("ImageNumber",)).groupBy(F.col("class").alias("Drug")).agg(
        F.sum("probability").alias("_p"))
    n = fs.df.groupBy("Drug").agg(F.count(F.lit(1)).alias("n"))
    total = fs.df.count()
    return n.join(sums, "Drug").select("Drug", "n", (F.abs(F.col("_p") - F.col("n")) <= 0.001 * total).alias("totals_met"))


@register("linear_estimators_holdout")
def q_linear_estimators_holdout(spark, sf_dir):
    """MM24: logistic regression, linear support vectors and a perceptron, fitted on the first half in hash order and
    scored on the other."""
    fs = C.scaled_organoids(spark, sf_dir)
    flagged = stage(RK.split_flag_ordered(fs.df.withColumn("_h", C._org_hash()), ["_h"]), "halves")
    train, test = (FeatureSet(flagged.filter(F.col("is_train") == flag), fs.keys, fs.features) for flag in (True, False))
    n_test, classes = test.df.count(), train.df.select("Drug").distinct().count()
    settings = {"logistic_regression": {}, "linear_svc": {}, "mlp": {"layers": [len(fs.features), 8, classes + 1]}}
    rows = concurrently(spark, list(settings), lambda name: (
        name, n_test, M.Classifier(train, "Drug", estimator=name, seed=0, **settings[name]).score(test)), 3)
    return stable(spark.createDataFrame(rows, "estimator string, n_test long, accuracy double"))
