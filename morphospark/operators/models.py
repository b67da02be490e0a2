"""Model and statistics operators on Spark ML (MM1, MM4, MM10, MM11,
MM13-MM15, MM17, MM19, MM24; MM18 is in ``ransac``, MM25 in ``importance``,
the random forest of ``Classifier`` in ``forest``, extra trees, bagging and
voting in ``ensembles``).

Fits are distributed by Spark ML (tree statistics and Gram matrices are
aggregated on executors); only models - a few KB to MB, bounded by the
number of features, classes and trees - come back to the driver.
"""

from __future__ import annotations

import math
from contextlib import contextmanager

from pyspark.ml import Pipeline
from pyspark.ml.classification import (LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IndexToString, PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphospark.featureset import FeatureSet, q
from morphospark.operators.forest import RandomForest, RangedRows
from morphospark.operators.importance import permutation_importance  # noqa: F401  (MM25)
from morphospark.operators.prefix import prefix_sums, tall_values
from morphospark.operators.ranking import rank_in_group
from morphospark.operators.ransac import ransac_inliers  # noqa: F401  (MM18)
from morphospark.session import concurrently, stage

FEATURES_VEC = "_features"
LABEL_IDX = "_label"


def assemble(fs: FeatureSet, out: str = FEATURES_VEC) -> DataFrame:
    return VectorAssembler(inputCols=list(fs.features), outputCol=out, handleInvalid="keep") \
        .transform(fs.df)


def make_estimator(name: str = "random_forest", seed: int = 0, **kw):
    """MM24: the swappable estimator (random forest by default)."""
    if name == "random_forest":
        return RandomForestClassifier(
            featuresCol=FEATURES_VEC, labelCol=LABEL_IDX, seed=seed,
            numTrees=kw.get("num_trees", 100), maxDepth=kw.get("max_depth", 12),
            featureSubsetStrategy="sqrt", maxBins=kw.get("max_bins", 32),
            minInstancesPerNode=1, subsamplingRate=1.0, bootstrap=True,
            cacheNodeIds=True, maxMemoryInMB=kw.get("max_memory_mb", 1024))
    if name == "logistic_regression":
        return LogisticRegression(featuresCol=FEATURES_VEC, labelCol=LABEL_IDX, maxIter=kw.get("max_iter", 100))
    if name == "linear_svc":
        # the classes' fits are independent: passes of one fill the cores that another leaves idle
        return OneVsRest(classifier=LinearSVC(maxIter=kw.get("max_iter", 100)),
                         featuresCol=FEATURES_VEC, labelCol=LABEL_IDX, parallelism=kw.get("parallelism", 4))
    if name == "mlp":
        layers = kw["layers"]
        return MultilayerPerceptronClassifier(featuresCol=FEATURES_VEC, labelCol=LABEL_IDX,
                                              layers=layers, seed=seed, maxIter=kw.get("max_iter", 200))
    raise ValueError(name)


#: Rows of one task of a fit, which keeps a few numbers a row and is run hundreds of times.
FIT_ROWS = 1_000_000
#: Rows of a task at least, if there are more tasks than one.
LEAST_FIT_ROWS = 20_000


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in partitions of about ``FIT_ROWS`` rows; of fewer, to at least ``LEAST_FIT_ROWS``, if cores would stay idle.

    Partitions of staged files are cut by bytes, and compressed keys and
    features of millions of rows fit one, or a few for all the cores.
    """
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(-(-rows // FIT_ROWS), min(cores, -(-rows // LEAST_FIT_ROWS)), 1))


def _labelled(fs: FeatureSet, label: str) -> tuple:
    """Rows, features, label as text and keys of a forest."""
    rows = fs.df.withColumn("_label_str", F.col(q(label)).cast("string"))
    return rows, list(fs.features), "_label_str", [k for k in fs.keys if k in fs.df.columns]


class Classifier:
    """MM1: fit / predict / predict_proba / score / importances on a label column."""

    def __init__(self, fs: FeatureSet, label: str, estimator: str = "random_forest", seed: int = 0, **kw):
        self.features, self.label, self.forest, self.spark = list(fs.features), label, None, fs.df.sparkSession
        if estimator == "random_forest":
            self.forest = RandomForest(*_labelled(fs, label), seed, **kw)
            self.classes = self.forest.classes
            return
        # the estimator reads its input several times (metadata, split sampling,
        # binning) and the indexer once more: keep the training rows for the fit
        train = dealt(fs.df.select(*[q(c) for c in self.features], F.col(q(label)).cast("string").alias("_label_str"))) \
            .persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.indexer = StringIndexer(inputCol="_label_str", outputCol=LABEL_IDX,
                                         stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
            self.classes = list(self.indexer.labels)
            est = make_estimator(estimator, seed, **kw)
            vec = VectorAssembler(inputCols=self.features, outputCol=FEATURES_VEC, handleInvalid="keep")
            self.model = Pipeline(stages=[vec, self.indexer, est]).fit(train)
        finally:
            train.unpersist()

    def transform(self, fs_or_df) -> DataFrame:
        df = fs_or_df.df if isinstance(fs_or_df, FeatureSet) else fs_or_df
        df = df.withColumn("_label_str", F.col(q(self.label)).cast("string")) if self.label in df.columns \
            else df.withColumn("_label_str", F.lit(None).cast("string"))
        if self.forest is not None:
            out = df.withColumn("probability", self.forest.probabilities([F.col(q(c)).cast("double") for c in self.features]))
            at = F.array_position("probability", F.array_max("probability")).cast("int")  # the first of equal ones
            return out.withColumn("predicted", F.get(F.array(*[F.lit(c) for c in self.classes]), at - 1))
        out = self.model.transform(df)
        out = IndexToString(inputCol="prediction", outputCol="predicted", labels=self.classes).transform(out)
        return out

    def predict(self, fs, keep=()) -> DataFrame:
        out = self.transform(fs)
        return out.select(*[q(c) for c in keep], "predicted")

    def predict_proba_long(self, fs, keep=(), classes=None) -> DataFrame:
        """Class probabilities as rows (keep..., class, probability) (R-1)."""
        out = self.transform(fs)
        if "probability" not in out.columns:
            raise ValueError("estimator has no probabilities")
        arr = F.col("probability") if self.forest is not None else vector_to_array("probability")
        names = F.array(*[F.lit(c) for c in self.classes])
        # the indexer's extra "unknown" slot (handleInvalid="keep") is dropped
        long = out.select(*[q(c) for c in keep], F.posexplode(arr).alias("_i", "probability")) \
            .filter(F.col("_i") < len(self.classes)) \
            .withColumn("class", F.element_at(names, F.col("_i") + 1)).drop("_i")
        if classes is not None:
            long = long.filter(F.col("class").isin(list(classes)))
        return long

    def score(self, fs) -> float:
        out = self.transform(fs)
        return out.agg(F.avg((F.col("predicted") == F.col("_label_str")).cast("double"))).first()[0]

    def importances(self) -> DataFrame:
        """Feature importances (model-sized table)."""
        vals = self.forest.importances if self.forest is not None else self.model.stages[-1].featureImportances.toArray().tolist()
        return self.spark.createDataFrame(
            [(f, float(v)) for f, v in zip(self.features, vals)], "Feature string, importance double")


# ---------------------------------------------------------------- MM4
def stratified_folds(df: DataFrame, label: str, order, k: int = 5, out: str = "fold") -> DataFrame:
    """Fold ids of the unshuffled stratified rule.

    Classes come in order of their first row, and class c holds the positions
    [s_c, s_c + n_c) of the labels laid end to end in that order; its share of
    fold f is the number of those positions i with i % k == f, and its rows, in
    table order, take the folds as contiguous blocks.  The starts s_c are prefix
    sums over a row a class and the ranks are skew-safe: any number of classes
    will do.  Rows without a label are left out.
    """
    from morphospark.operators.joins import sized_broadcast
    from morphospark.operators.ranking import _col

    known = df.filter(F.col(q(label)).isNotNull())
    sizes = known.groupBy(F.col(q(label)).alias("_class")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*[_col(c).alias(f"o{i}") for i, c in enumerate(order)])).alias("_at"))
    starts = prefix_sums(sizes.select("_class", "_n", F.struct("_at", "_class").alias("_first")), [], "_first", ["_n"])
    share = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: F.greatest(
        F.lit(0), F.ceil((F.col("_n") - F.pmod(f - F.col("_n_before"), F.lit(k))) / F.lit(k))))
    shares = sized_broadcast(starts.select("_class", share.alias("_share")))
    ranked = rank_in_group(known, [label], [_col(c) for c in order], out="_r")  # 1-based
    j = ranked.join(shares, ranked[q(label)] == shares["_class"])
    walk = F.aggregate("_share", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).alias("fold")),
                       lambda a, c: F.struct((a["upto"] + c).alias("upto"), (
                           a["fold"] + F.when(F.col("_r") > a["upto"] + c, 1).otherwise(0)).alias("fold")))
    return j.withColumn(out, walk["fold"]).drop("_class", "_share", "_r")


def cross_val_accuracy(fs: FeatureSet, label: str, order, k: int = 5, seed: int = 0, **kw) -> dict:
    """MM4: k fits; mean and population std of fold accuracies."""
    # what is only there for the order is not written again
    read = [c for c in dict.fromkeys([*fs.keys, label, *fs.features]) if c in fs.df.columns]
    folded = stage(stratified_folds(fs.df, label, order, k).select(*[q(c) for c in read], "fold"), "folds")
    scores = []
    for f in range(k):
        train = FeatureSet(folded.filter(F.col("fold") != f), fs.keys, fs.features)
        test = FeatureSet(folded.filter(F.col("fold") == f), fs.keys, fs.features)
        clf = Classifier(train, label, seed=seed, **kw)
        scores.append(clf.score(test))
    mean = sum(scores) / k
    std = math.sqrt(sum((s - mean) ** 2 for s in scores) / k)
    return {"scores": scores, "mean": mean, "std": std, "lower": mean - 2 * std, "upper": mean + 2 * std}


# ---------------------------------------------------------------- MM10
def pca(fs: FeatureSet, k: int = 2, names=None) -> tuple[FeatureSet, list]:
    """Centred PCA (sklearn); component signs fixed so the largest absolute
    loading is positive.  Returns the projected FeatureSet and the explained
    variance ratios."""
    df = assemble(fs)
    centred = StandardScaler(inputCol=FEATURES_VEC, outputCol="_c", withMean=True, withStd=False).fit(df)
    cdf = centred.transform(df)
    model = PCA(k=k, inputCol="_c", outputCol="_pc").fit(cdf)
    pcm = model.pc.toArray()  # p x k
    signs = [1.0 if pcm[:, j][abs(pcm[:, j]).argmax()] >= 0 else -1.0 for j in range(k)]
    names = names or [f"PC{j + 1}" for j in range(k)]
    arr = vector_to_array("_pc")
    out = model.transform(cdf).select(*[q(c) for c in fs.keys],
                                      *[(arr[j] * F.lit(signs[j])).alias(names[j]) for j in range(k)])
    return FeatureSet(out, fs.keys, tuple(names)), list(model.explainedVariance.toArray())


# ---------------------------------------------------------------- MM11
def select_from_model(fs: FeatureSet, label: str, seed: int = 0, with_pca: bool = True, **kw):
    """MM11: (PCA ->) forest -> keep features with importance >= mean."""
    base = fs
    if with_pca:
        base, _ = pca(fs, k=len(fs.features), names=[f"pc{j}" for j in range(len(fs.features))])
        base = FeatureSet(base.df.join(fs.df.select(*[q(c) for c in fs.keys] + ([q(label)] if label not in fs.keys else [])),
                                       on=list(fs.keys)) if label not in base.df.columns else base.df,
                          base.keys, base.features)
    clf = Classifier(base, label, seed=seed, **kw)
    imp = clf.importances()
    mean = imp.agg(F.avg("importance")).first()[0]
    keep = [r.Feature for r in imp.filter(F.col("importance") >= mean).collect()]
    return FeatureSet(base.df.select(*[q(c) for c in base.keys], *[q(c) for c in keep]), base.keys, tuple(keep)), imp


# ---------------------------------------------------------------- MM13 / MM14
def anova_f(fs: FeatureSet, label: str) -> DataFrame:
    """MM13: one-way ANOVA F per feature (sklearn f_classif) from one groupBy
    over the tall data: F = [sum n_c (m_c - m)^2/(k-1)] / [sum n_c var_c/(N-k)]."""
    from morphospark.operators.dose import tall_features

    tall = tall_features(fs.df, [label], fs.features, "feature", "_v")
    g = tall.groupBy("feature", q(label)).agg(F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_m"),
                                              F.var_pop("_v").alias("_var"))
    tot = tall.groupBy("feature").agg(F.count(F.lit(1)).alias("_ntot"), F.avg("_v").alias("_mu"))
    j = g.join(tot, "feature")
    s = j.groupBy("feature").agg(
        F.sum(F.col("_n") * (F.col("_m") - F.col("_mu")) ** 2).alias("_ssb"),
        F.sum(F.col("_n") * F.col("_var")).alias("_ssw"),
        F.count(F.lit(1)).alias("_k"), F.first("_ntot").alias("_ntot"))
    f = (F.col("_ssb") / (F.col("_k") - 1)) / F.nullif(F.col("_ssw") / (F.col("_ntot") - F.col("_k")), F.lit(0.0))
    return s.select("feature", f.alias("F"))


def select_k_best(scores: DataFrame, k: int, score: str = "F") -> list:
    return [r.feature for r in scores.orderBy(F.col(score).desc_nulls_last(), "feature").limit(k).collect()]


def select_percentile(scores: DataFrame, percentile: float = 10.0, score: str = "F") -> list:
    n = scores.count()
    k = max(1, int(math.floor(n * percentile / 100.0)))
    return select_k_best(scores, k, score)


def chi2_scores(fs: FeatureSet, label: str) -> DataFrame:
    """MM14 chi2 (non-negative features): observed class sums vs expected
    class share x feature total."""
    from morphospark.operators.dose import tall_features

    tall = tall_features(fs.df, [label], fs.features, "feature", "_v")
    n_total = fs.df.count()
    cls = fs.df.groupBy(q(label)).agg((F.count(F.lit(1)) / F.lit(float(n_total))).alias("_p"))
    obs = tall.groupBy("feature", q(label)).agg(F.sum("_v").alias("_o"))
    tot = tall.groupBy("feature").agg(F.sum("_v").alias("_t"))
    j = obs.join(tot, "feature").join(F.broadcast(cls), label)
    e = F.col("_p") * F.col("_t")
    return j.groupBy("feature").agg(F.sum((F.col("_o") - e) ** 2 / F.nullif(e, F.lit(0.0))).alias("chi2"))


def mutual_information_binned(fs: FeatureSet, label: str, bins: int = 10) -> DataFrame:
    """MM14 (re-aimed): mutual information of each feature, quantile-binned
    by rank, with the label: sum p(b,y) ln(p(b,y) / (p(b) p(y))).

    A bin is a range of values, whatever the labels, so the counts by (feature,
    value, label) and the prefix sums by (feature, value) are all it takes.
    """
    own = tall_values(fs.df, [label], fs.features).groupBy("_f", "_v", q(label)).agg(F.count("*").alias("_c"))
    own = stage(own, "mutual")
    ranked = prefix_sums(own.groupBy("_f", "_v").agg(F.sum("_c").alias("_n")), ["_f"], "_v", ["_n"])
    n = own.groupBy("_f").agg(F.sum("_c").alias("_size"))
    binned = ranked.join(F.broadcast(n), "_f").select(
        "_f", "_v", "_size", F.floor(F.col("_n_before") * bins / F.col("_size")).alias("_bin"))
    joint = own.join(binned, ["_f", "_v"]).groupBy("_f", "_bin", q(label), "_size").agg(F.sum("_c").alias("_c"))
    joint = stage(joint, "joint")
    pb = joint.groupBy("_f", "_bin").agg(F.sum("_c").alias("_cb"))
    py = joint.groupBy("_f", q(label)).agg(F.sum("_c").alias("_cy"))
    j = joint.join(pb, ["_f", "_bin"]).join(py, ["_f", label])
    term = (F.col("_c") / F.col("_size")) * F.log((F.col("_c") * F.col("_size")) / (F.col("_cb") * F.col("_cy")))
    names = F.array(*[F.lit(c) for c in fs.features])
    return j.groupBy("_f").agg(F.sum(term).alias("mutual_info")).select(
        F.element_at(names, F.col("_f") + 1).alias("feature"), "mutual_info")


# ---------------------------------------------------------------- MM15
def kmeans_labels(fs: FeatureSet, k: int, seed: int = 0, grid: int = 0):
    """MM15: k-means cluster of every row; optional grid x grid prediction
    over the bounding box of the first two features (explode, no join)."""
    df = assemble(fs)
    model = KMeans(k=k, seed=seed, featuresCol=FEATURES_VEC, predictionCol="cluster").fit(df)
    labelled = model.transform(df).drop(FEATURES_VEC)
    if not grid:
        return labelled, None
    a, b = fs.features[0], fs.features[1]
    lim = fs.df.agg(F.min(q(a)), F.max(q(a)), F.min(q(b)), F.max(q(b))).first()
    spark = fs.df.sparkSession
    steps = spark.range(grid).select(F.col("id").alias("i"))
    g = steps.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    den = max(grid - 1, 1)
    g = g.select((F.lit(lim[0]) + (F.lit(lim[1]) - F.lit(lim[0])) * F.col("i") / den).alias(a),
                 (F.lit(lim[2]) + (F.lit(lim[3]) - F.lit(lim[2])) * F.col("j") / den).alias(b))
    gv = VectorAssembler(inputCols=[a, b], outputCol=FEATURES_VEC).transform(g)
    return labelled, model.transform(gv).drop(FEATURES_VEC)


def cluster_homogeneity(df: DataFrame, truth: str, cluster: str) -> float:
    """homogeneity = 1 - H(C|K)/H(C) from contingency counts."""
    n = df.count()
    cont = df.groupBy(q(truth), q(cluster)).count()
    hc = df.groupBy(q(truth)).count().agg(
        F.sum(-(F.col("count") / n) * F.log(F.col("count") / n))).first()[0] or 0.0
    kk = df.groupBy(q(cluster)).agg(F.count(F.lit(1)).alias("_nk"))
    j = cont.join(kk, cluster)
    hck = j.agg(F.sum(-(F.col("count") / n) * F.log(F.col("count") / F.col("_nk")))).first()[0] or 0.0
    return 1.0 if hc == 0 else 1.0 - hck / hc


# ---------------------------------------------------------------- MM17 / MM19
def huber_weights(fs: FeatureSet, target, epsilon: float = 1.35) -> dict:
    """MM17: Huber regression of target on the features -> coefficient per feature."""
    df = assemble(fs).withColumn("_y", target if not isinstance(target, str) else F.col(q(target)))
    m = LinearRegression(featuresCol=FEATURES_VEC, labelCol="_y", loss="huber", epsilon=epsilon,
                         regParam=1e-4).fit(df.filter(F.col("_y").isNotNull()))
    return dict(zip(fs.features, m.coefficients.toArray().tolist()))


def no_intercept_weights(fs: FeatureSet, target) -> dict:
    """MM19: least squares without intercept -> coefficient per feature."""
    df = assemble(fs).withColumn("_y", target if not isinstance(target, str) else F.col(q(target)))
    m = LinearRegression(featuresCol=FEATURES_VEC, labelCol="_y", fitIntercept=False,
                         regParam=0.0, solver="normal").fit(df)
    return dict(zip(fs.features, m.coefficients.toArray().tolist()))


# ---------------------------------------------------------------- MM14 (RFE)
@contextmanager
def _shared_ranges(fs: FeatureSet, label: str, seed: int, kw: dict):
    """Ranges and dealt rows of the table for forests on some of its features; nothing for other estimators."""
    if kw.get("estimator", "random_forest") != "random_forest":
        yield {}
        return
    ranged = RangedRows(*_labelled(fs, label), seed, kw.get("max_bins", 32))
    try:
        yield {"ranged": ranged}
    finally:
        ranged.release()


def recursive_feature_elimination(fs: FeatureSet, label: str, keep: int, step: int = 1, seed: int = 0,
                                  **kw) -> tuple[list, DataFrame]:
    """MM14 RFE: refit the forest and drop the ``step`` least important
    features until ``keep`` remain.  Returns (kept features, ranking table
    (feature, eliminated_at_round))."""
    feats = list(fs.features)
    ranking, rnd = [], 0
    if len(feats) > keep:
        with _shared_ranges(fs, label, seed, kw) as shared:
            while len(feats) > keep:
                clf = Classifier(FeatureSet(fs.df, fs.keys, tuple(feats)), label, seed=seed, **kw, **shared)
                imp = sorted(((r.importance, r.Feature) for r in clf.importances().collect()))
                drop = [f for _, f in imp[:min(step, len(feats) - keep)]]
                ranking += [(f, rnd) for f in drop]
                feats = [f for f in feats if f not in drop]
                rnd += 1
    ranking += [(f, rnd) for f in feats]
    spark = fs.df.sparkSession
    return feats, spark.createDataFrame(ranking, "feature string, eliminated_at_round int")


def elimination_curve(fs: FeatureSet, label: str, order, folds: int = 5, step: int = 1, seed: int = 0,
                      **kw) -> tuple[list, DataFrame]:
    """MM14 recursive elimination with cross-validation.

    On each training part the least important features go, ``step`` at a time,
    and every set on the way is scored on the held-out fold.  Returns the
    features kept at the best mean accuracy (the smaller set of equal ones) and
    the curve (n_features, fold, accuracy, dropped: the features left out next).
    """
    folded = stage(stratified_folds(fs.df, label, order, folds), "folds")

    def of_fold(f):
        train, test = (FeatureSet(folded.filter(cond), fs.keys, fs.features) for cond in (F.col("fold") != f, F.col("fold") == f))
        feats, found = list(fs.features), []
        with _shared_ranges(train, label, seed, kw) as shared:
            while feats:
                clf = Classifier(FeatureSet(train.df, fs.keys, tuple(feats)), label, seed=seed, **kw, **shared)
                score = clf.score(FeatureSet(test.df, fs.keys, tuple(feats)))
                by = sorted((r.importance, r.Feature) for r in clf.importances().collect())
                drop = [name for _, name in by[:step]] if len(feats) > step else feats
                found.append((len(feats), f, score, ",".join(sorted(drop))))
                feats = [x for x in feats if x not in drop]
        return found

    spark = fs.df.sparkSession
    rows = [row for found in concurrently(spark, range(folds), of_fold, 3, name=lambda f: f"elimination {f}") for row in found]
    mean = {}
    for n, _, score, _ in rows:
        mean.setdefault(n, []).append(score or 0.0)
    best = max(mean, key=lambda n: (sum(mean[n]) / len(mean[n]), -n))
    kept, _ = recursive_feature_elimination(fs, label, best, step, seed, **kw)
    return kept, spark.createDataFrame(rows, "n_features int, fold int, accuracy double, dropped string")
