"""Distances and profile comparisons without all-pairs work.

The reference's all-pairs matrices (J8, J14, A16, A24 and the control
medians of J9) are re-aimed: every row is compared with a *reference
profile* - the exact median (or mean) profile of a reference group such as
Control of the same cell line, or the lowest dose of the same drug.  The
reference table has one row per match key (bounded by labels), so it is an
equi-join on a broadcast side whose size is checked; work stays linear in
the rows.  A27 (two-sample KS) is exact, from prefix sums over distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphospark.featureset import FeatureSet, q
from morphospark.functions.numeric import sum_of_squares
from morphospark.operators.aggregate import group_median
from morphospark.operators.joins import sized_broadcast
from morphospark.operators.prefix import prefix_sums, tall_values
from morphospark.session import stage


def reference_profiles(fs: FeatureSet, match_keys, where: Column | None = None,
                       how: str = "median") -> DataFrame:
    """One profile per match key from the reference rows (exact median by default)."""
    ref = fs.df.filter(where) if where is not None else fs.df
    if how == "mean":
        return ref.groupBy(*[q(k) for k in match_keys]).agg(*[F.avg(F.col(q(c))).alias(c) for c in fs.features])
    return group_median(ref, list(match_keys), list(fs.features))


def distance_to_reference(fs: FeatureSet, ref: DataFrame, match_keys, out: str = "distance") -> DataFrame:
    """J9/A25/A26 re-aimed: Euclidean distance of each row to its reference profile."""
    r = ref.select(*[q(k) for k in match_keys], *[F.col(q(c)).alias(f"_ref_{c}") for c in fs.features])
    j = fs.df.join(sized_broadcast(r), list(match_keys), "left")  # without a reference profile: null
    diffs = [F.col(q(c)) - F.col(q(f"_ref_{c}")) for c in fs.features]
    return j.select(*[q(k) for k in fs.keys], F.sqrt(sum_of_squares(diffs)).alias(out))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's argument is not written into its uses, as Catalyst
    does with columns."""
    return F.transform(F.array(value), body)[0]


def row_correlation(x: Column, y: Column) -> Column:
    """Pearson r of two arrays over the places where both have a value; null where one of them is constant."""
    def mean(values):
        return F.try_divide(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v), F.size(values).cast("double"))

    def sums(m):
        zero = F.struct(F.lit(0.0).alias("ab"), F.lit(0.0).alias("aa"), F.lit(0.0).alias("bb"))
        return F.aggregate(m["pairs"], zero, lambda acc, p: F.struct(
            (acc["ab"] + (p["a"] - m["ma"]) * (p["b"] - m["mb"])).alias("ab"),
            (acc["aa"] + (p["a"] - m["ma"]) * (p["a"] - m["ma"])).alias("aa"),
            (acc["bb"] + (p["b"] - m["mb"]) * (p["b"] - m["mb"])).alias("bb")))

    def of(pairs):
        means = F.struct(pairs.alias("pairs"), mean(F.transform(pairs, lambda p: p["a"])).alias("ma"),
                         mean(F.transform(pairs, lambda p: p["b"])).alias("mb"))
        return _let(_let(means, sums), lambda s: s["ab"] / F.nullif(F.sqrt(s["aa"]) * F.sqrt(s["bb"]), F.lit(0.0)))

    return _let(F.filter(F.zip_with(x, y, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                         lambda p: p["a"].isNotNull() & p["b"].isNotNull()), of)


def correlation_to_reference(fs: FeatureSet, ref: DataFrame, match_keys, out: str = "correlation") -> DataFrame:
    """A16 re-aimed: Pearson r between each row profile and its reference
    profile, across features: one join with a row a match key, no shuffle of the rows."""
    wide = ref.select(*[q(k) for k in match_keys], F.array(*[F.col(q(c)).cast("double") for c in fs.features]).alias("_ref"))
    j = fs.df.join(sized_broadcast(wide), list(match_keys), "left")
    own = F.array(*[F.col(q(c)).cast("double") for c in fs.features])
    return j.select(*[q(k) for k in fs.keys], row_correlation(own, F.col("_ref")).alias(out))


def centroid_distances(df: DataFrame, id_col: str, label: str, vec: str, out: str = "distance") -> DataFrame:
    """J8 re-aimed on array profiles: distance of every vector to every class
    centroid (classes bounded; the centroid table is broadcast after a size
    check and matched by an equi-join on the exploded class id).  Where one row
    a vector will do, ``nearest_centroid`` needs neither."""
    dims = df.select(F.size(vec)).first()[0]
    cent = df.groupBy(q(label)).agg(F.array(*[F.avg(F.col(vec)[i]) for i in range(dims)]).alias("_c"))
    classes = [r[0] for r in cent.select(q(label)).collect()]
    cent = cent.withColumnRenamed(label, "centroid_label")
    rows = df.select(q(id_col), q(label), vec).withColumn(
        "centroid_label", F.explode(F.array(*[F.lit(c) for c in classes])))
    j = rows.join(sized_broadcast(cent), "centroid_label")
    d = F.sqrt(F.aggregate(F.zip_with(F.col(vec), F.col("_c"), lambda a, b: (a - b) * (a - b)),
                           F.lit(0.0), lambda acc, x: acc + x))
    return j.select(q(id_col), q(label), "centroid_label", d.alias(out))


#: Centroids held as a model by ``nearest_centroid``: numbers of all classes together (16 MB).
MODEL_NUMBERS = 2_000_000


def nearest_centroid(df: DataFrame, id_col: str, label: str, vec: str) -> DataFrame:
    """J8 re-aimed, a row a vector: its own class, the nearest class centroid (the first of equal ones) and the distance.

    The centroids are a model of classes x dimensions numbers.  Up to
    ``MODEL_NUMBERS`` they go with the task and every row is compared where it
    lies, without a join; beyond, the rows meet the centroids one by one and the
    nearest is kept by a map-side combined minimum.
    """
    known = df.filter(F.col(q(vec)).isNotNull())
    parts = known.select(q(label), F.posexplode(vec).alias("_i", "_x")).groupBy(q(label), "_i").agg(F.avg("_x").alias("_x"))
    cent = parts.groupBy(F.col(q(label)).alias("nearest")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("_c"))
    cent = stage(cent, "centroids")
    size = cent.agg(F.sum(F.size("_c"))).first()[0] or 0
    if size > MODEL_NUMBERS:
        each = centroid_distances(known, id_col, label, vec)
        best = each.groupBy(q(id_col), q(label)).agg(F.min(F.struct("distance", "centroid_label")).alias("_b"))
        return best.select(q(id_col), q(label), F.col("_b.centroid_label").alias("nearest"), F.col("_b.distance").alias("distance"))
    model = cent.agg(F.array_sort(F.collect_list(F.struct("nearest", "_c"))).alias("_model"))
    every = F.transform("_model", lambda m: F.struct(
        F.sqrt(F.aggregate(F.zip_with(F.col(vec), m["_c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                           lambda acc, x: acc + x)).alias("distance"), m["nearest"].alias("nearest")))
    best = known.withColumn("_model", model.scalar()).withColumn("_b", F.array_min(every))
    return best.select(q(id_col), q(label), F.col("_b.nearest").alias("nearest"), F.col("_b.distance").alias("distance"))


def ks_two_sample(fs: FeatureSet, in_a: Column, in_b: Column) -> DataFrame:
    """Per feature D = max_v |F_A(v) - F_B(v)| (exact).

    Both samples are counted by distinct value; prefix sums of the counts give
    both empirical distribution functions at every value.
    """
    base = fs.df.select(*[q(c) for c in fs.features], F.when(in_a, F.lit("a")).when(in_b, F.lit("b")).alias("_s")) \
        .filter(F.col("_s").isNotNull())
    counts = tall_values(base, ["_s"], fs.features).groupBy("_f", "_v").agg(
        F.count_if(F.col("_s") == "a").alias("_a"), F.count_if(F.col("_s") == "b").alias("_b"))
    at = prefix_sums(counts, ["_f"], "_v", ["_a", "_b"]).select(
        "_f", "_a", "_b", (F.col("_a_before") + F.col("_a")).alias("_ca"), (F.col("_b_before") + F.col("_b")).alias("_cb"))
    sizes = at.groupBy("_f").agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"))
    gap = F.abs(F.try_divide("_ca", "n_a") - F.try_divide("_cb", "n_b"))
    out = at.join(F.broadcast(sizes), "_f").groupBy("_f", "n_a", "n_b").agg(F.max(gap).alias("ks_statistic"))
    names = F.array(*[F.lit(c) for c in fs.features])
    return out.select(F.element_at(names, F.col("_f") + 1).alias("feature"), "ks_statistic", "n_a", "n_b")


def fingerprints(fs: FeatureSet, label: str, k: float = 3.0):
    """MM22: per-label median profile (tall: label, feature, median) and the
    display bounds mean +- k*std over all values (population std)."""
    from morphospark.operators.dose import tall_features

    med = group_median(fs.df, [label], list(fs.features))
    tall = tall_features(med, [label], fs.features, "feature", "median")
    allv = tall_features(fs.df, [label], fs.features, "feature", "_v")
    m, s = F.avg("_v"), F.stddev_pop("_v")
    bounds = allv.agg(m.alias("mean"), s.alias("std"), (m - k * s).alias("lower"), (m + k * s).alias("upper"))
    return tall, bounds


def max_correlation_over_doses(fs: FeatureSet, ref: DataFrame, match_keys, drug: str = "Drug",
                               dose: str = "Conc /uM") -> DataFrame:
    """A24 re-aimed: the dose-independent similarity of a drug to a reference
    profile - per (drug, match keys, dose) the exact median profile, its
    Pearson r with the reference profile, and the maximum over doses."""
    keys = list(dict.fromkeys([drug] + list(match_keys) + [dose]))
    prof = group_median(fs.df, keys, list(fs.features))
    r = correlation_to_reference(FeatureSet(prof, tuple(keys), fs.features), ref, match_keys, "r")
    return r.groupBy(q(drug), *[q(k) for k in match_keys]).agg(F.max("r").alias("max_correlation"))
