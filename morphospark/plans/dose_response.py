"""Objects -> inliers -> power transform -> weights or selected components
-> per-organoid profile -> distance to origin -> line and EC50 per (Drug, Cell).

After the preparation two shuffles: the median keys, then Drug x Cell (the
second one carries only partial moment aggregates)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphospark.featureset import ORGANOID_KEYS, FeatureSet, q
from morphospark.functions.numeric import l2_norm
from morphospark.operators.aggregate import group_median
from morphospark.operators.columns import choose_feature_source, weight_features
from morphospark.operators.dose import add_ec50, line_fit

DISTANCE = "Euclidean distance"


def euclid(fs: FeatureSet, out: str = DISTANCE) -> DataFrame:
    """keys + row norm of the features."""
    return fs.df.select(*[q(k) for k in fs.keys], l2_norm(fs.features).alias(out))


def distance_table(medians: FeatureSet, min_group_count: int | None = None) -> DataFrame:
    """The distance table; optional keep-groups-above-count (Q8)."""
    d = euclid(medians)
    if min_group_count is not None:
        keep = d.groupBy("Drug", "Cell").agg(F.count(F.col(q(DISTANCE))).alias("_n")) \
            .filter(F.col("_n") > min_group_count).drop("_n")
        d = d.join(keep, ["Drug", "Cell"], "left_semi")
    return d


def dose_response(medians: FeatureSet, with_pvalue: bool = False,
                  min_group_count: int | None = None) -> DataFrame:
    d = distance_table(medians, min_group_count)
    line = line_fit(d, ["Drug", "Cell"], "Conc /uM", DISTANCE, with_pvalue=with_pvalue)
    return add_ec50(line)


def scaled_objects(cells: FeatureSet, isolate: bool = True, lambdas: dict | None = None,
                   scaler: str = "yeo_johnson", seed: int = 0) -> FeatureSet:
    """Inlying objects (MM6) with scaled features (MM7, or another scaler; ``lambdas`` fixes the exponents)."""
    from morphospark.operators.outliers import isolation_inliers
    from morphospark.operators.scale import apply_yeo_johnson, scale
    from morphospark.session import stage

    if isolate:
        cells = isolation_inliers(cells, seed=seed)
        cells = cells.with_df(stage(cells.df, "inliers"))  # scored once, read by every pass of the fit
    scaled = apply_yeo_johnson(cells, lambdas) if lambdas is not None else scale(cells, scaler)
    return scaled.with_df(stage(scaled.df, "scaled"))


def control_weights(scaled: FeatureSet) -> dict:
    """MM19: weight of each feature in a regression, without intercept, of the control rows on their median norm."""
    from morphospark.operators.models import no_intercept_weights

    control = FeatureSet(scaled.df.filter(F.col("Drug") == "Control"), scaled.keys, scaled.features)
    norms = control.df.select(F.lit(1).alias("all"), l2_norm(control.features).alias("norm"))
    median = group_median(norms, ["all"], ["norm"]).first()
    return {} if median is None else no_intercept_weights(control, F.lit(median["norm"]))


def profiles(scaled: FeatureSet, source: str | None = None, label: str = "Drug", seed: int = 0,
             **forest) -> tuple[str, FeatureSet]:
    """(name, medians per organoid) of the wanted feature source.

    ``selected``: components of the medians that matter to a forest on ``label``
    (MM10, MM11); ``weighted``: features times their control weight (P21, MM19);
    ``scaled``: as they are.  Without a name the first of the three that can be
    made: weights need control rows, a selection at least two labels.
    """
    from morphospark.operators.models import select_from_model
    from morphospark.plans.curate import median_per_organoid

    medians = median_per_organoid(scaled)
    sources = {"scaled": medians}
    if source in (None, "weighted"):
        weights = control_weights(scaled)
        if weights:
            sources["weighted"] = median_per_organoid(weight_features(scaled, weights))
    if source in (None, "selected") and medians.df.select(label).distinct().limit(2).count() == 2:
        sources["selected"] = select_from_model(medians, label, seed=seed, **forest)[0]
    return choose_feature_source(sources, (source,) if source else ("selected", "weighted", "scaled"))


def prepared_dose_response(cells: FeatureSet, source: str | None = "scaled", isolate: bool = True,
                           lambdas: dict | None = None, scaler: str = "yeo_johnson", seed: int = 0,
                           min_group_count: int | None = None, **forest) -> DataFrame:
    """E3 whole, with p-values; ``Source`` names the features that the distances are made of."""
    scaled = scaled_objects(cells, isolate, lambdas, scaler, seed)
    name, medians = profiles(scaled, source, seed=seed, **forest)
    return dose_response(medians, with_pvalue=True, min_group_count=min_group_count).withColumn("Source", F.lit(name))


__all__ = ["control_weights", "prepared_dose_response", "profiles", "scaled_objects", "ORGANOID_KEYS", "DISTANCE", "euclid", "distance_table", "dose_response"]
