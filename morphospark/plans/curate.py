"""Exported tables -> curated per-object and per-organoid feature tables.

objects --(F1-F6 path metadata)--> keys; P11 null keys, P12 exclusions;
left join images (J2, suffix _Image); drop list (P3); numeric (P4); columns
with any null dropped (P5, one aggregate); float64 (P6).  Filters are
applied before the join (Catalyst would push them anyway) and the image
table joins on ImageNumber only, so the join's hash partitioning on
ImageNumber also serves the per-organoid median, whose keys start with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphospark.featureset import INDEX_KEYS, ORGANOID_KEYS, FeatureSet, q
from morphospark.functions.metadata import add_path_metadata
from morphospark.operators.aggregate import group_median
from morphospark.operators.columns import cast_features, drop_listed, drop_null_features, keep_numeric
from morphospark.operators.joins import suffix_join
from morphospark.operators.rows import drop_null_keys, exclude_pairs
from morphospark.session import stage

DEFAULT_EXCLUSIONS = (("5FU", "ISO34"),)


def annotate(objects: DataFrame, images: DataFrame | None = None,
             path_col: str = "Metadata_FileLocation", zero_is_control: bool = True,
             exclusions=DEFAULT_EXCLUSIONS, strict: bool = True) -> DataFrame:
    """Objects with metadata keys, filtered, joined to their image row."""
    df = add_path_metadata(objects, path_col, zero_is_control, strict)
    df = drop_null_keys(df, INDEX_KEYS)
    df = exclude_pairs(df, exclusions)
    if images is not None:
        df = suffix_join(df, images, on="ImageNumber", how="left", suffixes=("", "_Image"))
    return df


def curate_objects(objects: DataFrame, images: DataFrame | None = None, drop_list=(),
                   materialize: bool = True, drop_nulls: bool = True, **kw) -> FeatureSet:
    """Per-object FeatureSet keyed by the 7 index keys.

    ``drop_nulls=False`` keeps features with a null in some object, as the
    input of medians: those drop a feature only for a null median.

    With ``stage`` the joined numeric table is checkpointed (reliable
    storage) before the P5 null-count action, so the path parsing and the
    join run once; the returned plan reads the staged rows.
    """
    df = drop_listed(annotate(objects, images, **kw), drop_list)
    fs = cast_features(keep_numeric(df, INDEX_KEYS))
    if materialize:
        fs = fs.with_df(stage(fs.df, "cells"))
    return drop_null_features(fs) if drop_nulls else fs


def median_per_organoid(cells: FeatureSet, method: str = "exact",
                        threshold: int | None = None, materialize: bool = True) -> FeatureSet:
    """A2 per (Date, Drug, Cell, Replicate, dose, ImageNumber); all-null
    feature columns of the result are dropped as the reference's dropna.
    With ``stage`` the medians are checkpointed first, so the null-count
    action and the consumers read them instead of recomputing them."""
    med = group_median(cells.df, ORGANOID_KEYS, cells.features, method=method,
                       threshold=threshold)
    if materialize:
        med = stage(med, "organoids")
    return drop_null_features(FeatureSet(med, ORGANOID_KEYS, cells.features))


def curate_with_medians(objects: DataFrame, images: DataFrame | None = None, drop_list=(),
                        method: str = "exact", threshold: int | None = None,
                        image_keys: DataFrame | None = None, **kw) -> tuple[FeatureSet, FeatureSet]:
    """E1 in one pass over the objects: (cells, medians).

    The per-organoid median aggregation also counts rows and non-null
    values per group, so P5 (drop features with any null in the per-object
    table) is answered from the staged median table - no separate action
    over the objects, and the aggregation keeps the image join's hash
    partitioning on ImageNumber (no extra shuffle).  ``cells`` stays lazy.
    """
    df = drop_listed(annotate(objects, images, **kw), drop_list)
    fs = cast_features(keep_numeric(df, INDEX_KEYS))
    feats = list(fs.features)
    # hot-group detection on ImageNumber alone (a hot organoid group implies a
    # hot image), from a one-column scan when the caller provides one
    detect = (image_keys if image_keys is not None else objects.select("ImageNumber"), ["ImageNumber"])
    med = stage(group_median(fs.df, ORGANOID_KEYS, feats, method=method, threshold=threshold,
                             with_counts=True, detect=detect), "organoids")
    nulls = med.agg(*[F.sum(F.col("_rows") - F.col(f"_nonnull{i}")).alias(f"n{i}") for i in range(len(feats))],
                    *[F.count_if(F.col(q(c)).isNull()).alias(f"m{i}") for i, c in enumerate(feats)]).first()
    keep = tuple(c for i, c in enumerate(feats) if not (nulls[f"n{i}"] or 0))
    cells = FeatureSet(fs.df.select(*[q(k) for k in INDEX_KEYS], *[q(c) for c in keep]), INDEX_KEYS, keep)
    # a feature with a null in some object still has its medians; only a null median drops it there
    whole = tuple(c for i, c in enumerate(feats) if not (nulls[f"m{i}"] or 0))
    medians = FeatureSet(med.select(*[q(k) for k in ORGANOID_KEYS], *[q(c) for c in whole]),
                         ORGANOID_KEYS, whole)
    return cells, medians


def organoid_summary(fs: FeatureSet, name: str) -> DataFrame:
    """A3: per (Drug, Cell, dose) non-null counts, first column renamed."""
    from morphospark.operators.aggregate import count_non_null

    return count_non_null(fs.df, ["Drug", "Cell", "Conc /uM"], list(fs.features), first_name=name)


def write_curated(cells: FeatureSet, medians: FeatureSet, out_dir: str) -> None:
    """S3: stage both tables as Parquet, partitioned by Cell."""
    cells.select().write.mode("overwrite").partitionBy("Cell").parquet(f"{out_dir}/cells")
    medians.select().write.mode("overwrite").partitionBy("Cell").parquet(f"{out_dir}/organoids")


def feature_columns(fs: FeatureSet):
    return [F.col(q(c)) for c in fs.features]
