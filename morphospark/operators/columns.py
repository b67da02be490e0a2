"""Projections and column-level operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphospark.featureset import FeatureSet, q


def select_columns(df: DataFrame, cols) -> DataFrame:
    """P1."""
    return df.select(*[q(c) for c in cols])


def filter_columns_regex(df: DataFrame, pattern: str, keep=()) -> DataFrame:
    """Keep columns whose name matches ``pattern`` (re.search, like pandas)."""
    rx = re.compile(pattern)
    return df.select(*[q(c) for c in df.columns if c in keep or rx.search(c)])


def drop_columns_containing(df: DataFrame, text: str) -> DataFrame:
    """Drop every column whose name contains ``text``."""
    return df.select(*[q(c) for c in df.columns if text not in c])


def drop_listed(df: DataFrame, names) -> DataFrame:
    """Drop listed columns, ignoring names that are absent."""
    present = [c for c in dict.fromkeys(names) if c in df.columns]
    return df.drop(*present)


def numeric_columns(df: DataFrame, keys=()) -> list[str]:
    """Numeric (not boolean) non-key columns."""
    return [f.name for f in df.schema.fields
            if f.name not in keys and isinstance(f.dataType, T.NumericType)]


def keep_numeric(df: DataFrame, keys) -> FeatureSet:
    """Keys plus numeric feature columns."""
    feats = numeric_columns(df, keys)
    return FeatureSet(df.select(*[q(c) for c in list(keys) + feats]), tuple(keys), tuple(feats))


def null_counts(df: DataFrame, cols) -> dict:
    """One aggregate over all columns: number of null (or NaN) values each."""
    exprs = []
    for c in cols:
        x = F.col(q(c))
        dtype = df.schema[c].dataType
        miss = x.isNull() | F.isnan(x) if isinstance(dtype, (T.DoubleType, T.FloatType)) else x.isNull()
        exprs.append(F.sum(miss.cast("long")).alias(c))
    row = df.agg(*exprs).first()
    return {c: int(row[c] or 0) for c in cols}


def drop_null_columns(df: DataFrame, cols=None, keep=()) -> DataFrame:
    """P5 (eager): drop columns having any null; one aggregate action."""
    cols = [c for c in (cols or df.columns) if c not in keep]
    counts = null_counts(df, cols)
    return df.drop(*[c for c, n in counts.items() if n > 0])


def drop_null_features(fs: FeatureSet) -> FeatureSet:
    counts = null_counts(fs.df, fs.features)
    bad = [c for c, n in counts.items() if n > 0]
    return FeatureSet(fs.df.drop(*bad), fs.keys, tuple(c for c in fs.features if c not in bad))


def cast_features(fs: FeatureSet, dtype: str = "double") -> FeatureSet:
    """Features to float64."""
    df = fs.df.select(*[q(k) for k in fs.keys],
                      *[F.col(q(c)).cast(dtype).alias(c) for c in fs.features])
    return FeatureSet(df, fs.keys, fs.features)


def rename_columns(df: DataFrame, mapping: dict) -> DataFrame:
    """P7."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def add_columns(df: DataFrame, exprs: dict) -> DataFrame:
    """add/overwrite columns from expressions or constants."""
    return df.withColumns({k: (v if hasattr(v, "alias") else F.lit(v)) for k, v in exprs.items()})


def key_table(df: DataFrame, keys) -> DataFrame:
    """P10: the key levels as a table."""
    return df.select(*[q(k) for k in keys])


def weight_features(fs: FeatureSet, weights: dict) -> FeatureSet:
    """Multiply each feature by its weight (absent weight -> unchanged)."""
    df = fs.df.select(*[q(k) for k in fs.keys],
                      *[(F.col(q(c)) * F.lit(float(weights[c]))).alias(c) if c in weights
                        else F.col(q(c)) for c in fs.features])
    return FeatureSet(df, fs.keys, fs.features)


def choose_feature_source(sources: dict, order=("weighted", "selected", "scaled")):
    """The first available of the named feature tables."""
    for name in order:
        if sources.get(name) is not None:
            return name, sources[name]
    raise KeyError(f"none of {order} available")
