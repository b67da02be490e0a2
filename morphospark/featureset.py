"""FeatureSet: the explicit replacement of a pandas row index."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed key names of the per-object tables.
OBJECT_KEYS = ("ImageNumber", "ObjectNumber")
# Fixed metadata key names parsed from file paths.
PATH_KEYS = ("Date", "Drug", "Cell", "Replicate", "Conc /uM")
DOSE = "Conc /uM"
INDEX_KEYS = OBJECT_KEYS + PATH_KEYS
# Grouping used for the per-organoid median.
ORGANOID_KEYS = ("Date", "Drug", "Cell", "Replicate", "Conc /uM", "ImageNumber")


@dataclass(frozen=True)
class FeatureSet:
    """A DataFrame together with its key columns and feature columns."""

    df: DataFrame
    keys: tuple[str, ...]
    features: tuple[str, ...] = field(default_factory=tuple)

    @staticmethod
    def infer(df: DataFrame, keys) -> "FeatureSet":
        """Features = every numeric (non-boolean) column that is not a key."""
        keys = tuple(keys)
        feats = tuple(
            f.name for f in df.schema.fields
            if f.name not in keys and isinstance(f.dataType, T.NumericType)
        )
        return FeatureSet(df, keys, feats)

    def with_df(self, df: DataFrame, features=None) -> "FeatureSet":
        return FeatureSet(df, self.keys, tuple(features) if features is not None else self.features)

    def select(self) -> DataFrame:
        return self.df.select(*[q(c) for c in self.keys + self.features])


def q(name: str) -> str:
    """Backtick-quote a column name (names contain spaces and slashes)."""
    return "`" + name.replace("`", "``") + "`"
