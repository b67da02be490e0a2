"""Totals and shapes that the reference prints, as a (metric, value) table.

``Observed`` measures what passes through a write: Spark adds the numbers up
while it writes, so they cost no pass of their own and describe exactly the
rows that were written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from morphospark.featureset import FeatureSet, q


class Observed:
    """Metrics gathered while tables are written."""

    def __init__(self):
        self._seen: dict[str, tuple[Observation, int]] = {}

    def rows(self, name: str, fs: FeatureSet) -> DataFrame:
        """The rows of ``fs``; once they are written, their number and that of their objects are known."""
        first = F.count(F.col(q(fs.features[0]))) if fs.features else F.count(F.lit(1))
        seen = Observation(name)
        self._seen[name] = (seen, len(fs.features))
        return fs.select().observe(seen, F.count(F.lit(1)).alias("rows"), first.alias("objects"))

    def table(self, spark: SparkSession, **more: float) -> DataFrame:
        """(metric, value): rows, objects (non-null values of the first feature, A21) and features of every table
        that was written, and the given numbers."""
        values = []
        for name, (seen, features) in self._seen.items():
            values += [(f"{name}.{k}", float(v)) for k, v in seen.get.items()] + [(f"{name}.features", float(features))]
        values += [(k, float(v)) for k, v in more.items()]
        return spark.createDataFrame(values, "metric string, value double")
