"""morphospark: morphological-profiling operators on Spark DataFrames.

Every operator takes and returns a :class:`pyspark.sql.DataFrame`; keys and
feature columns are passed explicitly (see :class:`FeatureSet`).
"""

from morphospark.featureset import FeatureSet
from morphospark.session import ensure_checkpoint_dir, get_spark

__all__ = ["FeatureSet", "ensure_checkpoint_dir", "get_spark"]
__version__ = "0.1.0"
