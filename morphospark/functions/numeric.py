"""F7-F12 and the small numeric helpers shared by operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from morphospark.featureset import q


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(q(c))


def safe_div(a, b) -> Column:
    """Division that is null (not an ANSI error) when the divisor is 0."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def sum_of_squares(features) -> Column:
    """Left-to-right sum c1*c1 + c2*c2 + ... (same order as the SQL oracle)."""
    return reduce(lambda a, b: a + b, [col(c) * col(c) for c in features])


def l2_norm(features) -> Column:
    """row Euclidean norm over wide feature columns."""
    return F.sqrt(sum_of_squares(features))


def l2_norm_array(arr) -> Column:
    """F9 over an array<double> feature vector."""
    return F.sqrt(F.aggregate(col(arr), F.lit(0.0), lambda acc, x: acc + x * x))


def clamp(c, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(c)))


def nan_to_null(c) -> Column:
    """NaN and null mean the same (missing) in the reference."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def binarize(label, classes) -> dict:
    """one 0/1 column per class."""
    return {f"is_{c}": (col(label) == F.lit(c)).cast("int") for c in classes}


def log10_dose(c) -> Column:
    """F8: log10, null for non-positive dose (numpy gives -inf / nan)."""
    c = col(c)
    return F.when(c > 0, F.log10(c))
