"""Dose statistics: feature~dose correlation (A9-A11, A15, A29, J7) and the
least-squares line with EC50 (A12, A13, MM12).

All statistics come from map-side combined moment aggregates (avg, var_pop,
covar_pop) over one groupBy, so a hot group costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphospark.featureset import q
from morphospark.functions.numeric import clamp, safe_div
from morphospark.functions.stats import t_pvalue_udf
from morphospark.operators.joins import sized_broadcast

# Fixed values of the EC50 table: response level 0.5 and the 2.58 multiplier.
EC50_TARGET = 0.5
CI_Z = 2.58


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(q(x))


def line_fit(df: DataFrame, keys, x: str, y: str, with_pvalue: bool = False) -> DataFrame:
    """Per group n, m (slope), c (intercept), R, stderr [, pvalue].

    scipy.stats.linregress rules: R = 0 when y is constant, R clipped to
    [-1, 1], stderr = 0 for two points; constant x (Control: every dose 0)
    gives null slope, intercept, R and stderr (ruling Q19).
    """
    X, Y = _c(x).cast("double"), _c(y).cast("double")
    pts = df.filter(X.isNotNull() & Y.isNotNull())
    g = pts.groupBy(*[q(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(X).alias("_mx"), F.avg(Y).alias("_my"),
        F.var_pop(X).alias("_vx"), F.var_pop(Y).alias("_vy"),
        F.covar_pop(X, Y).alias("_cxy"),
    )
    vx, vy, cxy, n = F.col("_vx"), F.col("_vy"), F.col("_cxy"), F.col("n")
    m = safe_div(cxy, vx)
    r = (F.when(vx == 0, F.lit(None).cast("double"))
         .when(vy == 0, F.lit(0.0))
         .otherwise(clamp(cxy / F.sqrt(vx * vy), -1.0, 1.0)))
    out = g.withColumn("m", m).withColumn("c", F.col("_my") - F.col("m") * F.col("_mx")) \
        .withColumn("R", r)
    stderr = (F.when(vx == 0, F.lit(None).cast("double"))
              .when(n == 2, F.lit(0.0))
              .when(n > 2, F.sqrt((1.0 - F.col("R") * F.col("R")) * vy / vx / (n - 2))))
    out = out.withColumn("stderr", stderr)
    if with_pvalue:
        out = out.withColumn("pvalue", F.when(vx != 0, t_pvalue_udf(F.col("R"), n, vy == 0)))
    return out.drop("_mx", "_my", "_vx", "_vy", "_cxy")


def add_ec50(line: DataFrame, target: float = EC50_TARGET, z: float = CI_Z) -> DataFrame:
    """R2, EC50 = |(target - c)/m|, CI = z*stderr, EC50_err = EC50*CI."""
    return line.withColumns({
        "R2": F.col("R") * F.col("R"),
        "EC50 /uM": F.abs(safe_div(F.lit(target) - F.col("c"), "m")),
        "CI": F.lit(z) * F.col("stderr"),
    }).withColumn("EC50_err", F.col("EC50 /uM") * F.col("CI"))


def tall_features(df: DataFrame, keys, features, var: str = "Feature",
                  value: str = "Value", drop_null: bool = True) -> DataFrame:
    """R-1/R-2: wide -> tall (unpivot, an Expand: no shuffle)."""
    base = df.select(*[q(k) for k in keys], *[F.col(q(c)).cast("double").alias(c) for c in features])
    tall = base.unpivot([q(k) for k in keys], [q(c) for c in features], var, value)
    return tall.filter(F.col(value).isNotNull()) if drop_null else tall


def pearson_r(x: Column, y: Column) -> Column:
    """Aggregate Pearson r; null when either side is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def feature_dose_correlation(df: DataFrame, features, dose: str = "Conc /uM",
                             by=("Drug",), out: str = "Correlation") -> DataFrame:
    """A9 (by=Drug) / A10 (by=()): r of every feature with dose.

    Rows (by..., Features, Correlation); pairwise-complete observations.
    """
    by = list(by)
    tall = tall_features(df.withColumn("_dose", _c(dose).cast("double")),
                         by + ["_dose"], features, "Features", "_v")
    tall = tall.filter(F.col("_dose").isNotNull())
    return tall.groupBy(*[q(k) for k in by], "Features").agg(
        pearson_r(F.col("_dose"), F.col("_v")).alias(out))


def standardise_column(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """(x - mean)/std_pop over the rows of a small table; constant -> 0.

    The two scalars come back from one aggregate and enter as literals."""
    out = out or col
    m, s = df.agg(F.avg(_c(col)), F.stddev_pop(_c(col))).first()
    if m is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    z = F.lit(0.0) if not s else (_c(col) - F.lit(m)) / F.lit(s)
    return df.withColumn(out, z)


def best_per_group(corr: DataFrame, by: str = "Drug", feature: str = "Features",
                   value: str = "Correlation") -> DataFrame:
    """Per group the feature with the largest (signed) value; nulls
    excluded; ties -> larger feature name.  A max over a struct: no window."""
    best = corr.filter(_c(value).isNotNull()).groupBy(q(by)).agg(
        F.max(F.struct(_c(value).alias("v"), _c(feature).alias("f"))).alias("_b"))
    return best.select(q(by), F.col("_b.f").alias(feature), F.col("_b.v").alias(value))


def best_feature_values(medians: DataFrame, keys, features, best: DataFrame,
                        by: str = "Drug", feature: str = "Features") -> DataFrame:
    """The tall median values of each group's best feature."""
    keys = list(keys)
    tall = tall_features(medians, keys, features, "Feature", "Magnitude")
    sel = best.select(F.col(q(by)).alias(by), F.col(q(feature)).alias("Feature"))
    return tall.join(sized_broadcast(sel), on=[by, "Feature"], how="inner")


def label_code_correlation(df: DataFrame, features, code: str) -> DataFrame:
    """R of every feature with integer label codes, sorted descending."""
    return feature_dose_correlation(df, features, dose=code, by=()).orderBy(
        F.col("Correlation").desc_nulls_last(), "Features")
