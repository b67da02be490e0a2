"""Hot-group detection and splitting.

Any key (a drug, the Control label, one image) may hold a large share of all
rows.  Operators that would otherwise put a whole group into one task (exact
median, per-group ranks) first count rows per group - a map-side combined
aggregate, so the count itself is skew-free - and route groups above a row
threshold to a range-partitioned path that spreads one group over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphospark.featureset import q

HOT_ROWS_CONF = "morphospark.hotGroupRows"
DEFAULT_HOT_ROWS = 2_000_000
# Hot groups hold more than `threshold` rows each, so there are at most
# total_rows / threshold of them; beyond this many every group takes the
# range path and nothing is collected.
MAX_HOT_GROUPS = 50_000


def hot_threshold(df: DataFrame, override: int | None = None) -> int:
    if override is not None:
        return int(override)
    return int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))


def null_safe_cond(left: DataFrame, right: DataFrame, keys, right_names=None):
    right_names = right_names or keys
    return reduce(
        lambda a, b: a & b,
        [left[q(k)].eqNullSafe(right[q(r)]) for k, r in zip(keys, right_names)],
    )


# expected sampled rows of a group exactly at the threshold
DETECT_SAMPLE_ROWS = 400


def find_hot_groups(df: DataFrame, keys, threshold: int | None = None, seed: int = 17):
    """Return ("none"|"some"|"all", hot_keys_df_or_None).

    Detection only routes rows - a group missed here is still computed
    exactly on the ordinary path, a false alarm exactly on the range path -
    so it counts a Bernoulli sample whose rate gives a threshold-sized group
    about DETECT_SAMPLE_ROWS sampled rows (rate 1 for small thresholds, as in
    tests).  Groups with at least half that many sampled rows are hot; the
    counting shuffle carries a sample of the groups, not all of them.
    """
    keys = list(keys)
    threshold = hot_threshold(df, threshold)
    rate = min(1.0, DETECT_SAMPLE_ROWS / max(threshold, 1))
    src = df if rate >= 1.0 else df.sample(withReplacement=False, fraction=rate, seed=seed)
    cut = threshold if rate >= 1.0 else DETECT_SAMPLE_ROWS // 2
    counts = src.groupBy(*[q(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    rows = (
        counts.filter(F.col("_n") > cut).select(*[q(k) for k in keys])
        .limit(MAX_HOT_GROUPS + 1).collect()
    )
    if not rows:
        return "none", None
    if len(rows) > MAX_HOT_GROUPS:
        return "all", None
    schema = counts.select(*[q(k) for k in keys]).schema
    hot = df.sparkSession.createDataFrame(rows, schema)
    return "some", hot


def split_hot(df: DataFrame, keys, threshold: int | None = None, detect=None):
    """Split rows into (normal, hot, mode).

    ``hot`` holds the rows of groups above the threshold (or every row when
    there are too many hot groups to list); ``normal`` the rest.  The hot key
    list is broadcast only when its length is bounded by MAX_HOT_GROUPS.

    ``detect=(source_df, coarse_keys)`` finds hot groups on a cheaper source
    (e.g. one pruned column of the raw scan) by a subset of the keys; every
    group inside a hot coarse group is routed to the hot path, which is
    conservative and exact.
    """
    keys = list(keys)
    if detect is not None:
        src, coarse = detect[0], list(detect[1])
    else:
        src, coarse = df, keys
    mode, hot_keys = find_hot_groups(src, coarse, threshold)
    if mode == "none":
        return df, None, mode
    if mode == "all":
        return None, df, mode
    renamed = hot_keys.toDF(*[f"_hot{i}" for i in range(len(coarse))])
    b = F.broadcast(renamed)
    cond = null_safe_cond(df, b, coarse, renamed.columns)
    normal = df.join(b, cond, "left_anti")
    hot = df.join(b, cond, "left_semi")
    return normal, hot, mode
