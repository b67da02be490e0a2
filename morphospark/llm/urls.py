"""URL filter as a temporal list join.

A list is dated entries (pattern, action, day): a host, a parent domain or a
host with a path prefix that is added to or taken off the list on a day.  The
entries of a pattern become validity intervals [from_day, to_day): the state
after the last entry of a day holds until the next.  Every capture is compared,
as of its fetch day, with the intervals of the patterns it could match: its
host, the host's parents and the host with each leading path, down to the
deepest path of the whole list.

The join is on the pattern and the month; intervals are cut by month, so a
pattern with very many entries meets a capture with few.  Spark splits a
host with most captures (adaptive skew join) and sends the list to every
executor instead if it is small enough to be broadcast.

Edge cases: a capture without URL or day matches nothing and is kept; entries
with a null pattern, day or action are dropped; of several entries of a pattern
on one day, "add" wins; repeated captures are each judged; an empty list blocks
nothing; intervals open at the end are still active; slashes at the end of a
pattern and doubled ones count for nothing, and a pattern without host is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"\.+$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, from_day, to_day) during which each pattern is on the list."""
    # As in candidates(): hosts have no case and no dot at the end, paths keep theirs and no empty segments.
    parts = F.filter(F.split("pattern", "/"), lambda x: x != "")
    host = F.regexp_replace(F.lower(F.element_at(parts, 1)), r"\.+$", "")
    pattern = F.when((F.size(parts) >= 1) & ~F.col("pattern").startswith("/"), F.array_join(
        F.concat(F.array(host), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))), "/"))
    entries = entries.withColumn("pattern", pattern)
    day = entries.filter("pattern is not null and day is not null and action is not null").groupBy(
        pattern.alias("pattern"), F.col("day").cast("date").alias("from_day")).agg(
            F.max(F.when(F.col("action") == "add", 1).otherwise(0)).alias("on"))
    w = W.partitionBy("pattern").orderBy("from_day")
    runs = day.withColumn("before", F.lag("on").over(w)).filter("before is null or before <> on")
    return runs.withColumn("to_day", F.coalesce(F.lead("from_day").over(w), F.lit(FOREVER).cast("date"))) \
        .filter("on = 1").select("pattern", "from_day", "to_day")


def candidates(url: Column, deepest: int | None = None) -> Column:
    """Patterns that would match a URL: host, its parents of two labels or more, host with leading paths.

    No pattern has more than ``deepest`` path segments; all leading paths if it is None.
    """
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    parents = F.when(F.size(labels) >= 2, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array(host))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    if deepest is not None:
        parts = F.slice(parts, 1, deepest)
    paths = F.when(F.size(parts) >= 1, F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(
            F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(parents, paths)))


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def judge(captures: DataFrame, entries: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, fetch_day, blocked, n_matches, pattern, listed_since) of every capture (key, url, fetch_day).

    ``pattern`` is the longest that matches, the first by name of equal ones.
    """
    # Cut by month up to the last month in which a capture was fetched.
    last = F.lit(captures.agg(F.max(_month(F.col("fetch_day")))).first()[0] or 0)
    first = _month(F.col("from_day"))
    listed = intervals(entries).withColumn(
        "month", F.explode(F.when(first <= last, F.sequence(first, F.greatest(first, F.least(
            _month(F.date_sub("to_day", 1)), last))))))
    # Longer leading paths than any pattern has can meet none.
    deepest = max(0, entries.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0)
    rows = captures.select(F.col(key).alias("key"), F.col("url"), F.col("fetch_day").cast("date").alias("fetch_day"))
    asked = rows.filter("url is not null and fetch_day is not null").select(
        "key", "url", "fetch_day", _month(F.col("fetch_day")).alias("month"),
        F.explode(candidates(F.col("url"), deepest)).alias("pattern"))
    hits = asked.join(listed, ["pattern", "month"]).filter("fetch_day >= from_day and fetch_day < to_day")
    best = hits.groupBy("key", "url", "fetch_day").agg(
        F.size(F.collect_set("pattern")).alias("n"),
        F.min(F.struct((-F.length("pattern")).alias("l"), F.col("pattern"), F.col("from_day"))).alias("b"))
    best = best.select(F.col("key").alias("k"), F.col("url").alias("u"), F.col("fetch_day").alias("f"), "n", "b")
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("url") == F.col("u")) & (F.col("fetch_day") == F.col("f"))
    return rows.join(best, same, "left").select(
        F.col("key").alias(key), "url", "fetch_day", F.col("n").isNotNull().alias("blocked"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"), F.col("b.pattern").alias("pattern"),
        F.col("b.from_day").alias("listed_since"))
