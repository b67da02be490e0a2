"""URL patterns whose path has capital letters or many segments."""

from morphospark.llm import queries, urls


def judged(spark, captures, patterns):
    captures = spark.createDataFrame([(i, u, "2024-02-01") for i, u in enumerate(captures)],
                                     "page_id long, url string, fetch_day string")
    entries = spark.createDataFrame([(p, "add", "2024-01-01") for p in patterns],
                                    "pattern string, action string, day string")
    return [(r.blocked, r.pattern) for r in urls.judge(captures, entries).orderBy("page_id").collect()]


def test_paths_keep_their_case(spark):
    got = judged(spark, ["http://Some.ORG/Ads/1", "http://some.org/ads/1", "http://sub.Other.org/X"],
                 ["Some.org/Ads", "OTHER.org"])
    assert got == [(True, "some.org/Ads"), (False, None), (True, "other.org")]


def test_listed_first_path_with_capitals_blocks_in_the_query(spark):
    urls_ = [f"http://h{i}.org/Path{i}/x" for i in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    listed = {r.pattern for r in queries.listing(pages).collect() if "/" in r.pattern}
    captures = queries.captures(pages).selectExpr("page_id", "url", "date'2025-06-01' fetch_day")
    blocked = {r.url for r in urls.judge(captures, queries.listing(pages)).filter("blocked").collect()}
    assert listed and all(f"http://{p}/x" in blocked for p in listed)


def test_deep_paths(spark):
    deep = "/".join(f"d{i}" for i in range(40))
    got = judged(spark, ["http://a.org/1/2/3/4/5/6", "http://a.org/1/2/3/4", f"http://b.org/{deep}/x?q", "http://c.org/"],
                 ["a.org/1/2/3/4/5", f"b.org/{deep}"])
    assert got == [(True, "a.org/1/2/3/4/5"), (False, None), (True, f"b.org/{deep}"), (False, None)]
