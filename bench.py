"""Benchmark of the headline profiling queries.

Runs on $BENCH_SF_DIR (default /root/testdata/sf0.1) with local[$BENCH_CPUS]
and prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is timed as the median of 3 warm runs; plans are executed in
full through the ``noop`` sink (nothing is collected to the driver except
small results).  Inputs of the later stages (curated cells, organoid
medians) are materialised once, outside the timings, as a job would stage
them as Parquet.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from morphospark.session import get_spark  # noqa: E402


def run_noop(df):
    df.write.format("noop").mode("overwrite").save()


def timed(fn, runs=3):
    fn()  # warm-up
    times = []
    for _ in range(runs):
        t0 = time.perf_counter()
        fn()
        times.append(time.perf_counter() - t0)
    return statistics.median(times)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_spark("morphospark-bench", cpus=cpus, driver_memory="12g")

    from morphospark.plans import catalog as C
    from morphospark.plans.curate import curate_objects, median_per_organoid
    from morphospark.plans.dose_response import dose_response
    from morphospark.operators import dose as DS
    from morphospark.operators import scale as SC
    from morphospark.sources import driver_tables as D

    def curate():
        return curate_objects(D.objects(spark, sf_dir), D.images(spark, sf_dir), drop_list=D.DROP_LIST)

    cells = curate()
    cells = cells.with_df(cells.df.checkpoint(eager=True))
    orgs = median_per_organoid(cells)

    queries = {
        "curate_objects": lambda: run_noop(curate().df),
        "median_per_organoid": lambda: median_per_organoid(cells),
        "dose_response_ec50": lambda: dose_response(median_per_organoid(cells)).collect(),
        "flagship_from_files": lambda: (C._MEMO.clear(), C.flagship(spark, sf_dir).collect()),
        "feature_dose_correlation": lambda: DS.feature_dose_correlation(
            cells.df, cells.features, by=["Drug"]).collect(),
        "yeo_johnson_fit_apply": lambda: run_noop(SC.power_transform(orgs)[0].df),
    }
    runs_of = {name: runs for name in queries}
    extra = getattr(C, "BENCH_EXTRA", {})
    for name, (fn, n_runs) in extra.items():
        queries[name] = (lambda f: (lambda: f(spark, sf_dir, cells, orgs)))(fn)
        runs_of[name] = min(runs, n_runs)

    results = {}
    for name, fn in queries.items():
        C._MEMO.clear()
        try:
            results[name] = round(timed(fn, runs_of[name]), 3)
        except Exception as exc:  # keep the line printable
            results[name] = None
            print(f"# {name} failed: {type(exc).__name__}: {str(exc)[:200]}", file=sys.stderr)
    total = round(sum(v for v in results.values() if v is not None), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec",
                      "queries": results, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
