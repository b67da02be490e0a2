"""Command-line jobs over real exports: E1 (curate) and E3 (dose response).

    python -m morphospark.plans.jobs --objects Secondary.csv --images Image.csv \\
        --drop-list bad_cols.json --out /shared/run1

Writes Parquet tables ``cells``, ``organoids`` (S3), ``euclid`` (S4), ``ec50``
and ``metrics`` (S7) under --out.  --features scaled, weighted or selected
prepares the objects first (isolation forest, power transform, feature source),
as the reference does; raw goes from the raw medians.  Checkpoints/staging use the session's
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from morphospark.plans.curate import curate_with_medians
from morphospark.plans.dose_response import distance_table, dose_response, profiles, scaled_objects
from morphospark.session import ensure_checkpoint_dir, workers_find_package
from morphospark.sources.droplist import load_drop_list
from morphospark.sources.metrics import Observed
from morphospark.sources.readers import read_table
from morphospark.sources.writers import write_table


def run(spark: SparkSession, objects: str, images: str | None, drop_list: str | None, out: str,
        min_group_count: int | None = None, with_pvalue: bool = True, features: str = "raw", seed: int = 0) -> dict:
    ensure_checkpoint_dir(spark)
    workers_find_package(spark)
    objs = read_table(spark, objects)
    imgs = read_table(spark, images) if images else None
    drops = load_drop_list(drop_list) if drop_list else []
    cells, medians = curate_with_medians(objs, imgs, drop_list=drops,
                                         image_keys=objs.select("ImageNumber"))
    observed = Observed()
    write_table(observed.rows("cells", cells), f"{out}/cells")
    write_table(observed.rows("organoids", medians), f"{out}/organoids")
    if features != "raw":
        written = cells.with_df(spark.read.parquet(f"{out}/cells"))
        _, medians = profiles(scaled_objects(written, seed=seed), features, seed=seed)
    write_table(distance_table(medians, min_group_count), f"{out}/euclid")
    write_table(dose_response(medians, with_pvalue=with_pvalue, min_group_count=min_group_count), f"{out}/ec50")
    write_table(observed.table(spark, distance_features=len(medians.features)), f"{out}/metrics")
    return {"features": list(cells.features), "out": out}


def main(argv=None):
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--objects", required=True)
    ap.add_argument("--images")
    ap.add_argument("--drop-list")
    ap.add_argument("--out", required=True)
    ap.add_argument("--min-group-count", type=int)
    ap.add_argument("--features", choices=["raw", "scaled", "weighted", "selected"], default="raw")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("morphospark-jobs").getOrCreate()
    print(run(spark, args.objects, args.images, args.drop_list, args.out, args.min_group_count,
              features=args.features))


if __name__ == "__main__":
    main()
