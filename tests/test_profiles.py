"""Row-local correlations with a reference profile; similarity of every cell line."""

import numpy as np
from pyspark.sql import functions as F

from morphospark.featureset import FeatureSet
from morphospark.operators import similarity
from morphospark.operators.distance import correlation_to_reference

WIDE = [f"f{k}" for k in range(64)]


def test_row_correlation_skips_nulls_and_shuffles_no_rows(spark):
    rng = np.random.default_rng(0)
    x, ref = rng.normal(size=(40, 64)), {"a": rng.normal(size=64), "b": rng.normal(size=64)}
    x[3, :10] = np.nan
    x[5, :] = 2.0
    rows = [(i, "abc"[i % 3], *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    kinds = ", ".join(f"{c} double" for c in WIDE)
    fs = FeatureSet(spark.createDataFrame(rows, f"id long, Cell string, {kinds}"), ("id", "Cell"), tuple(WIDE))
    profile = spark.createDataFrame([(k, *map(float, v)) for k, v in ref.items()], f"Cell string, {kinds}")
    out = correlation_to_reference(fs, profile, ["Cell"])
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        ok = ~np.isnan(x[r.id])
        if r.Cell == "c" or r.id == 5:
            assert r.correlation is None  # no profile, or a constant row
        else:
            assert abs(r.correlation - np.corrcoef(x[r.id][ok], ref[r.Cell][ok])[0, 1]) < 1e-12


def test_similarity_of_every_line(spark):
    rng = np.random.default_rng(1)
    shift = {"Control": 0, "x": 0.2, "y": 4}
    rows = [(i, d, c, float(rng.normal(shift[d])), float(rng.normal()))
            for i, (d, c) in enumerate((d, c) for _ in range(60) for d in shift for c in ("L1", "L2"))]
    fs = FeatureSet(spark.createDataFrame(rows, "id long, Drug string, Cell string, u double, v double"),
                    ("id", "Drug", "Cell"), ("u", "v"))
    got = similarity.similarity_of_lines(fs, similarity.pairwise_similarity, similarity.similarity_summary,
                                         num_trees=10, max_depth=4)
    by = {(r.Cell, r.Drug, r["Predicted Drug"]): r.Similarity for r in got.collect()}
    assert {k[0] for k in by} == {"L1", "L2"}
    for line in ("L1", "L2"):  # x looks more like y's Control than y itself looks like x
        assert by[line, "x", "y"] < 0.3 and by[line, "x", "y"] == by[line, "y", "x"]
