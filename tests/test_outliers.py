import numpy as np

from morphospark.featureset import FeatureSet
from morphospark.operators.outliers import c_factor, fit_isolation_forest, isolation_inliers, score_isolation_forest


def test_c_factor():
    assert c_factor([0, 1, 2])[2] == 1.0 and c_factor([1])[0] == 0.0
    assert abs(c_factor([256])[0] - 10.2448) < 1e-3


def test_planted_outlier_scores_highest(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (500, 2)))]
    rows.append((500, 8.0, -8.0))
    df = spark.createDataFrame(rows, "id long, a double, b double").repartition(3)
    fs = FeatureSet(df, ("id",), ("a", "b"))
    model = fit_isolation_forest(fs, n_trees=50, seed=1)
    scored = score_isolation_forest(fs, model).toPandas()
    top = scored.sort_values("anomaly_score", ascending=False).iloc[0]
    assert int(top["id"]) == 500 and top["anomaly_score"] > 0.6
    again = score_isolation_forest(fs, fit_isolation_forest(fs, n_trees=50, seed=1)).toPandas()
    assert np.allclose(scored.sort_values("id")["anomaly_score"], again.sort_values("id")["anomaly_score"])
    kept = isolation_inliers(fs, n_trees=50, seed=1).df
    assert 500 not in {r.id for r in kept.select("id").collect()}
