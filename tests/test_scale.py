import numpy as np
import pytest

from morphospark.featureset import FeatureSet
from morphospark.functions.yeojohnson import yeo_johnson_np
from morphospark.operators.scale import apply_yeo_johnson, fit_yeo_johnson, robust_scale, standard_scale


def _dense_best(x):
    grid = np.linspace(-4, 6, 200001)
    s = np.sum(np.sign(x) * np.log1p(np.abs(x)))
    best, arg = -np.inf, None
    for lam in grid[::50]:
        v = yeo_johnson_np(x, lam).var()
        ll = -len(x) / 2 * np.log(v) + (lam - 1) * s
        if ll > best:
            best, arg = ll, lam
    fine = np.linspace(arg - 0.05, arg + 0.05, 2001)
    lls = [-len(x) / 2 * np.log(yeo_johnson_np(x, l).var()) + (l - 1) * s for l in fine]
    return fine[int(np.argmax(lls))]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 2000
    cols = {
        "lognormal": rng.lognormal(0, 0.7, n),
        "normal": rng.normal(0, 1, n),
        "mixed": rng.normal(0.5, 2, n),
        "const": np.full(n, 3.0),
    }
    rows = [(i, *[float(cols[c][i]) for c in cols]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, lognormal double, normal double, mixed double, const double")
    return FeatureSet(df.repartition(4), ("id",), tuple(cols)), cols


def test_lambda_matches_dense_search(data):
    fs, cols = data
    lam = fit_yeo_johnson(fs)
    assert lam["const"] is None
    for c in ("lognormal", "normal", "mixed"):
        assert abs(lam[c] - _dense_best(cols[c])) < 2e-3, c


def test_transform_standardized(data):
    fs, _ = data
    lam = fit_yeo_johnson(fs)
    out = apply_yeo_johnson(fs, lam).df.toPandas()
    for c in ("lognormal", "normal", "mixed"):
        assert abs(out[c].mean()) < 1e-9 and abs(out[c].std(ddof=0) - 1) < 1e-9
    assert (out["const"] == 0).all()


def test_closed_forms(spark):
    x = np.array([-2.0, -0.5, 0.0, 0.5, 3.0])
    assert np.allclose(yeo_johnson_np(x, 1.0), x)
    assert np.allclose(yeo_johnson_np(x[x >= 0], 0.0), np.log1p(x[x >= 0]))
    assert np.allclose(yeo_johnson_np(x[x < 0], 2.0), -np.log1p(-x[x < 0]))


def test_standard_and_robust(data):
    fs, cols = data
    out = standard_scale(fs).df.toPandas()
    assert abs(out["normal"].std(ddof=0) - 1) < 1e-9 and (out["const"] == 0).all()
    rb = robust_scale(fs).df.toPandas()
    x = cols["normal"]
    expect = (x - np.median(x)) / (np.percentile(x, 75) - np.percentile(x, 25))
    got = rb.sort_values("id")["normal"].to_numpy()
    assert np.allclose(got, expect)


# ---------------------------------------------------------------- values far from zero, large exponents
def _exact_loglik(x, lam):
    """Log-likelihood per value with 60 digits."""
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    a = [(1 + Decimal(float(v))).ln() for v in x]
    y = [(Decimal(lam) * v).exp() / Decimal(lam) for v in a]
    mean = sum(y) / len(y)
    var = sum((v - mean) ** 2 for v in y) / len(y)
    return float(-var.ln() / 2 + (Decimal(lam) - 1) * sum(a) / len(a))


@pytest.mark.parametrize("lam", [-300.0, -4.0, -0.001, 0.5, 6.0, 400.0])
def test_likelihood_keeps_its_digits(spark, lam):
    from morphospark.operators.scale import yeo_johnson_likelihood

    x = 1000 + np.random.default_rng(5).lognormal(0, 1, 300)
    fs = FeatureSet(spark.createDataFrame([(float(v),) for v in x], "x double").repartition(3), (), ("x",))
    got = yeo_johnson_likelihood(fs, [lam]).first()
    assert abs(got.loglik - _exact_loglik(x, lam)) < 1e-8


def test_offset_lognormal_has_an_interior_lambda(spark):
    rng = np.random.default_rng(6)
    x = 1000 + rng.lognormal(0, 0.5, 1500)
    rows = [(float(v), -float(v)) for v in x]
    fs = FeatureSet(spark.createDataFrame(rows, "x double, neg double").repartition(4), (), ("x", "neg"))
    lam = fit_yeo_johnson(fs)
    assert lam["x"] < -100  # far outside the first grid
    at = [_exact_loglik(x[:400], lam["x"] * f) for f in (0.8, 1.0, 1.25)]
    assert at[1] > at[0] and at[1] > at[2]
    assert abs((2 - lam["neg"]) - lam["x"]) < 1e-3 * abs(lam["x"])  # the mirrored feature has the mirrored lambda
    out = apply_yeo_johnson(fs, lam).df.toPandas()
    z = out["x"].to_numpy()
    assert abs(z.mean()) < 1e-9 and abs(z.std() - 1) < 1e-9 and abs((z ** 3).mean()) < 0.2
    assert np.allclose(np.sort(out["neg"]), np.sort(-z), atol=1e-6)


def test_scaled_psi_is_psi_but_for_factor_and_constant():
    from morphospark.functions.yeojohnson import scaled_psi_np

    rng = np.random.default_rng(7)
    for x in (rng.gamma(2, 3, 50), -rng.gamma(2, 3, 50), rng.normal(0, 4, 50)):
        for lam in (-1.5, 0.0, 1.0, 2.0, 3.5):
            y, t = scaled_psi_np(x, lam, x.min(), x.max())
            plain = yeo_johnson_np(x, lam)
            assert np.allclose((y - y.mean()) * np.exp(t), plain - plain.mean(), rtol=1e-9, atol=1e-9)


def test_huge_exponents_do_not_overflow(spark):
    x = np.concatenate([np.random.default_rng(8).normal(0, 1, 200), [1e6, -1e6]])
    fs = FeatureSet(spark.createDataFrame([(float(v),) for v in x], "x double"), (), ("x",))
    for lam in (-90.0, 95.0):
        out = apply_yeo_johnson(fs, {"x": lam}).df.toPandas()["x"]
        assert np.isfinite(out).all() and abs(out.std(ddof=0) - 1) < 1e-9
