"""DuckDB oracle SQL for model fits that have a closed answer: least squares by
elimination, principal components by repeated squaring, the likelihood peak of
the power transform by nested grids, and the tail of the t distribution by
quadrature.  Each restates the definition, not the method of the operator.
"""

from __future__ import annotations


def solve_ctes(src: str, feats, target: str, name: str = "ls") -> str:
    """``name(feature, weight)``: least squares of ``target`` on ``feats`` without intercept (normal equations)."""
    n = len(feats)
    cells = [(i, j) for i in range(n) for j in range(n + 1)]
    sums = ", ".join(f"sum({feats[i]} * {feats[j] if j < n else target}) AS a{i}_{j}" for i, j in cells)
    out = [f"{name}0 AS MATERIALIZED (SELECT {sums} FROM {src})"]
    for k in range(n):
        step = ", ".join((f"a{k}_{j} / a{k}_{k}" if i == k else f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k}")
                         + f" AS a{i}_{j}" for i, j in cells)
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT {step} FROM {name}{k})")
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, a{i}_{n} AS weight FROM {name}{n}" for i, c in enumerate(feats))
    return ",\n".join([*out, f"{name} AS ({rows})"])


def component_ctes(src: str, feats, name: str, squarings: int = 36) -> str:
    """``name1`` and ``name2``: one row each with the loadings v0.. of the first two principal components of ``src``.

    A normalised matrix squared again and again tends to the projector on its
    leading eigenvector; the second comes from the deflated matrix.  Signs: the
    largest absolute loading is positive.
    """
    n = len(feats)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]

    def m(i, j, t=""):
        return f"{t}m{min(i, j)}_{max(i, j)}"

    norm = " + ".join(f"{m(i, j)} * {m(i, j)}" for i in range(n) for j in range(n))
    square = ", ".join("(" + " + ".join(f"{m(i, k)} * {m(k, j)}" for k in range(n)) + f") / ({norm}) AS {m(i, j)}"
                       for i, j in pairs)
    top = "greatest(" + ", ".join(m(i, i) for i in range(n)) + ")"

    def leading(start, out):
        ctes = [f"{out}_{k + 1} AS MATERIALIZED (SELECT {square} FROM {start if k == 0 else f'{out}_{k}'})"
                for k in range(squarings)]
        loads = ", ".join("CASE " + " ".join(f"WHEN {m(p, p)} = {top} THEN {m(p, i)} / sqrt({m(p, p)})"
                                             for p in range(n)) + f" END AS v{i}" for i in range(n))
        return [*ctes, f"{out} AS MATERIALIZED (SELECT {loads} FROM {out}_{squarings})"]

    cov = ", ".join(f"covar_pop({feats[i]}, {feats[j]}) AS {m(i, j)}" for i, j in pairs)
    value = " + ".join(f"v{i} * {m(i, j)} * v{j}" for i in range(n) for j in range(n))
    rest = ", ".join(f"{m(i, j)} - ({value}) * v{i} * v{j} AS {m(i, j)}" for i, j in pairs)
    return ",\n".join([f"{name}_c AS MATERIALIZED (SELECT {cov} FROM {src})", *leading(f"{name}_c", f"{name}1"),
                       f"{name}_d AS MATERIALIZED (SELECT {rest} FROM {name}_c, {name}1)",
                       *leading(f"{name}_d", f"{name}2")])


def scores_sql(src: str, feats, name: str, keys: str, extra: str = "") -> str:
    """Scores of the rows of ``src`` on the components ``name1`` and ``name2``."""
    def dot(c):
        return " + ".join(f"({x} - avg({x}) OVER ()) * {c}.v{i}" for i, x in enumerate(feats))

    return (f"SELECT {keys}, round({dot('a')}, 6) AS PC1, round({dot('b')}, 6) AS PC2{extra} "
            f"FROM {src}, {name}1 a, {name}2 b")


def likelihood_peak_ctes(tall: str, low: float = -6.0, high: float = 10.0, step: float = 0.5, rounds: int = 4,
                         points: int = 40) -> str:
    """``peak(feature, lam)``: the exponent of the largest power-transform likelihood of each feature of ``tall``
    (feature, _v; all values positive), on a grid and then on ever finer grids around the best point."""
    out = [f"grid0 AS (SELECT feature, CAST(unnest(range(0, {round((high - low) / step) + 1})) * {step} + {low} AS DOUBLE) "
           f"AS lam FROM (SELECT DISTINCT feature FROM {tall}))"]
    for r in range(rounds + 1):
        y = "CASE WHEN lam = 0 THEN ln(_v + 1) ELSE pow(_v + 1, lam) / lam END"
        out.append(f"at{r} AS MATERIALIZED (SELECT feature, arg_max(lam, ll) AS lam FROM (SELECT feature, lam, "
                   f"-0.5 * ln(var_pop({y})) + (lam - 1) * avg(ln(_v + 1)) AS ll FROM {tall} JOIN grid{r} USING (feature) "
                   "GROUP BY feature, lam) GROUP BY feature)")
        if r < rounds:
            fine = 2 * step / points
            out.append(f"grid{r + 1} AS (SELECT feature, lam + unnest(range(0, {points + 1})) * {fine!r} - {step!r} AS lam "
                       f"FROM at{r})")
            step = fine
    return ",\n".join([*out, f"peak AS (SELECT * FROM at{rounds})"])


def t_tail_ctes(src: str, keys: str, points: int = 20000) -> str:
    """``tails(keys, pvalue)``: two-sided p of ``src(keys, n, R)``, by Simpson's rule over the angle whose
    tangent is t / sqrt(df); there the density is a power of the cosine on a bounded interval."""
    return f"""tt AS (SELECT {keys}, n - 2.0 AS df, abs(R) * sqrt((n - 2.0) / ((1 - R + 1e-20) * (1 + R + 1e-20))) AS t
  FROM {src} WHERE n > 2),
th AS (SELECT *, atan(t / sqrt(df)) AS lo, (pi() / 2 - atan(t / sqrt(df))) / {points} AS h FROM tt),
si AS (SELECT *, unnest(range(0, {points + 1})) AS i FROM th),
tails AS (SELECT {keys}, 2 * any_value(exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * h / 3)
  * sum(pow(greatest(cos(lo + i * h), 0.0), df - 1) * CASE WHEN i IN (0, {points}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
  AS pvalue FROM si GROUP BY {keys})"""
