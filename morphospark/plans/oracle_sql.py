"""DuckDB oracle SQL for the driver-table binding.

The common table expressions below restate, in plain SQL, what the Spark
operators compute on the binding of ``sources.driver_tables``; each query of
the catalog appends its own final SELECT.  Derived doubles are rounded to 6
places on both sides.
"""

from __future__ import annotations

from morphospark.functions.metadata import PATH_PATTERN

FEATURES = ("l_quantity", "l_extendedprice", "l_tax", "p_size", "p_retailprice", "o_totalprice")
ORG_KEYS_SQL = 'Date, Drug, Cell, Replicate, "Conc /uM", ImageNumber'

OBJECTS = """objects AS (
  SELECT l.l_orderkey AS ImageNumber,
         row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey,
             l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax,
             l.l_returnflag, l.l_linestatus, l.l_shipdate) AS ObjectNumber,
         '/data/' || strftime(o.o_orderdate, '%y%m%d') || '_plate_'
           || CASE o.o_orderstatus WHEN 'F' THEN 'ISO34' ELSE 'ISO49' END || '_'
           || CASE WHEN left(o.o_orderpriority, 1) IN ('1', '4') THEN 'Dabrafenib'
                   WHEN left(o.o_orderpriority, 1) IN ('2', '5') THEN '5FU' ELSE 'Vemurafenib' END || '_'
           || replace(printf('%.2f', o.o_custkey % 11 / 100.0), '.', '_') || 'uM/img'
           || CASE WHEN l.l_orderkey % 4 > 0 THEN '_Position_' || CAST(l.l_orderkey % 4 AS VARCHAR)
                   ELSE '' END || '.tif' AS Metadata_FileLocation,
         l.l_linenumber, l.l_partkey, l.l_quantity, l.l_extendedprice, l.l_tax,
         p.p_size, p.p_retailprice
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN part p ON l.l_partkey = p.p_partkey
)"""

_P = PATH_PATTERN.replace("'", "''")
META = f"""meta AS (
  SELECT *,
    nullif(regexp_extract(Metadata_FileLocation, '{_P}', 1), '') AS Date,
    nullif(regexp_extract(Metadata_FileLocation, '{_P}', 2), '') AS Cell,
    nullif(regexp_extract(Metadata_FileLocation, '{_P}', 3), '') AS _drug,
    nullif(regexp_extract(Metadata_FileLocation, '{_P}', 4), '') AS _conc,
    coalesce(nullif(regexp_extract(Metadata_FileLocation, '{_P}', 5), ''), '1') AS Replicate
  FROM objects
),
keyed AS (
  SELECT *, round_even(CAST(replace(replace(replace(_conc, '_', '.'), '-', '.'), 'uM', '')
                       AS DOUBLE) * 1000, 0) / 1000 AS "Conc /uM"
  FROM meta
),
annotated AS (
  SELECT * EXCLUDE (_drug, _conc),
         CASE WHEN "Conc /uM" = 0 THEN 'Control' ELSE _drug END AS Drug
  FROM keyed
),
filtered AS (
  SELECT * FROM annotated
  WHERE ImageNumber IS NOT NULL AND ObjectNumber IS NOT NULL AND Date IS NOT NULL
    AND Drug IS NOT NULL AND Cell IS NOT NULL AND Replicate IS NOT NULL
    AND "Conc /uM" IS NOT NULL AND NOT (Drug = '5FU' AND Cell = 'ISO34')
)"""

CELLS = """cells AS (
  SELECT f.ImageNumber, f.ObjectNumber, f.Date, f.Drug, f.Cell, f.Replicate, f."Conc /uM",
         CAST(f.l_quantity AS DOUBLE) AS l_quantity,
         CAST(f.l_extendedprice AS DOUBLE) AS l_extendedprice,
         CAST(f.l_tax AS DOUBLE) AS l_tax, CAST(f.p_size AS DOUBLE) AS p_size,
         CAST(f.p_retailprice AS DOUBLE) AS p_retailprice,
         CAST(o.o_totalprice AS DOUBLE) AS o_totalprice
  FROM filtered f LEFT JOIN orders o ON f.ImageNumber = o.o_orderkey
)"""

ORGANOIDS = "organoids AS (\n  SELECT " + ORG_KEYS_SQL + ",\n    " + ",\n    ".join(
    f"median({c}) AS {c}" for c in FEATURES) + "\n  FROM cells GROUP BY " + ORG_KEYS_SQL + "\n)"

DIST = "dist AS (\n  SELECT " + ORG_KEYS_SQL + ",\n    sqrt(" + " + ".join(
    f"{c}*{c}" for c in FEATURES) + ') AS "Euclidean distance"\n  FROM organoids\n)'


def line_ctes(src: str, keys: str, x: str, y: str) -> str:
    """Moments -> slope, intercept, R, stderr (linregress rules, Q19)."""
    return f"""moments AS (
  SELECT {keys}, count(*) AS n, avg({x}) AS mx, avg({y}) AS my,
         var_pop({x}) AS vx, var_pop({y}) AS vy, covar_pop({x}, {y}) AS cxy
  FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {keys}
),
line AS (
  SELECT {keys}, n, cxy / nullif(vx, 0) AS m, my - (cxy / nullif(vx, 0)) * mx AS c,
         CASE WHEN vx = 0 THEN NULL WHEN vy = 0 THEN 0.0::DOUBLE
              ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, cxy / sqrt(vx * vy))) END AS R,
         vx, vy
  FROM moments
),
fit AS (
  SELECT *, CASE WHEN vx = 0 THEN NULL WHEN n = 2 THEN 0.0::DOUBLE
                 WHEN n > 2 THEN sqrt((1.0 - R * R) * vy / vx / (n - 2)) END AS stderr
  FROM line
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def r6(expr: str, alias: str | None = None) -> str:
    alias = alias or expr
    return f'round({expr}, 6) AS "{alias}"' if not alias.isidentifier() else f"round({expr}, 6) AS {alias}"


ORG_CHAIN = (OBJECTS, META, CELLS, ORGANOIDS)

ORGANOID_PARENTS = """org AS (
  SELECT l_orderkey AS ImageNumber, CAST(l_linenumber AS BIGINT) AS ObjectNumber,
         sum(l_quantity) AS AreaShape_Area, avg(l_extendedprice) AS l_extendedprice,
         count(*) AS Children_Count
  FROM lineitem GROUP BY l_orderkey, l_linenumber
)"""

# the language rule used as a deterministic classifier over whole texts
LANG_RULE = """CASE WHEN contains(text, ' the ') THEN 'en' WHEN contains(text, ' der ') THEN 'de'
            WHEN contains(text, ' el ') THEN 'es' WHEN contains(text, ' le ') THEN 'fr'
            ELSE 'en' END"""
PREDICTIONS = f"""preds AS (
  SELECT doc_id, source, lang AS truth, {LANG_RULE} AS pred FROM documents
)"""

CLASS_COUNTS = """cls AS (
  SELECT coalesce(t.label, p.label) AS label, coalesce(t.support, 0) AS support,
         coalesce(t.tp, 0) AS tp, coalesce(p.predicted, 0) AS predicted
  FROM (SELECT truth AS label, count(*) AS support, sum(CASE WHEN truth = pred THEN 1 ELSE 0 END) AS tp
        FROM preds GROUP BY truth) t
  FULL JOIN (SELECT pred AS label, count(*) AS predicted FROM preds GROUP BY pred) p
  ON t.label = p.label
),
cls2 AS (SELECT *, sum(support) OVER () AS n_total FROM cls)"""


def tall(src: str, keys: str, feats=FEATURES, name: str = "Features", value: str = "_v") -> str:
    return (f"(UNPIVOT (SELECT {keys}, " + ", ".join(feats) + f" FROM {src}) ON "
            + ", ".join(feats) + f" INTO NAME {name} VALUE {value})")


def yj_sql(x: str, lam: float) -> str:
    eps = 2.220446049250313e-16
    pos = f"ln(1 + {x})" if abs(lam) < eps else f"((pow({x} + 1, {lam!r}) - 1) / {lam!r})"
    neg = (f"(-(pow(-{x} + 1, {2.0 - lam!r}) - 1) / {2.0 - lam!r})" if abs(lam - 2.0) > eps
           else f"(-ln(1 - {x}))")
    return f"CASE WHEN {x} >= 0 THEN {pos} ELSE {neg} END"


def zscore_sql(x: str) -> str:
    return (f"CASE WHEN stddev_pop({x}) OVER () = 0 THEN {x} - avg({x}) OVER () "
            f"ELSE ({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER () END")


ORG_HASH = ("md5(concat_ws('|', CAST(ImageNumber AS VARCHAR), Date, Drug, Cell, Replicate, "
            "printf('%.3f', \"Conc /uM\"), '0'))")

# per-document share of each language's keyword among all keyword hits
KEYWORDS = {"de": " der ", "en": " the ", "es": " el ", "fr": " le "}


def kw_count(word: str) -> str:
    return f"((length(text) - length(replace(text, '{word}', ''))) / {len(word)})"


SHARES = "shares0 AS (\n  SELECT doc_id, lang AS Drug, " + ", ".join(
    f"{kw_count(w)} AS c_{k}" for k, w in KEYWORDS.items()) + "\n  FROM documents\n),\n" + \
    "shares AS (SELECT *, " + " + ".join(f"c_{k}" for k in KEYWORDS) + " AS tot FROM shares0),\n" + \
    "sim AS (\n  SELECT doc_id, Drug, \"Predicted Drug\", CAST(c AS DOUBLE) / nullif(tot, 0) AS Similarity\n" + \
    "  FROM (UNPIVOT shares ON " + ", ".join(f"c_{k} AS '{k}'" for k in KEYWORDS) + \
    " INTO NAME \"Predicted Drug\" VALUE c)\n)"

SIM_POST = """pairs AS (
  SELECT "Predicted Drug", Drug, avg(Similarity) AS Similarity FROM sim
  WHERE Drug <> "Predicted Drug" GROUP BY "Predicted Drug", Drug
),
canon AS (
  SELECT *, least(Drug, "Predicted Drug") AS _a, greatest(Drug, "Predicted Drug") AS _b FROM pairs
),
mined AS (
  SELECT "Predicted Drug", Drug, min(Similarity) OVER (PARTITION BY _a, _b) AS Similarity FROM canon
)"""

EVENTS_X = "events_x AS (SELECT event_id, event_type, value, CAST(dayofmonth(ts) AS DOUBLE) AS day FROM events)"


def poisson_weight_sql(u: str, thresholds) -> str:
    return "(" + " + ".join(f"CASE WHEN {u} >= {t!r} THEN 1 ELSE 0 END" for t in thresholds) + ")"
