"""DuckDB SQL of the numbered queries that SQL can express."""

from __future__ import annotations

from . import quality

_END = ", ".join("'" + x.replace("'", "''") + "'" for x in quality.TERMINAL)
#: RE2 has neither possessive quantifiers nor lone (?i) groups inside; the patterns are otherwise those of the rules.
_NAV = quality.NAVIGATION.replace("*+", "*")

OP1 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             string_split(t, chr(10)) AS lines FROM d),
win AS (SELECT doc_id, i, words[i:i + 4] AS g
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n
        FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, line, right(rtrim(regexp_replace(line, '[\x09-\x0D]', ' ', 'g'), ' '), 1) AS e
       FROM (SELECT doc_id, unnest(lines) AS line FROM w)),
jd AS (SELECT doc_id, line, CASE WHEN e = '' THEN ''
         WHEN regexp_matches(line, $q${quality.BOILERPLATE}$q$) THEN 'boilerplate'
         WHEN regexp_matches(line, $q${_NAV}$q$) OR regexp_matches(line, $q${quality.MENU}$q$) THEN 'navigation'
         WHEN e NOT IN ({_END}) OR regexp_matches(line, $q${quality.NOISE}$q$) THEN 'punctuation'
         ELSE '' END AS rule FROM ln),
lc AS (SELECT doc_id, count(*) FILTER (rule = 'punctuation') AS p, count(*) FILTER (rule = 'navigation') AS n,
              count(*) FILTER (rule = 'boilerplate') AS b,
              coalesce(sum(length(line)) FILTER (rule <> ''), 0) AS lost FROM jd GROUP BY doc_id),
s AS (SELECT w.doc_id, len(words) AS n_words,
             coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
               - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
             coalesce(cov.n, 0) AS n_repeat_words, length(t) AS n_chars,
             coalesce(lc.p, 0) AS p, coalesce(lc.n, 0) AS nav, coalesce(lc.b, 0) AS b,
             coalesce(lc.lost, 0)::BIGINT AS lost_chars
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN lc USING (doc_id)),
f AS (SELECT *, n_words < {quality.MIN_WORDS}
                OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost_chars <= {quality.MAX_LOST}::DOUBLE * n_chars AS kept, p AS n_punctuation_lines,
       nav AS n_navigation_lines, b AS n_boilerplate_lines, lost_chars
FROM f
"""

_NUMBER = "('0x' || substr(md5({}), 1, 8))::BIGINT"
OP5 = rf"""
WITH p AS (SELECT page_id, url,
                  rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.') AS host,
                  list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'),
                              lambda x: x <> '') AS parts,
                  DATE '2024-01-01' + ({_NUMBER.format("'day' || page_id::VARCHAR")} % 365)::INT AS fetch_day
           FROM pages),
pat AS (SELECT DISTINCT host AS pattern, 4 AS every FROM p WHERE host <> ''
        UNION SELECT DISTINCT host || '/' || parts[1], 6 FROM p WHERE host <> '' AND len(parts) > 0),
ch AS (SELECT pattern, ({_NUMBER.format("'add' || pattern")} % 200)::INT AS a,
              ({_NUMBER.format("'off' || pattern")} % 60)::INT AS b,
              ({_NUMBER.format("'again' || pattern")} % 100)::INT AS c
       FROM pat WHERE {_NUMBER.format("'pick' || pattern")} % every = 0),
iv AS (SELECT pattern, DATE '2024-01-01' + a AS f, DATE '2024-01-01' + (a + 20 + b) AS t FROM ch
       UNION ALL SELECT pattern, DATE '2024-01-01' + (a + 40 + b + c), DATE '9999-12-31' FROM ch),
hit AS (SELECT page_id, url, fetch_day, pattern, f FROM p JOIN iv ON fetch_day >= f AND fetch_day < t
          AND (host = pattern OR ends_with(host, '.' || pattern)
               OR starts_with(host || '/' || array_to_string(parts, '/') || '/', pattern || '/') AND pattern LIKE '%/%'))
SELECT p.page_id, p.url, p.fetch_day, count(pattern) > 0 AS blocked, count(pattern) AS n_matches,
       first(pattern ORDER BY length(pattern) DESC, pattern) AS pattern,
       first(f ORDER BY length(pattern) DESC, pattern) AS listed_since
FROM p LEFT JOIN hit USING (page_id, url, fetch_day) GROUP BY ALL
"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text; the row has ``steps``, the table of the 256 one-byte steps, from ``crc``."""
    return (f"xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode({text})) + 1), lambda i: "
            f"('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)), lambda a, b: "
            "xor(a >> 8, steps[1 + (xor(a, b) & 255)])), 4294967295)")


_CRC = """crc AS (SELECT list(v ORDER BY i) AS steps FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1))) AS v
  FROM (SELECT unnest(range(0, 256)) AS i)))"""

#: Levels that the SQL of the manifest spells out: 16 ** 5 leaves a source, and as many sources.
_LEVELS = 5


def _tree_sql(name: str) -> str:
    """Levels of the trees over ``{name}0`` (tree, k, d, n), and ``{name}s``: of each leaf the proof text and the steps."""
    out = []
    for i in range(_LEVELS):
        out.append(f"""{name}p{i} AS (SELECT a.tree, a.k, any_value(a.n) > 1 AS up,
  coalesce(string_agg(b.d, '' ORDER BY b.k) FILTER (b.k < a.k), '') AS pre,
  coalesce(string_agg(b.d, '' ORDER BY b.k) FILTER (b.k > a.k), '') AS post
  FROM {name}{i} a JOIN {name}{i} b ON a.tree = b.tree AND a.k // 16 = b.k // 16 GROUP BY a.tree, a.k)""")
        out.append(f"""{name}{i + 1} AS (SELECT tree, k // 16 AS k, (any_value(n) + 15) // 16 AS n,
  CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY k)) END AS d
  FROM {name}{i} GROUP BY tree, k // 16)""")
    joins = " ".join(f"JOIN {name}p{i} ON {name}p{i}.tree = l.tree AND {name}p{i}.k = l.k // {16 ** i}" for i in range(_LEVELS))
    steps = ", ".join(f"{{'up': {name}p{i}.up, 'pre': {name}p{i}.pre, 'post': {name}p{i}.post}}" for i in range(_LEVELS))
    out.append(f"""{name}s AS (SELECT l.tree, l.k, r.d AS top, list_filter([{steps}], lambda x: x.up) AS steps
  FROM {name}0 l {joins} JOIN {name}{_LEVELS} r ON r.tree = l.tree)""")
    return ",\n".join(out)


def _field(x: str) -> str:
    return f"coalesce(octet_length(encode({x}::VARCHAR))::VARCHAR || ':' || {x}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_FOLD = """list_reduce(list_prepend({{'up': true, 'pre': '', 'post': {node}}}, {steps}),
  lambda a, s: {{'up': true, 'pre': '', 'post': sha256(s.pre || a.post || s.post)}}).post"""

OP11 = f"""WITH {_CRC},
d AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, {_leaf('text')} AS leaf,
  CASE WHEN {_crc32('doc_id::VARCHAR')} % 5 = 0
       THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS bad FROM documents, crc),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM d),
s0 AS (SELECT tree, k, leaf AS d, count(*) OVER (PARTITION BY tree) AS n FROM p),
{_tree_sql('s')},
t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS k, d, count(*) OVER () AS n, tree AS source FROM s{_LEVELS}),
{_tree_sql('t')},
j AS (SELECT p.doc_id, p.leaf, p.bad, ss.top AS subroot, ts.top AS root, list_concat(ss.steps, ts.steps) AS steps
  FROM p JOIN ss ON ss.tree = p.tree AND ss.k = p.k JOIN t0 ON t0.source = p.tree JOIN ts ON ts.k = t0.k),
f AS (SELECT *, {_FOLD.format(node='coalesce(bad, leaf)', steps='steps')} AS folded_root FROM j)
SELECT doc_id, leaf, subroot, root,
  sha256(coalesce(array_to_string(list_transform(steps, lambda x: x.pre || x.post), ''), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM f"""

OP12 = rf"""WITH {_CRC},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM g, crc),
s AS (SELECT n, CASE WHEN h % 199 <> 0 THEN run
              ELSE substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) END AS word FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM s GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less
      FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT a.word AS a, b.word AS b FROM v a JOIN v b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION SELECT v.word, w.word FROM v JOIN w ON v.less = w.word
      UNION SELECT w.word, v.word FROM v JOIN w ON v.less = w.word),
x AS (SELECT a, count(*) AS n_near, first(b ORDER BY w.n DESC, b) AS best, max(w.n) AS best_n FROM e JOIN w ON w.word = b GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form,
             CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM w LEFT JOIN x ON x.a = w.word),
c AS (WITH RECURSIVE c(word, root) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root
        WHERE f.form IS NOT NULL) SELECT c.word, c.root FROM c JOIN f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, form, c.root, n, n_near, form_n FROM f JOIN c ON c.word = f.word"""

ORACLE = {"op1_quality_rules": OP1, "op5_url_filter": OP5, "op11_merkle_manifest": OP11, "op12_spelling_variants": OP12}
