"""DuckDB SQL for the operators that SQL can express, from their definitions."""

from __future__ import annotations

from linkflow.llm.merkle import FANOUT
from linkflow.llm.mixing import SEED, SPLIT, TEMPERATURE
from linkflow.llm.search import B, EVERY, K1, TOP_K
from linkflow.llm.secrets import KINDS, SCOPE
from linkflow.llm.substrings import WINDOW
from linkflow.llm.urls import BLOCK_GLOBS, HOST_RULES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _hash52(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13) AS BIGINT)"


MIXING_SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source),
sums AS (SELECT sum(size) AS total, sum(pow(size, {TEMPERATURE})) AS weights FROM sizes),
rates AS (
  SELECT source, round(pow(size, {TEMPERATURE}) / weights * total / size, 9) AS rate FROM sizes, sums WHERE size > 0),
parts AS (SELECT source, rate, CAST(ceil(rate / {SPLIT}) AS INT) AS n FROM rates WHERE rate > 0),
steps AS (
  SELECT source, n, rate / n AS mean, 0 AS k, exp(-(rate / n)) AS p, exp(-(rate / n)) AS total FROM parts
  UNION ALL
  SELECT source, n, mean, k + 1, p * mean / (k + 1), total + p * mean / (k + 1) FROM steps
  WHERE k < ceil(mean + 12 * sqrt(mean) + 30)),
tables AS (SELECT source, n, list(total ORDER BY k) AS t FROM steps GROUP BY source, n),
keyed AS (
  SELECT doc_id, source, text, concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), 'null'), md5(coalesce(text, ''))) AS key FROM documents),
drawn AS (
  SELECT doc_id, d.source, text, key, list_sum(list_transform(range(0, n), lambda i: len(list_filter(t, lambda c: c <
    (({_hash52(f"'{SEED}'", "CAST(i AS VARCHAR)", "key")}) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)))) AS copies
  FROM keyed d JOIN tables r ON d.source IS NOT DISTINCT FROM r.source),
copied AS (SELECT doc_id, source, text, key, unnest(range(1, CAST(copies AS BIGINT) + 1)) AS c FROM drawn)
SELECT doc_id, source, CAST(c AS INT) AS mix_copy, {_hash52(f"'order {SEED}'", "CAST(c AS VARCHAR)", "key")} AS mix_key, text FROM copied
"""


def _kind_sql(rank: int) -> str:
    kind, expr, group, least = KINDS[rank]
    expr = _quoted(expr)
    ok = f"length(unnest(regexp_extract_all(t, {expr}, {group}))) >= {least}"
    if kind == "opaque":
        w = f"unnest(regexp_extract_all(t, {expr}))"
        ok = f"regexp_matches({w}, '[0-9]') AND regexp_matches({w}, '[A-Z]') AND regexp_matches({w}, '[a-z]')"
    return f"""SELECT id, {rank} AS rk, '{kind}' AS kind, unnest(range(0, len(regexp_extract_all(t, {expr})))) AS i,
  unnest(list_transform(string_split_regex(t, {expr})[:len(regexp_extract_all(t, {expr}))], lambda x: length(x))) AS b,
  unnest(list_transform(regexp_extract_all(t, {expr}), lambda x: length(x))) AS l, {ok} AS ok
  FROM d WHERE regexp_matches(t, {expr})"""


SECRETS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(_kind_sql(k) for k in range(len(KINDS)))}),
s AS (SELECT id, rk, kind, ok, l, CAST(sum(b + l) OVER (PARTITION BY id, rk ORDER BY i) AS BIGINT) AS e FROM m),
p AS (SELECT id, rk, kind, e - l AS s, e, rk < 3 AS base, rk IN (0, 2, 4) AS sec, rk IN (1, 3) AS ident FROM s WHERE ok),
near AS (SELECT *,
  coalesce(s - max(CASE WHEN ident THEN e END) OVER before <= {SCOPE}, false)
    OR coalesce(min(CASE WHEN ident THEN s END) OVER after - e <= {SCOPE}, false) AS has_id,
  coalesce(s - max(CASE WHEN sec THEN e END) OVER before <= {SCOPE}, false)
    OR coalesce(min(CASE WHEN sec THEN s END) OVER after - e <= {SCOPE}, false) AS has_sec,
  coalesce(max(CASE WHEN base THEN e END) OVER before > s, false)
    OR coalesce(min(CASE WHEN base THEN s END) OVER after < e, false) AS covered
  FROM p WINDOW before AS (PARTITION BY id ORDER BY s, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (PARTITION BY id ORDER BY s, rk ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
r AS (SELECT * FROM near WHERE base OR (NOT covered AND CASE rk WHEN 3 THEN has_sec WHEN 4 THEN has_id WHEN 5 THEN has_id AND has_sec END)),
g AS (SELECT id, count(*) FILTER (rk = 0) AS n0, count(*) FILTER (rk = 1) AS n1, count(*) FILTER (rk = 2) AS n2,
  string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, rk) FILTER (base) AS bs, string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, rk) AS sp
  FROM r GROUP BY id)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
  sha256(coalesce(bs, '')) AS base_sha256, coalesce(sp, '') AS spans
FROM d LEFT JOIN g USING (id)
"""


def _glob_sql(glob: str) -> str:
    """LIKE over '.' || host || chr(1) || path."""
    like = glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_").replace("\xff", "\x01")
    return f"canon LIKE {_quoted(like)} ESCAPE '\\'"


def _rule_sql(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"(ends_with('.' || host, '.{host}') AND starts_with(path, '/{path}'))"


_RULES = sorted(HOST_RULES, key=lambda r: (-len(r[0]), r[0]))
URLS_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
c AS (SELECT *, '.' || host || chr(1) || path AS canon FROM h)
SELECT page_id, host, path,
  CASE {' '.join(f"WHEN {_rule_sql(r)} THEN '{r}'" for r, _ in _RULES)} END AS rule,
  CASE {' '.join(f"WHEN {_rule_sql(r)} THEN '{v}'" for r, v in _RULES)}
    WHEN {' OR '.join(_glob_sql(g) for g in BLOCK_GLOBS)} THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS ws FROM documents),
n AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM d),
t AS (SELECT row, w, count(*) AS tf FROM (SELECT row, unnest(ws) AS w FROM d) GROUP BY row, w),
f AS (SELECT w, count(*) AS df FROM t GROUP BY w),
q AS (SELECT d.doc_id AS query_id, w, tf AS qtf FROM d JOIN t USING (row) WHERE d.doc_id % {EVERY} = 0),
s AS (
  SELECT query_id, t.row, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1}
    / (tf + {K1} * (1 - {B} + {B} * len(d.ws) / mean))), 6) AS score
  FROM q JOIN f USING (w) JOIN t USING (w) JOIN d USING (row), n GROUP BY query_id, t.row),
r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM s JOIN d USING (row))
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= {TOP_K}
"""

SUBSTRINGS_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d)),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS place FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS pos FROM o WHERE place > 1),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM d),
k AS (SELECT w.doc_id, string_agg(w, ' ' ORDER BY pos) AS kept FROM w ANTI JOIN gone ON w.doc_id = gone.doc_id AND w.pos = gone.pos GROUP BY w.doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_field_sql(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))})"


_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def _climb_sql(tree: str, levels: int) -> str:
    """CTEs {tree}n0.. (key, i, n, h: the nodes) and {tree}p0.. (row, key, i, n, cur, proof: each leaf's way up)."""
    out = []
    for k in range(levels):
        run = f"substr(s, 1, 64 * (i % {FANOUT}))", f"substr(s, 64 * (i % {FANOUT}) + 65)"
        out += [f"{tree}r{k} AS (SELECT key, i // {FANOUT} AS g, n, string_agg(h, '' ORDER BY i) AS s FROM {tree}n{k} WHERE n > 1 GROUP BY ALL)",
                f"""{tree}n{k + 1} AS (SELECT key, g AS i, (n + {FANOUT - 1}) // {FANOUT} AS n, sha256(s) AS h FROM {tree}r{k}
  UNION ALL SELECT key, i, n, h FROM {tree}n{k} WHERE n = 1)""",
                f"""{tree}p{k + 1} AS (SELECT row, p.key, CASE WHEN p.n > 1 THEN i // {FANOUT} ELSE i END AS i, (p.n + {FANOUT - 1}) // {FANOUT} AS n,
  CASE WHEN s IS NULL THEN cur ELSE sha256({run[0]} || cur || {run[1]}) END AS cur, proof || coalesce({run[0]} || {run[1]}, '') AS proof
  FROM {tree}p{k} p LEFT JOIN {tree}r{k} r ON p.key IS NOT DISTINCT FROM r.key AND i // {FANOUT} = g AND p.n > 1)"""]
    return ",\n".join(out)


LEVELS, TOP_LEVELS = 7, 4      # trees of up to 16 ** 7 leaves a source, 16 ** 4 sources
MERKLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, {_leaf_sql('text')} AS leaf,
    CASE WHEN ({_CRC_SQL}) % 5 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
         ELSE {_leaf_sql('text')} END AS other FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
an0 AS (SELECT source AS key, i, n, leaf AS h FROM placed),
ap0 AS (SELECT row, source AS key, i, n, other AS cur, '' AS proof FROM placed),
{_climb_sql('a', LEVELS)},
sub AS (SELECT key AS source, h AS subroot, row_number() OVER (ORDER BY key NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM an{LEVELS}),
bn0 AS (SELECT 0 AS key, i, n, subroot AS h FROM sub),
bp0 AS (SELECT row, 0 AS key, s.i, s.n, cur, proof FROM ap{LEVELS} p JOIN sub s ON p.key IS NOT DISTINCT FROM s.source),
{_climb_sql('b', TOP_LEVELS)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = h AS verified
FROM d JOIN sub s ON d.source IS NOT DISTINCT FROM s.source JOIN bp{TOP_LEVELS} p USING (row), bn{TOP_LEVELS}
"""
