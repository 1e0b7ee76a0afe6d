"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from . import secrets, urls
from .queries import SHARDS, URL_RULES

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# -- op3: rules, and the ratio of two character models ---------------------------------


def _rule_case(column: str) -> str:
    ordered = sorted(URL_RULES, key=lambda r: -len(r.name))
    value = (lambda r: r.name) if column == "rule" else (lambda r: r.verdict)
    arms = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value(r)}'" for r in ordered)
    return f"CASE {arms} END"


def _log_p(side: str) -> str:
    """Nested interpolation from the uniform distribution to the full window."""
    n = urls.ORDER + 1
    p = "(1.0::DOUBLE / 33)"
    for k in range(1, n + 1):
        mine = f"sum({side}) OVER (PARTITION BY substr(gram, {n - k + 1}, {k}))"
        context = f"sum({side}) OVER ()" if k == 1 else f"sum({side}) OVER (PARTITION BY substr(gram, {n - k + 1}, {k - 1}))"
        p = f"(({mine} + {urls.BACKOFF} * {p}) / ({context} + {urls.BACKOFF}))"
    return f"ln({p})"


OP3 = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path FROM u),
r AS (SELECT *, {_rule_case("rule")} AS rule, {_rule_case("verdict")} AS ruled FROM h),
s AS (SELECT *, repeat('^', {urls.ORDER}) || regexp_replace(regexp_replace(translate(host || path, '{_UP}', '{_LOW}'), '[0-9]', '0', 'g'), '[^a-z0./_-]', '*', 'g') || '$' AS sym, row_number() OVER () AS k FROM r),
f AS (SELECT *, CAST('0x' || substr(md5(sym), 1, 8) AS BIGINT) % {urls.CALIBRATION_FOLD} = 0 AS fold FROM s),
g AS (SELECT k, substr(sym, i, {urls.ORDER + 1}) gram, (NOT fold AND ruled = 'allow')::INT good, (NOT fold AND ruled = 'block')::INT bad FROM f, unnest(range(1, length(sym) - {urls.ORDER} + 1)) t(i)),
c AS (SELECT gram, coalesce(sum(good), 0)::DOUBLE good, coalesce(sum(bad), 0)::DOUBLE bad FROM g GROUP BY gram),
m AS (SELECT gram, {_log_p("good")} - {_log_p("bad")} ratio FROM c),
a AS (SELECT k, avg(ratio) mean_ratio FROM g JOIN m USING (gram) GROUP BY k),
j AS (SELECT f.*, a.mean_ratio FROM f JOIN a USING (k)),
b AS (SELECT greatest({-urls.BINS}, least({urls.BINS}, floor(mean_ratio / {urls.BIN}))) bin, ruled FROM j WHERE fold AND ruled IS NOT NULL),
n AS (SELECT count(*) FILTER (ruled = 'allow') good, count(*) FILTER (ruled = 'block') bad FROM b),
w AS (SELECT t.bin, (SELECT count(*) FROM b WHERE b.bin < t.bin AND ruled = 'block') / n.bad::DOUBLE - (SELECT count(*) FROM b WHERE b.bin < t.bin AND ruled = 'allow') / n.good::DOUBLE gain FROM range({-urls.BINS}, {urls.BINS + 2}) t(bin), n),
o AS (SELECT list(bin ORDER BY bin) bins FROM w WHERE gain = (SELECT max(gain) FROM w)),
z AS (SELECT CASE WHEN n.good = 0 OR n.bad = 0 THEN 0.0 ELSE bins[len(bins) // 2 + 1] * {urls.BIN}::DOUBLE END threshold FROM o, n)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN mean_ratio >= threshold THEN 'allow' ELSE 'block' END) AS verdict, round(mean_ratio, 6) AS mean_ratio FROM j, z
"""

# -- op5: with equal weights, the shard with the largest draw ---------------------------

_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"

OP5 = f"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) tab FROM range(256) t(i)),
d AS (SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size, hex(encode(coalesce(text, ''))) hx FROM documents),
e AS (SELECT doc_id, size, list_transform(range(length(hx) // 2), lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT)) bytes FROM d),
c AS (SELECT doc_id, size, {_CRC} AS text_crc32 FROM e, tab),
w AS (SELECT doc_id, s, CAST('0x' || substr(md5(doc_id || ':' || s), 1, 12) AS BIGINT) v FROM (SELECT DISTINCT doc_id FROM documents), range({SHARDS + 1}) t(s)),
b AS (SELECT doc_id, arg_max(s, v) FILTER (s < {SHARDS}) shard, arg_max(s, v) grown FROM w GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, CAST(grown AS INT) AS grown_shard FROM c JOIN b USING (doc_id)
"""

# -- op8: matches and the pieces between them give the places ----------------------------


def _kind_sql(kind: str, pattern: str, group: int = 0, least: int = 0, has: tuple[str, ...] = ()) -> str:
    keep = " AND ".join([f"length(g) >= {least}", *[f"regexp_matches(g, {_quoted(h)})" for h in has]])
    return f"""
SELECT doc_id, '{kind}' kind, {secrets.KINDS.index(kind)} rank, a AS "start", a + length(m) AS "end" FROM (
  SELECT doc_id, m, g, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) a
  FROM (SELECT doc_id, unnest(ms) m, unnest(gs) g, unnest(ps[1:len(ms)]) p, generate_subscripts(ms, 1) i FROM (
    SELECT doc_id, regexp_extract_all(t, {_quoted(pattern)}) ms, regexp_extract_all(t, {_quoted(pattern)}, {group}) gs, regexp_split_to_array(t, {_quoted(pattern)}) ps FROM d WHERE regexp_matches(t, {_quoted(pattern)})))
) WHERE {keep}"""


_NEAR = f'(b."start" <= a."end" + {secrets.SCOPE} AND a."start" <= b."end" + {secrets.SCOPE})'

OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
base AS ({_kind_sql("assign", secrets.ASSIGN, 2, secrets.ASSIGN_LEAST)} UNION ALL {_kind_sql("access", secrets.ACCESS, 0, secrets.ACCESS_LEAST)} UNION ALL {_kind_sql("hex", secrets.HEX)}),
parts AS ({_kind_sql("ident", secrets.IDENT)} UNION ALL {_kind_sql("endpoint", secrets.ENDPOINT)}),
runs AS ({_kind_sql("opaque", secrets.OPAQUE, has=secrets.OPAQUE_HAS)}),
opaque AS (SELECT * FROM runs a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND a."start" < b."end" AND b."start" < a."end")),
named AS (SELECT * FROM parts UNION ALL SELECT * FROM base WHERE kind = 'access'),
hidden AS (SELECT * FROM base WHERE kind IN ('assign', 'hex') UNION ALL SELECT * FROM opaque),
linked AS (SELECT * FROM opaque a WHERE EXISTS (SELECT 1 FROM named b WHERE b.doc_id = a.doc_id AND {_NEAR}) UNION ALL SELECT * FROM parts a WHERE EXISTS (SELECT 1 FROM hidden b WHERE b.doc_id = a.doc_id AND {_NEAR})),
found AS (SELECT *, kind || ':' || "start" || ':' || "end" s, rank < 3 is_base FROM (SELECT * FROM base UNION ALL SELECT * FROM linked)),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') n_assign, count(*) FILTER (kind = 'access') n_access, count(*) FILTER (kind = 'hex') n_hex, string_agg(s, ',' ORDER BY "start", rank) FILTER (is_base) b, string_agg(s, ',' ORDER BY "start", rank) spans FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

# -- op9: all pairs that share a shingle, exact similarities, reachability ----------------

OP9 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(len(ws) - 3), lambda i: array_to_string(ws[i + 1:i + 4], ' ')) END) sh FROM w),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reached) c FROM r GROUP BY doc_id) m USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op3_url_filters": OP3,
    "op5_sharding": OP5,
    "op8_secret_scans": OP8,
    "op9_minhash_near_dedup": OP9,
}
