"""DuckDB reference SQL of the queries in this subpackage."""

from sonorisk.llm.common import LOWER, UPPER
from sonorisk.llm.host_quality import BASE_FAILED, RULES
from sonorisk.llm.secrets import ACCESS, ASSIGN, HEX, OPAQUE
from sonorisk.llm.url_filter import LONG_SUFFIXES, Rule

# The list rules of the url query.
URL_RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))

_LONG = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)


def _level(src: str, name: str) -> str:
    return f"""{name}_m AS (SELECT count(*) AS k, sum(n)::DOUBLE AS nn, sum(bad)::DOUBLE AS bb, sum(n * n)::DOUBLE AS n2, sum(bad::DOUBLE * bad / n) AS b2n FROM {src} WHERE n > 0),
{name}_v AS (SELECT *, bb / nn AS p, (b2n - nn * (bb / nn) * (bb / nn)) / nullif(k - 1, 0) AS msb, (bb - b2n) / nullif(nn - k, 0) AS msw, (nn - n2 / nn) / greatest(1, k - 1) AS n0 FROM {name}_m),
{name}_r AS (SELECT *, CASE WHEN msb + (n0 - 1) * msw > 0 THEN (msb - msw) / (msb + (n0 - 1) * msw) ELSE 1.0 END AS rho FROM {name}_v),
{name}_s AS (SELECT CASE WHEN k = 0 THEN 0.5 ELSE p END AS p, CASE WHEN k < 2 OR nn <= k OR n0 <= 0 OR rho <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, (1 - rho) / rho)) END AS kk FROM {name}_r)"""


_RULE_ROWS = ", ".join(f"({k}, '{r.verdict}', '{r.pattern}', '{r.host}', '{r.path}')" for k, r in enumerate(URL_RULES))
URLS = f"""WITH rules AS (SELECT * FROM (VALUES {_RULE_ROWS}) t(no, verdict, pattern, rhost, rpath)),
u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
known AS (SELECT doc_id AS pid, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY 1),
h0 AS (SELECT host, count(k.bad)::BIGINT AS n, coalesce(sum(k.bad), 0)::BIGINT AS bad, string_split(host, '.') AS parts FROM u LEFT JOIN known k ON u.page_id = k.pid GROUP BY host),
h1 AS (SELECT *, array_to_string(parts[-2:], '.') AS two, array_to_string(parts[-3:], '.') AS three, parts[-1] AS one FROM h0),
h AS (SELECT host, n, bad, CASE WHEN two IN ({_LONG}) THEN three ELSE two END AS domain, CASE WHEN two IN ({_LONG}) THEN two ELSE one END AS suffix FROM h1),
d AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM d GROUP BY ALL),
{_level("s", "ls")}, {_level("d", "ld")}, {_level("h", "lh")},
ms AS (SELECT suffix, (bad + kk * p) / (n + kk) AS m FROM s, ls_s),
md AS (SELECT domain, (bad + kk * m) / (n + kk) AS m FROM d JOIN ms USING (suffix), ld_s),
mh AS (SELECT host, n, bad, (bad + kk * m) / (n + kk) AS m, n + kk AS total FROM h JOIN md USING (domain), lh_s),
best AS (SELECT host, path, arg_max(no, (length(pattern), -no)) AS no FROM (SELECT DISTINCT host, path FROM u) x JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT page_id, u.host, u.path, r.pattern AS rule, coalesce(r.verdict, CASE WHEN m - 1.645 * sqrt(m * (1 - m) / (total + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, mh.n AS n_labelled, mh.bad AS n_bad
FROM u LEFT JOIN best b ON u.host = b.host AND u.path = b.path LEFT JOIN rules r ON b.no = r.no LEFT JOIN mh ON u.host = mh.host"""

_CRC = """crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END)) AS tab)"""
SHARDS = f"""WITH {_CRC},
d AS (SELECT doc_id, coalesce('s' || source, 'null') AS stratum, source, strlen(coalesce(text, ''))::BIGINT + 1 AS size, md5('shards:' || coalesce(doc_id::VARCHAR, 'null')) AS h,
  xor(4294967295, list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::BIGINT)), lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8))) AS text_crc32
  FROM documents, crc_table),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id NULLS FIRST, text_crc32, size) AS rnk, count(*) OVER (PARTITION BY stratum) AS ns FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * rnk - 1)::DOUBLE / (2 * ns)::DOUBLE, stratum, h, doc_id NULLS FIRST, text_crc32, size) - 1 AS pos, count(*) OVER () AS total FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 8 // total)::INT AS shard, (pos - ((pos * 8 // total) * total + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard, source FROM p"""


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _matches(k: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = _lit(pattern)
    return f"""SELECT rid, doc_id, source, {k} AS k, '{kind}' AS kind, len(gaps[i]) + before AS s, len(gaps[i]) + before + len(hits[i]) AS e, md5(vals[i]) AS h, vals[i] AS v FROM (
  SELECT *, (SELECT coalesce(sum(len(x)), 0) FROM unnest(list_concat(gaps[1:i - 1], hits[1:i - 1])) t(x)) AS before FROM (
    SELECT rid, doc_id, source, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT rid, doc_id, source, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS hits, regexp_extract_all(t, {p}, {group}) AS vals FROM docs WHERE regexp_matches(t, {p})))) WHERE len(vals[i]) >= {least}"""


SECRETS = f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
base AS ({_matches(0, "assign", ASSIGN, 2, 8)} UNION ALL {_matches(1, "access", ACCESS, 0, 16)} UNION ALL {_matches(2, "hex", HEX, 0, 32)}),
opq AS (SELECT * FROM ({_matches(3, "opaque", OPAQUE, 0, 20)}) o WHERE regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = o.rid AND b.s < o.e AND o.s < b.e)),
cand AS (SELECT * FROM base UNION ALL SELECT * FROM opq),
own AS (SELECT h, count(DISTINCT coalesce('s' || source, '')) AS n_owners FROM cand GROUP BY h),
j AS (SELECT c.*, n_owners < 3 AS live FROM cand c JOIN own USING (h)),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 3 OR live) AS spans,
  count(*) FILTER (k < 3 AND live) AS n_live, count(*) FILTER (k < 3 AND NOT live) AS n_example FROM j GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example FROM docs LEFT JOIN g USING (rid)"""

_FAILS = ", ".join(f"count(*) FILTER ({c})::BIGINT AS {r}" for r, (c, _) in RULES.items())
_HOSTS = ",\n".join(f"hb_{r} AS (SELECT n, {r} AS bad FROM hosts),\n{_level(f'hb_{r}', f'l_{r}')}" for r in RULES)
_REJECT = " OR ".join(f"({r} + (SELECT kk * p FROM l_{r}_s)) / (n + (SELECT kk FROM l_{r}_s)) > {limit}" for r, (_, limit) in RULES.items())
QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('h' || source, 'none') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT rid, sum(c - 1)::BIGINT AS n_dup_lines FROM (SELECT rid, line, count(*) AS c FROM ln WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL) GROUP BY rid),
f AS (SELECT doc_id, host, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid)),
hosts AS (SELECT host, count(*)::BIGINT AS n, {_FAILS} FROM f GROUP BY host),
{_HOSTS},
v AS (SELECT host, {_REJECT} AS rejected FROM hosts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_FAILED} AS base_failed, NOT {BASE_FAILED} AND NOT rejected AS kept FROM f JOIN v USING (host)"""

_W = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_W}') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_W}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS l, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT rid, l, i, array_to_string(w[i:i + l - 1], ' ') AS g FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l)),
hit AS (SELECT rid, i, dw.l AS l, item FROM dw JOIN bw USING (l, g)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)"""

REPEATS = """WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
own AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
pos AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 50)) AS p FROM win JOIN own USING (g) WHERE doc_id > first)),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS t FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN pos USING (rid, p) GROUP BY rid),
gone AS (SELECT rid, count(*) AS n FROM pos GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid) LEFT JOIN gone USING (rid)"""

SPELLING = f"""WITH RECURSIVE {_CRC},
runs AS (SELECT id, run, count(*) AS n FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents) GROUP BY ALL),
sums AS (SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda b: ('0x' || b)::BIGINT)), lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8))) AS h FROM runs, crc_table),
v AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM sums) GROUP BY word HAVING sum(n) >= 5 AND length(word) >= 6),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pair AS (SELECT DISTINCT * FROM (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT a.word, a.n, b.word, b.n FROM cut a JOIN v b ON a.k = b.word UNION ALL SELECT b.word, b.n, a.word, a.n FROM cut a JOIN v b ON a.k = b.word)),
best AS (SELECT word, n, count(*) AS n_near, max(near_n) AS best_n, arg_min(near, (-near_n, near)) AS best FROM pair GROUP BY ALL),
form AS (SELECT word, best AS form, best_n FROM best WHERE best_n >= 5 * n),
walk AS (SELECT word, form AS root FROM form UNION ALL SELECT w.word, f.form FROM walk w JOIN form f ON w.root = f.word)
SELECT v.word, f.form, coalesce(r.root, v.word) AS root, v.n, coalesce(b.n_near, 0)::BIGINT AS n_near, f.best_n::BIGINT AS form_n
FROM v LEFT JOIN best b ON v.word = b.word LEFT JOIN form f ON v.word = f.word LEFT JOIN (SELECT * FROM walk WHERE root NOT IN (SELECT word FROM form)) r ON v.word = r.word"""

OVERLAP = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT rid, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
sz AS (SELECT rid, count(*)::BIGINT AS n FROM sh GROUP BY rid),
num AS (SELECT rid, dense_rank() OVER (ORDER BY g) AS g FROM sh),
hit AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM num a JOIN num b USING (g) WHERE a.rid < b.rid GROUP BY ALL),
link AS (SELECT a, b FROM hit JOIN sz x ON a = x.rid JOIN sz y ON b = y.rid WHERE 100 * k >= 90 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT a, a AS b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least AS (SELECT r.a AS rid, min(d.doc_id) AS component FROM reach r JOIN d ON r.b = d.rid GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id FROM d LEFT JOIN sz USING (rid) LEFT JOIN least USING (rid)"""
