"""SQL for the queries that SQL can express on whole tables, each written from the contract alone.

Only OP8 simulates what its operator does, slot by slot, as the order of the slots is the method's.

Not expressible: op2 (iterated robust estimates), op4 (keyed permutation), op6 (recounted discounts are, but the
score's crc32 split is not), op9 (a tokenizer), op12 (eigenvectors).  tests/llm compares those with plain Python.
"""

from __future__ import annotations

from cairn.llm.secrets import BEFORE, CLASSES, DECLARED, SEQUENCES, UUID, most_sum, terms
from cairn.llm.url_filter import RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = r"[^\x20\x09-\x0D]+"


def _low(column: str) -> str:
    return f"translate({column}, '{_UPPER}', '{_LOWER}')"


_RULES = ", ".join(f"('{v}', '{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for v, r in RULES)
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def _part(column: str, i: int) -> str:
    return f"coalesce(regexp_extract({column}, '{_URL}', {i}), '')"


#: Absolute canonical links and refreshes only; the tables have no others.
OP1 = rf"""
WITH RECURSIVE rules(verdict, rule, host, start) AS (VALUES {_RULES}),
p AS (SELECT page_id, url, html, {_low(_part('url', 1))} AS host, {_part('url', 2)} AS path, {_low(_part('url', 1))} || {_part('url', 2)} || {_part('url', 3)} AS node FROM pages),
tags AS (SELECT node, host, path, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM p WHERE node <> ''),
goals AS (SELECT node AS u, host AS uh, path AS up, CASE WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
  WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)url\s*=\s*["'']?([^"''>]*)', 1) ELSE '' END AS goal FROM tags),
links AS (SELECT u, uh, up, {_low(_part('goal', 1))} AS vh, {_part('goal', 2)} AS vp, {_low(_part('goal', 1))} || {_part('goal', 2)} || {_part('goal', 3)} AS v FROM goals WHERE goal LIKE '%://%'),
addresses AS (SELECT DISTINCT host, path FROM p UNION SELECT DISTINCT vh, vp FROM links),
best AS (SELECT a.host, a.path, r.rule, r.verdict FROM addresses a JOIN rules r ON (a.host = r.host OR ends_with(a.host, '.' || r.host)) AND starts_with(a.path, r.start)
  QUALIFY row_number() OVER (PARTITION BY a.host, a.path ORDER BY length(r.rule) DESC, r.rule DESC) = 1),
ways AS (SELECT u AS a, v AS b FROM links UNION SELECT v, u FROM links),
reach(node) AS (SELECT l.u FROM links l JOIN best b ON b.host = l.uh AND b.path = l.up AND b.verdict = 'block' UNION SELECT l.v FROM links l JOIN best b ON b.host = l.vh AND b.path = l.vp AND b.verdict = 'block'
  UNION SELECT w.b FROM reach r JOIN ways w ON w.a = r.node)
SELECT page_id, p.host, p.path, b.rule, coalesce(b.verdict, CASE WHEN r.node IS NULL THEN 'allow' ELSE 'block' END) AS verdict, r.node IS NOT NULL AS alias_blocked
FROM p LEFT JOIN best b ON b.host = p.host AND b.path = p.path LEFT JOIN (SELECT DISTINCT node FROM reach) r ON r.node = p.node
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACES}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT doc_id, i FROM win JOIN (SELECT s FROM win GROUP BY s HAVING count(*) > 1) USING (s)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM twice),
kept AS (SELECT doc_id, k, w[k] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d) ANTI JOIN gone USING (doc_id, k)),
texts AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM kept GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN texts USING (doc_id)
"""

OP5 = """
WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to, url AS target_uri FROM f
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP7 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_low("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, len(w[i:i + 9]) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
win AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, win.n, item_id FROM win JOIN items ON items.s = win.s AND items.n = win.n),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

#: Releases and deadlines from the exact weights, and earliest deadline first slot by slot.
OP8 = """
WITH RECURSIVE d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
sizes AS (SELECT source, count(*) AS n, pow(count(*), 0.9) AS weight FROM d GROUP BY source),
weighed AS (SELECT source, (n + 15) // 16 AS b, greatest(1, round(weight / sum(weight ORDER BY source) OVER (ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * 1099511627776))::HUGEINT AS a FROM sizes),
phases AS (SELECT source, a, b, row_number() OVER w AS p, coalesce(sum(b) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done, (sum(a) OVER () - coalesce(sum(a) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::HUGEINT AS active FROM weighed WINDOW w AS (ORDER BY b / a, source)),
marks AS (SELECT x.p AS i, x.source, x.b, k, min_by(q.done + k * q.active // x.a, q.p)::BIGINT AS low, min_by(q.done + (k * q.active + x.a - 1) // x.a, q.p)::BIGINT AS high
  FROM (SELECT *, unnest(range(0, b + 1)) AS k FROM phases) x JOIN phases q ON k * q.a <= q.b * x.a GROUP BY ALL),
lists AS (SELECT i, source, b, list(low ORDER BY k) AS low, list(high ORDER BY k) AS high FROM marks GROUP BY ALL),
every AS (SELECT list(b ORDER BY i) AS b, list(low ORDER BY i) AS low, list(high ORDER BY i) AS high, list(source ORDER BY i) AS s, sum(b) AS slots FROM lists),
edf AS (SELECT 0 AS slot, NULL::BIGINT AS pick, list_transform(b, lambda x: 0::BIGINT) AS given FROM every
  UNION ALL SELECT slot + 1, p, list_transform(given, lambda g, i: g + CASE WHEN i = p THEN 1 ELSE 0 END) FROM
  (SELECT slot, given, list_min(list_filter(list_transform(given, lambda g, i: CASE WHEN g < b[i] AND low[i][g + 1] <= slot THEN high[i][g + 2] * 1000 + i END), lambda x: x IS NOT NULL)) % 1000 AS p FROM edf, every WHERE slot < slots)),
placed AS (SELECT pick AS i, s[pick] AS source, slot - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS block FROM edf, every WHERE pick IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1 AS r FROM d)
SELECT doc_id, r.source, block, low[block + 1] AS release, high[block + 2] AS deadline, slot, r % 16 AS place, true AS kept
FROM ranked r JOIN placed p ON r.source IS NOT DISTINCT FROM p.source AND r.r // 16 = p.block JOIN lists USING (i)
"""

OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '{_SPACES}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM both JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, w.y FROM reach r JOIN ways w ON w.x = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
""".replace("both AS", "pairs AS").replace("FROM both", "FROM pairs")

_ASSIGN = "(" + "|".join("_?" .join("".join(f"[{c.upper()}{c}]" for c in part) for part in w.split("_")) for w in ("password", "passwd", "secret", "token", "api_key")) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(name: str, pattern: str) -> str:
    """(r, v, start) of all matches: the pieces between them and the matches add up to the places."""
    pieces = f"SELECT r, unnest(regexp_extract_all(t, '{pattern}')) AS v, unnest(string_split_regex(t, '{pattern}')) AS g, generate_subscripts(string_split_regex(t, '{pattern}'), 1) AS i FROM d WHERE regexp_matches(t, '{pattern}')"
    return f"{name} AS (SELECT r, v, s - length(v) AS start FROM (SELECT r, v, sum(length(g) + coalesce(length(v), 0)) OVER (PARTITION BY r ORDER BY i) AS s FROM ({pieces})) WHERE v IS NOT NULL)"


#: Windows are counted one by one here, each from its own characters.
OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{_matches("a", _ASSIGN)}, {_matches("k", "AKIA[A-Z0-9]+")}, {_matches("h", "[0-9a-f]+")},
base AS (SELECT r, start, 0 AS nth, 'assign' AS kind, start + length(v) AS stop FROM a WHERE length(regexp_extract(v, '^{_ASSIGN}', 2)) >= 8
  UNION ALL SELECT r, start, 1, 'access', start + length(v) FROM k WHERE length(v) >= 16 UNION ALL SELECT r, start, 2, 'hex', start + length(v) FROM h WHERE length(v) >= 32),
{", ".join(_matches(f"c{i}", f"[{c.characters}]{{{c.window},}}") for i, c in enumerate(CLASSES))},
runs AS ({" UNION ALL ".join(f"SELECT r, v, start, {i} AS c, {c.window} AS w, {most_sum(c.window, c.bits)} AS most, '{c.kind}' AS kind FROM c{i}" + (f" WHERE NOT regexp_full_match(v, '[{CLASSES[i - 1].characters}]+')" if i else "") for i, c in enumerate(CLASSES))}),
open AS (SELECT row_number() OVER () AS q, runs.* FROM runs JOIN d USING (r) WHERE regexp_matches(v, '[A-Za-z][0-9]|[0-9][A-Za-z]') AND NOT regexp_matches(v, '{UUID}') AND NOT contains({_low("v")}, 'example')
  AND NOT regexp_matches({_low(f"t[greatest(start - {BEFORE - 1}, 1):start]")}, '{DECLARED}') AND {" AND ".join(f"NOT contains('{x}', {_low('v')})" for x in SEQUENCES)}),
win AS (SELECT q, w, most, v, unnest(range(0, length(v) - w + 1)) AS pos FROM open),
counted AS (SELECT q, pos, w, most, ch, count(*) AS n FROM (SELECT q, pos, w, most, unnest(string_split(v[pos + 1:pos + w], '')) AS ch FROM win) GROUP BY ALL),
good AS (SELECT q, pos, w FROM counted GROUP BY q, pos, w, most HAVING sum(({terms(max(c.window for c in CLASSES))})[n + 1]) <= most),
isles AS (SELECT q, pos, w, sum(new) OVER (PARTITION BY q ORDER BY pos) AS isle FROM (SELECT *, CASE WHEN lag(pos) OVER (PARTITION BY q ORDER BY pos) + w >= pos THEN 0 ELSE 1 END AS new FROM good)),
added AS (SELECT r, start + min(pos) AS start, 3 + c AS nth, kind, start + max(pos) + i.w AS stop FROM isles i JOIN open USING (q) GROUP BY r, start, c, kind, q, isle, i.w),
every AS (SELECT r, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY r),
based AS (SELECT r, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth) AS spans, count(*) FILTER (nth = 0) AS n0, count(*) FILTER (nth = 1) AS n1, count(*) FILTER (nth = 2) AS n2 FROM base GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(e.spans, '') AS spans
FROM d LEFT JOIN based b USING (r) LEFT JOIN every e USING (r)
"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y, CAST('0x' || h[17:24] AS BIGINT) % 100 AS a, CAST('0x' || h[25:32] AS BIGINT) % 100 AS b FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR a >= 50 THEN 'plain' WHEN b < 80 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f
"""

ORACLE_SQL = {
    "op1_redirect_url_filter": OP1,
    "op3_debruijn_repeats": OP3,
    "op5_sharded_warc": OP5,
    "op7_prefix_decontaminate": OP7,
    "op8_pfair_mixing": OP8,
    "op10_minhash_near_dedup": OP10,
    "op11_entropy_secrets": OP11,
    "op13_fill_in_middle": OP13,
}
