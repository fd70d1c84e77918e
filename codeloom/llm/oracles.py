"""DuckDB SQL for the results that SQL can express."""

from __future__ import annotations

from codeloom.llm.url_filter import BLOCK_RATE, BOUND_SD, RULES, TWO_LABELS

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY h)
SELECT p.page_id, n::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN p.page_id < g.last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id < g.last THEN g.last END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h AND p.n >= 1000
"""

OP9 = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g ON d.body = g.body
"""


def _level(name: str, parent: str, above: str) -> str:
    """Sums, prior strength and posterior mean of one level; ``above`` names the parent level's table."""
    return f"""
s_{name} AS (SELECT c.{name}, any_value(a.up) AS up, sum(c.n) AS n, sum(c.bad) AS bad FROM counts c JOIN {above} a ON c.{parent} = a.{parent} GROUP BY c.{name}),
m_{name} AS (SELECT sum(n * pow(bad / n - up, 2) - up * (1 - up)) / sum(n) AS spread, sum(n * up * (1 - up)) / sum(n) AS binomial FROM s_{name}),
k_{name} AS (SELECT coalesce(CASE WHEN spread <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, binomial / spread - 1)) END, 1.0)::DOUBLE AS k FROM m_{name}),
r_{name} AS (SELECT {name}, n, (bad + k * up) / (n + k) AS up, k FROM s_{name}, k_{name})"""


def _op10() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in rules]
    pairs = ", ".join(f"'{x}'" for x in TWO_LABELS)
    last = lambda n: f"array_to_string(list_slice(string_split(site, '.'), -{n}, -1), '.')"
    level = lambda n: f"CASE WHEN regexp_matches(site, '^[0-9]+(\\.[0-9]+){{3}}$') OR starts_with(site, '[') THEN site WHEN {last(2)} IN ({pairs}) THEN {last(n + 1)} ELSE {last(n)} END"
    rule, verdict = (" ".join(f"WHEN {f} THEN '{(r, v)[k]}'" for f, r, v in fits) for k in (0, 1))
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM u),
t AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM h),
ts AS (SELECT *, regexp_replace(regexp_replace(string_split(host, '@')[-1], ':[0-9]*$', ''), '\\.+$', '') AS site FROM t),
marks AS (SELECT doc_id, max(greatest((quality = 0)::INT, (toxic = 1)::INT)) AS bad FROM labels GROUP BY doc_id),
o AS (SELECT site, marks.bad FROM ts JOIN marks ON try_cast(nullif(regexp_extract(path, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT) = marks.doc_id WHERE host <> '' AND marks.bad IS NOT NULL),
counts AS (SELECT site AS host, {level(2)} AS domain, {level(1)} AS suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM o GROUP BY site),
top AS (SELECT DISTINCT suffix, ((SELECT coalesce(sum(bad), 0) FROM counts) + 1) / ((SELECT coalesce(sum(n), 0) FROM counts) + 2) AS up FROM counts),
{_level("suffix", "suffix", "top")},{_level("domain", "suffix", "r_suffix")},{_level("host", "domain", "r_domain")},
asked AS (SELECT DISTINCT site, {level(2)} AS domain, {level(1)} AS suffix FROM ts WHERE site <> ''),
judged AS (SELECT site, coalesce(h.up, d.up, s.up) AS up, coalesce(h.n, 0) AS n, (SELECT k FROM k_host) AS k FROM asked a LEFT JOIN r_host h ON h.host = a.site LEFT JOIN r_domain d ON d.domain = a.domain LEFT JOIN r_suffix s ON s.suffix = a.suffix),
blocked AS (SELECT site AS site_ FROM judged WHERE up - {BOUND_SD} * sqrt(up * (1 - up) / (n + k + 1)) >= {BLOCK_RATE})
SELECT page_id, host, path, CASE {rule} END AS rule, coalesce(CASE {verdict} END, CASE WHEN site_ IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM ts LEFT JOIN blocked ON ts.site = blocked.site_
"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS key FROM x),
f AS (SELECT key AS common FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(common) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (common IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON key = common GROUP BY r
"""


def _crc32(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, bit by bit."""
    byte = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    step = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {byte}), lambda c, b: {step}), 4294967295)"


OP12 = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
cs AS (SELECT DISTINCT c, {_crc32("c::VARCHAR")} % 6 AS h FROM t),
r AS (SELECT cs.c, 0 AS part, pos, role, text FROM cs JOIN t ON t.c = cs.c - cs.c % 100 AND pos < h UNION ALL SELECT cs.c, 1, pos, role, text FROM cs JOIN t ON t.c = cs.c AND pos >= h),
s AS (SELECT cs.c, coalesce(list({{'role': role, 'text': text}} ORDER BY part, pos) FILTER (text IS NOT NULL), []) AS turns FROM cs LEFT JOIN r ON r.c = cs.c GROUP BY 1),
p AS (SELECT c, len(turns) AS length, unnest(range(len(turns) + 1)) AS depth, turns FROM s),
m AS (SELECT c, length, depth, list_slice(turns, 1, depth) AS prefix, CASE WHEN depth > 0 THEN list_slice(turns, 1, depth - 1) END AS up FROM p),
n AS (SELECT depth, prefix, min(c) AS conv_id, count(*) AS n_convs, any_value(up) AS up, CASE WHEN depth > 0 THEN (count(*) - 1) * length(any_value(prefix)[-1].text) ELSE 0 END AS saved,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (length = depth), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
k AS (SELECT depth - 1 AS depth, up AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
b AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.depth = k.depth AND n.prefix = k.prefix),
w AS (SELECT a.depth, a.prefix, sum((b.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens FROM b a JOIN b ON b.depth >= a.depth AND list_slice(b.prefix, 1, a.depth) = a.prefix GROUP BY 1, 2)
SELECT b.conv_id, b.depth, o.conv_id AS parent_conv_id, b.n_convs, b.n_children, w.n_leaves, w.saved_tokens, b.ends_sha256
FROM b JOIN w ON b.depth = w.depth AND b.prefix = w.prefix LEFT JOIN n o ON o.depth = b.depth - 1 AND o.prefix = b.up
"""

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
q AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
x AS (SELECT r, unnest(words) AS word FROM d),
v AS (SELECT word, {_crc32("word")} % 10000 AS bucket FROM (SELECT word FROM x UNION SELECT word FROM q)),
s AS (SELECT bucket, count(*) AS s FROM x JOIN v USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM q JOIN v USING (word) GROUP BY 1),
g AS (SELECT v.bucket, floor(1000 * ln((coalesce(any_value(t), 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM x) + 10000.0::DOUBLE) / ((coalesce(any_value(s), 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM q) + 10000.0::DOUBLE))))::BIGINT AS gain FROM v LEFT JOIN s ON s.bucket = v.bucket LEFT JOIN t ON t.bucket = v.bucket GROUP BY 1),
w AS (SELECT r, sum(gain)::BIGINT AS weight FROM x JOIN v USING (word) JOIN g USING (bucket) GROUP BY 1),
y AS (SELECT r, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (r)),
z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, r) AS place, count(*) OVER () AS n FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM y LEFT JOIN z USING (r)
"""

ORACLES = {"op11_line_dedup": OP11, "op12_prefix_trie": OP12, "op13_resample": OP13, "op4_warc": OP4, "op9_exact_dedup": OP9, "op10_url_filter": _op10()}
