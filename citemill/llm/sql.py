"""The same results in plain SQL, where SQL can express them."""

from __future__ import annotations

from citemill.llm.line_quality import MAX_DOCS, MIN_LEFT
from citemill.llm.mixing import PRODUCTION, Mix
from citemill.llm.url_filter import HOST_RULES, PATTERNS, pattern_regex

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM l),
c AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (c.key IS NOT NULL AND k.doc_id <> c.last_doc) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL OR k.doc_id = c.last_doc), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.doc_id"""

_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_rules = ", ".join(f"({_quoted(r.verdict)}, {_quoted(r.host)}, {_quoted(r.path)})" for r in HOST_RULES)
_patterns = ", ".join(f"({_quoted(pattern_regex(p))})" for p in PATTERNS)

OP2 = f"""
WITH rules(verdict, host, path) AS (VALUES {_rules}), patterns(regex) AS (VALUES {_patterns}),
u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*(/?[^?#]*)', 1) AS path FROM u),
fit AS (SELECT p.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN rules r ON ('.' || p.host) LIKE ('%.' || r.host) AND starts_with(p.path, r.path) GROUP BY p.page_id),
bad AS (SELECT DISTINCT page_id FROM p, patterns WHERE regexp_matches({_LOWER.format("url")}, regex))
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, CASE WHEN bad.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN fit USING (page_id) LEFT JOIN bad USING (page_id)"""



def _case(column: str, values: dict, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v) if isinstance(v, str) else v}" for k, v in values.items()) + f" ELSE {other} END"


def _share(name: str, nodes: str, parent: str, label: str) -> str:
    """CTEs that give each node its budget from ``given``."""
    by = f"PARTITION BY {parent}"
    return f"""
{name}_a AS (SELECT *, coalesce(sum(capacity) OVER ({by} ORDER BY capacity / weight, {label} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
  sum(weight) OVER ({by} ORDER BY capacity / weight, {label} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM {nodes}),
{name}_b AS (SELECT *, (given - full_before) * weight >= capacity::HUGEINT * weight_left AS is_full FROM {name}_a),
{name}_c AS (SELECT *, given - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({by}) AS rest_of,
  greatest(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({by}), 1) AS open_weight FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN is_full THEN capacity ELSE (rest_of * weight) // open_weight END AS part FROM {name}_c),
{name} AS (SELECT *, part + CASE WHEN NOT is_full AND row_number() OVER ({by}, is_full ORDER BY {label})
  <= rest_of - sum(CASE WHEN is_full THEN 0 ELSE part END) OVER ({by}) THEN 1 ELSE 0 END AS budget FROM {name}_d)"""


def mixing_ctes(mix: Mix, documents: str) -> str:
    """CTEs up to ``mixed(doc_id, domain, lang, source, epoch, tokens, take)``."""
    return f"""
mix_docs AS (SELECT doc_id, {_case("coalesce(source, '')", mix.domain_of, _quoted(mix.other))} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM {documents}),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS available, {mix.max_epochs} * sum(tokens)::BIGINT AS capacity,
  {_case("source", mix.sources, "1")} AS weight FROM mix_docs GROUP BY ALL),
d0 AS (SELECT domain, sum(capacity)::BIGINT AS capacity, sum(available)::BIGINT AS available, {_case("domain", mix.domains, "1")} AS weight FROM leaves GROUP BY domain),
d1 AS (SELECT *, 0 AS root, least(floor(sum(available) OVER () * {mix.percent} / 100)::BIGINT, sum(capacity) OVER ()) AS given FROM d0), {_share("d2", "d1", "root", "domain")},
g1 AS (SELECT l.domain, l.lang, sum(l.capacity)::BIGINT AS capacity, {_case("l.lang", mix.languages, "1")} AS weight, any_value(d2.budget) AS given
  FROM leaves l JOIN d2 USING (domain) GROUP BY l.domain, l.lang), {_share("g2", "g1", "domain", "lang")},
s1 AS (SELECT l.*, g2.budget AS given FROM leaves l JOIN g2 USING (domain, lang)), {_share("s2", "s1", "domain, lang", "source")},
shares AS (SELECT domain, lang, source, CASE WHEN available > 0 THEN budget // available ELSE 0 END AS whole,
  CASE WHEN available > 0 THEN budget % available ELSE 0 END AS rest FROM s2),
keyed AS (SELECT k.*, whole, rest, substr(md5(concat_ws('|', '{mix.seed}', whole::BIGINT::VARCHAR, doc_id::VARCHAR)), 1, 16) AS key
  FROM mix_docs k JOIN shares USING (domain, lang, source)),
placed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM keyed),
mixed AS (SELECT doc_id, domain, lang, source, epoch, tokens, CASE WHEN epoch = whole THEN least(tokens, rest - start) ELSE tokens END AS take
  FROM placed, range({mix.max_epochs + 1}) r(epoch) WHERE epoch < whole OR epoch = whole AND start < rest)"""


OP3 = f"""WITH {mixing_ctes(PRODUCTION, "documents")}
SELECT doc_id, domain, lang, source, epoch, tokens, take FROM mixed"""

OP6 = f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS seen FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, seen) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) r(k) GROUP BY doc_id),
l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM w),
n AS (SELECT *, trim(regexp_replace({_LOWER.format("line")}, '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS norm FROM l),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM n WHERE norm <> '' GROUP BY doc_id),
often AS (SELECT source, norm FROM n WHERE norm <> '' GROUP BY source, norm HAVING count(DISTINCT doc_id) > {MAX_DOCS}),
gone AS (SELECT n.doc_id, sum(length(replace(n.norm, ' ', ''))) AS chars FROM n JOIN often o ON n.norm = o.norm AND n.source IS NOT DISTINCT FROM o.source GROUP BY n.doc_id),
b AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.chars, 0) AS gone
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (gone > 0 AND word_chars - gone < {MIN_LEFT}::DOUBLE * word_chars) AS kept FROM j"""

OP11 = """
WITH RECURSIVE tab(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM tab WHERE k < 8),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT *, md5(strlen(role) || ':' || role || text) AS key, strlen(text) AS bytes FROM t),
p AS (SELECT conv_id, key, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, key) - 1 AS pos FROM h),
crc(conv_id, s, place, c) AS (SELECT conv_id, conv_id::VARCHAR, 0, 4294967295 FROM (SELECT DISTINCT conv_id FROM t) UNION ALL
  SELECT conv_id, s, place + 1, xor(crc.c >> 8, tab.c) FROM crc JOIN tab ON tab.k = 8 AND tab.i = xor(crc.c & 255, ascii(s[place + 1])) WHERE place < length(s)),
shared AS (SELECT conv_id, xor(c, 4294967295) % 9 AS h FROM crc WHERE place = length(s)),
b AS (SELECT c.conv_id, p.pos, p.key, p.bytes FROM shared c JOIN p ON p.conv_id = c.conv_id - c.conv_id % 5 AND p.pos < c.h
  UNION ALL SELECT p.conv_id, p.pos + 1000000, p.key, p.bytes FROM p JOIN shared c USING (conv_id) WHERE p.pos >= c.h),
r AS (SELECT conv_id, row_number() OVER w AS depth, bytes, string_agg(key, '' ORDER BY pos) OVER w AS prefix FROM b
  WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM shared),
n AS (SELECT min(conv_id) AS conv_id, depth, prefix, count(*) AS n_convs, any_value(bytes) AS bytes FROM r GROUP BY depth, prefix),
m AS (SELECT r.conv_id AS member, n.* FROM r JOIN n USING (depth, prefix)),
up AS (SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id FROM n LEFT JOIN m ON m.member = n.conv_id AND m.depth = n.depth - 1),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY ALL),
k AS (SELECT n.*, coalesce(kids.n_children, 0) AS n_children FROM n LEFT JOIN kids USING (conv_id, depth)),
sub AS (SELECT m.conv_id, m.depth, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((k.n_convs - 1) * k.bytes) AS saved_tokens
  FROM k JOIN m ON m.member = k.conv_id AND m.depth <= k.depth GROUP BY ALL),
last AS (SELECT conv_id, max(depth) AS depth FROM r GROUP BY conv_id),
ends AS (SELECT m.conv_id, m.depth, sha256(string_agg(last.conv_id::VARCHAR, ',' ORDER BY last.conv_id)) AS ends_sha256
  FROM last JOIN m ON m.member = last.conv_id AND m.depth = last.depth GROUP BY ALL)
SELECT k.conv_id, k.depth, up.parent_conv_id, k.n_convs, k.n_children, sub.n_leaves::BIGINT AS n_leaves, sub.saved_tokens::BIGINT AS saved_tokens,
  coalesce(ends.ends_sha256, sha256('')) AS ends_sha256
FROM k JOIN up USING (conv_id, depth) JOIN sub USING (conv_id, depth) LEFT JOIN ends USING (conv_id, depth)"""

OP12 = """
WITH RECURSIVE r AS (SELECT row_number() OVER () AS i, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
v AS (SELECT * FROM r WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.i AS a, b.i AS b FROM v a JOIN v b ON a.i <> b.i AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT i, i FROM r UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT reach.a AS i, min(r.vec_id) AS component_id FROM reach JOIN r ON r.i = reach.b GROUP BY reach.a),
n AS (SELECT a AS i, count(*) AS n_links FROM l GROUP BY a)
SELECT r.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, r.vec_id IS NOT DISTINCT FROM c.component_id AS kept
FROM r JOIN c USING (i) LEFT JOIN n USING (i)"""

ORACLES = {"op1_line_dedup": OP1, "op2_url_filter": OP2, "op3_mixing": OP3, "op6_line_quality": OP6, "op11_prefix_trie": OP11, "op12_embedding_dedup": OP12}
