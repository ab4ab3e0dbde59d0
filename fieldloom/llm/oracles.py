"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

# Words between spaces and the controls from tab to carriage return.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')"

QUALITY_RULES = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, md5(coalesce(text, '')) AS key, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS lines
  FROM documents),
u AS (SELECT DISTINCT key, w FROM d),
win AS (SELECT key, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM (SELECT key, w, unnest(range(1, len(w) - 1)) AS i FROM u)),
twice AS (SELECT key, i FROM (SELECT key, i, count(*) OVER (PARTITION BY key, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT key, count(DISTINCT p) AS n FROM (SELECT key, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY key),
held AS (SELECT DISTINCT host, key, trim(regexp_replace(lower(line), '[0-9]', '0', 'g'), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS h, length(line) AS n
         FROM (SELECT DISTINCT host, key, unnest(lines) AS line FROM d)),
common AS (SELECT host, h, min(key) AS keeper FROM (SELECT DISTINCT host, key, h FROM held) GROUP BY host, h HAVING count(*) > 100),
lost AS (SELECT held.host, held.key, sum(CASE WHEN keeper IS NOT NULL AND held.key <> keeper THEN held.n ELSE 0 END) AS gone, sum(held.n) AS whole,
                count(DISTINCT CASE WHEN keeper IS NOT NULL AND held.key <> keeper THEN held.h END) AS n_removed
         FROM held LEFT JOIN common ON held.host = common.host AND held.h = common.h GROUP BY held.host, held.key),
s AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_removed, 0)::BIGINT AS n_removed_lines, coalesce(1 - gone / whole, 1.0) AS share
      FROM d LEFT JOIN rep ON d.key = rep.key LEFT JOIN lost ON d.host = lost.host AND d.key = lost.key)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND share >= 0.2) AS kept, n_removed_lines
FROM s
"""

_CONTROLS = r"<\|turn\|>|<\|end\|>|<\|endoftext\|>|<\|im_start\|>|<\|im_end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>"

CHAT_FORMAT = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\')) + 2 * len(regexp_extract_all(text, '{_CONTROLS}')) AS body,
             length(role) + len(regexp_extract_all(role, '\\')) + len(regexp_extract_all(role, chr(10))) + 2 * len(regexp_extract_all(role, '{_CONTROLS}')) AS head FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(head + body + 17)::BIGINT AS formatted_chars,
       regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn NULLS FIRST, role, text), 's?(ua)+') AS valid
FROM m GROUP BY conv_id
"""

# The checksums that date the lists are computed bit by bit: DuckDB has no crc32.
_CRC = """
  SELECT k, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(k))), lambda i: ascii(k[i + 1])::BIGINT)), lambda c, b:
    list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)) AS r
"""

URL_FILTER = rf"""
WITH p AS (
  SELECT page_id, url, regexp_replace(regexp_extract(lower(coalesce(url, '')), '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', '') AS host,
         regexp_extract(coalesce(url, ''), '^[A-Za-z]+://[^/?#]*/*([^?#]*?)/*(?:[?#].*)?$', 1) AS path
  FROM pages),
hosts AS (SELECT DISTINCT host, string_split(path, '/')[1] AS section FROM p WHERE host <> ''),
names AS (
  SELECT DISTINCT 'block' AS list, 'domain' AS kind, array_to_string(string_split(host, '.')[greatest(len(string_split(host, '.')) - 2, 1):], '.') AS pattern FROM hosts
  UNION ALL SELECT DISTINCT 'adult', 'domain', host FROM hosts
  UNION ALL SELECT DISTINCT 'allow', 'prefix', host || '/' || section FROM hosts),
keys AS (SELECT DISTINCT pattern AS k FROM names UNION SELECT DISTINCT coalesce(url, '') FROM p),
crc AS (SELECT k, xor(r, 4294967295::BIGINT) AS d FROM ({_CRC} FROM keys)),
n AS (SELECT names.*, d, (19723 + d % 200) * 86400 AS on_, (19723 + d % 200 + 20 + d % 90) * 86400 AS off_, (19723 + d % 200 + 120 + d % 60) * 86400 AS back_ FROM names JOIN crc ON pattern = k),
entries AS (
  SELECT list, kind, pattern, 'add' AS action, on_ AS at FROM n WHERE (list = 'block' AND d % 2 = 0) OR (list = 'adult' AND d % 5 = 1)
  UNION SELECT list, kind, pattern, 'remove', off_ FROM n WHERE (list = 'block' AND d % 2 = 0 AND d % 3 > 0) OR (list = 'adult' AND d % 5 = 1)
  UNION SELECT list, kind, pattern, 'add', back_ FROM n WHERE list = 'block' AND d % 2 = 0 AND d % 3 = 2
  UNION SELECT list, kind, pattern, 'add', (19723 + d % 100) * 86400 FROM n WHERE list = 'allow' AND d % 7 = 2),
c AS (SELECT row_number() OVER () AS id, p.*, 19723 * 86400 + d % (366 * 86400) AS t FROM p JOIN crc ON coalesce(url, '') = k),
-- what the last entry up to the fetch time said
last AS (SELECT c.id, e.list, e.kind, e.pattern, arg_max(e.action, (e.at, e.action)) AS action
         FROM c JOIN entries e ON e.at <= c.t AND CASE WHEN e.kind = 'domain' THEN c.host = e.pattern OR ends_with(c.host, '.' || e.pattern)
              ELSE starts_with(c.host || '/' || c.path || '/', e.pattern || CASE WHEN ends_with(e.pattern, '/') THEN '' ELSE '/' END) END
         GROUP BY c.id, e.list, e.kind, e.pattern),
best AS (SELECT id, count(*) AS n, arg_min(list, (-length(pattern), list <> 'allow', list, kind, pattern)) AS list, arg_min(pattern, (-length(pattern), list <> 'allow', list, kind, pattern)) AS pattern
         FROM last WHERE action = 'add' GROUP BY id)
SELECT page_id, url, t AS fetched_at, host, coalesce(n, 0) AS n_active, list AS list_name, pattern, coalesce(list <> 'allow', false) AS blocked
FROM c LEFT JOIN best USING (id)
"""

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def _license_scan() -> str:
    """Phrases by place, notices by list intersection with each template's words."""
    from fieldloom.llm.license_scan import NAMED, PHRASES, needed, templates

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    phrases = " UNION ALL ".join(
        f"SELECT doc, i, {quoted(label)} AS label FROM pos WHERE " + " AND ".join(f"w[i + {j + 1}] = {quoted(x)}" for j, x in enumerate(p.split(" "))) for p, label in PHRASES.items())
    rows = ", ".join(f"({quoted(t.label)}, {quoted(t.block)}, [{', '.join(map(quoted, t.tokens))}], {needed(t)})" for t in templates())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc, doc_id, t, list_filter(regexp_split_to_array(t, '{_NOT_WORD}+'), lambda x: x <> '') AS w FROM d),
pos AS (SELECT doc, w, unnest(range(0, len(w))) AS i FROM w),
base AS (SELECT doc, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base_labels FROM ({phrases}) GROUP BY doc),
blocks AS (SELECT doc, 'line' AS block, unnest(string_split(t, chr(10))) AS b FROM d UNION ALL SELECT doc, 'section', unnest(regexp_split_to_array(t, '\n{_NOT_WORD}*\n')) FROM d),
sets AS (SELECT doc, block, list_distinct(regexp_split_to_array(b, '{_NOT_WORD}+')) AS s FROM blocks),
templates(label, block, tokens, need) AS (VALUES {rows}),
met AS (SELECT doc, label, len(list_intersect(s, tokens)) / len(tokens) AS share FROM sets JOIN templates USING (block) WHERE len(list_intersect(s, tokens)) >= need),
found AS (SELECT doc, list(DISTINCT label) AS labels, max(share) AS share FROM met GROUP BY doc)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(base_labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(labels, [])))), ','), '') AS labels,
       greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN {NAMED} ELSE 0.0 END)::DOUBLE AS score
FROM w LEFT JOIN base USING (doc) LEFT JOIN found USING (doc)
"""


# crc32 of the decimal digits of a number n.
_CRC_OF = """(SELECT xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(n::VARCHAR)), lambda i: ascii((n::VARCHAR)[i + 1])::BIGINT)), lambda c, b:
    list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT))"""

# A run of 12 words or more agrees with itself, one period further, over 6 words or more.
PERIOD_RUNS = rf"""
WITH d AS (SELECT doc_id, doc_id AS n, {_WORDS} AS w FROM documents),
h AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM (SELECT doc_id, w, {_CRC_OF} AS h FROM d)),
m AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM h),
t AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM m),
six AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, n - 5)) AS i FROM t)),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM six x JOIN six y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i),
isle AS (SELECT doc_id, q, min(i) AS start, max(i) + 6 - min(i) AS agree FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same) GROUP BY doc_id, q, k),
runs AS (SELECT doc_id, start, agree + q AS length, min(q) AS period FROM isle WHERE agree >= q AND agree + q >= 12 GROUP BY doc_id, start, agree + q),
lost AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS s FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, n)) AS i FROM t) x ANTI JOIN lost ON lost.doc_id = x.doc_id AND lost.i = x.i GROUP BY x.doc_id),
found AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS s,
                 first(struct_pack(start, length, period) ORDER BY length DESC, start, period) AS best FROM runs GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
       coalesce(found.s, sha256('')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM t LEFT JOIN found USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

PREFIX_TRIE = rf"""
WITH ids AS (SELECT n, {_CRC_OF} % 4 AS h FROM (SELECT DISTINCT conv_id AS n FROM conversations WHERE conv_id IS NOT NULL)),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
      FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT n AS c, 0 AS own, i, role, text FROM ids JOIN p ON p.conv_id = n - n % 20 AND i <= h
      UNION ALL SELECT n, 1, i, role, text FROM ids JOIN p ON p.conv_id = n AND i > h),
t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d, sha256(length(role) || ':' || role || text) AS turn, len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')) AS words FROM r),
v AS (SELECT c, d, string_agg(turn, '') OVER (PARTITION BY c ORDER BY d) AS k, words FROM t UNION ALL SELECT n, 0, '', 0 FROM ids),
e AS (SELECT c, max(d) AS d, max_by(k, d) AS k FROM v GROUP BY c),
nodes AS (SELECT k, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM v GROUP BY k),
parents AS (SELECT a.k, b.k AS pk, b.conv_id AS parent_conv_id FROM nodes a JOIN nodes b ON a.depth = b.depth + 1 AND b.k = a.k[:64 * b.depth]),
kids AS (SELECT pk AS k, count(*) AS n FROM parents GROUP BY pk),
below AS (SELECT DISTINCT a.k AS top, n.k AS k FROM nodes n JOIN v a ON a.c = n.conv_id AND a.d <= n.depth),
sums AS (SELECT top, sum((n_convs - 1) * words)::BIGINT AS saved, count(*) FILTER (WHERE kids.k IS NULL) AS leaves FROM below JOIN nodes USING (k) LEFT JOIN kids ON kids.k = nodes.k GROUP BY top),
ends AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS s FROM e GROUP BY k)
SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, parent_conv_id, n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, coalesce(ends.s, sha256('')) AS ends_sha256
FROM nodes JOIN sums ON top = nodes.k LEFT JOIN parents ON parents.k = nodes.k LEFT JOIN kids ON kids.k = nodes.k LEFT JOIN ends ON ends.k = nodes.k
"""

ORACLES: dict[str, str] = {
    "op2_url_filter": URL_FILTER,
    "op3_chat_format": CHAT_FORMAT,
    "op9_license_scan": _license_scan(),
    "op10_quality_rules": QUALITY_RULES,
    "op11_period_runs": PERIOD_RUNS,
    "op12_prefix_trie": PREFIX_TRIE,
}
