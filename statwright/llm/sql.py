"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from statwright.llm.chat_format import BUDGET, HISTORY
from statwright.llm.quality_rules import BASE, CURRENT, POLICIES, RULES
from statwright.llm.url_filter import RULES as URL_RULES

_BITS = " + ".join(f"CASE WHEN {sql} THEN {1 << bit} ELSE 0 END" for bit, _, sql in RULES)

OP2 = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t,
    list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM t
), g AS (
  SELECT *, CASE WHEN len(ws) < 3 THEN []::VARCHAR[] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2]) END AS gs FROM w
), r AS (
  SELECT doc_id, i, g3, count(*) OVER (PARTITION BY rid, g3) AS n, rid
  FROM (SELECT doc_id, rid, unnest(gs) AS g3, generate_subscripts(gs, 1) AS i FROM (SELECT *, row_number() OVER () AS rid FROM g))
), d AS (
  SELECT rid, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY rid
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper
  FROM (SELECT *, row_number() OVER () AS rid FROM g) LEFT JOIN d USING (rid)
), b AS (SELECT *, ({_BITS})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {BASE}) <> 0 AS base_failed, (fail_bits & {POLICIES[CURRENT] | BASE}) = 0 AS kept, fail_bits FROM b
"""

OP7 = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS gs FROM w
), e AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), c(id, root) AS (
  WITH RECURSIVE c(id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.id)
  SELECT id, min(root) FROM c GROUP BY id
)
SELECT s.doc_id, len(gs)::BIGINT AS n_shingles, c.root AS component_id FROM s JOIN c ON c.id = s.doc_id
"""

_SPACE = "[\\x20\\x09-\\x0D]+"
_HEAD = "CASE role WHEN 'system' THEN '<s>[SYS] ' WHEN 'user' THEN '<s>[INST] ' WHEN 'assistant' THEN '<s>[ANS] ' ELSE '<s>[ROLE:' || {esc} || '] ' END"
_TAIL = "CASE role WHEN 'system' THEN ' [/SYS]</s>' WHEN 'user' THEN ' [/INST]</s>' WHEN 'assistant' THEN ' [/ANS]</s>' ELSE ' [/ROLE]</s>' END"


def _escaped(x: str) -> str:
    return f"regexp_replace({x}, '([\\\\\\[\\]<])', '\\\\\\1', 'g')"


OP10 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, {_HEAD.format(esc=_escaped('role'))} || {_escaped('text')} || {_TAIL} AS formatted FROM t
), n AS (
  SELECT *, len(regexp_split_to_array(formatted, '{_SPACE}')) AS tokens, row_number() OVER o AS pos FROM f WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), p AS (
  SELECT n.*, sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos) AS upto, min(CASE WHEN role = 'system' THEN pos END) OVER (PARTITION BY conv_id) AS sys FROM n
), b AS (
  -- what a window that begins with this turn holds at once: the turn, the system turn before it, and as many of the turns before it as fit
  SELECT p.*, tokens + CASE WHEN sys < pos THEN (SELECT s.tokens FROM n s WHERE s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.pos = p.sys) ELSE 0 END AS alone FROM p
), h AS (
  SELECT conv_id, pos, max(k) AS reach, max(held) AS begun FROM (
    SELECT b.conv_id, b.pos, r.k, b.alone + coalesce(sum(e.tokens) FILTER (e.pos IS DISTINCT FROM b.sys), 0) AS held
    FROM b, range({HISTORY + 1}) AS r(k) LEFT JOIN n e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.pos < b.pos AND e.pos >= b.pos - r.k GROUP BY b.conv_id, b.pos, b.alone, r.k
  ) WHERE k = 0 OR held <= {BUDGET} GROUP BY conv_id, pos
), q AS (
  -- the next window begins with the first turn up to which this one would hold more than the budget
  SELECT h.conv_id, h.pos, h.reach, (SELECT min(e.pos) FROM p e WHERE e.conv_id IS NOT DISTINCT FROM h.conv_id AND e.pos > h.pos AND h.begun + e.upto - f.upto > {BUDGET}) AS following
  FROM h JOIN p f ON f.conv_id IS NOT DISTINCT FROM h.conv_id AND f.pos = h.pos
), w AS (
  WITH RECURSIVE w(conv_id, pos, reach, following) AS (SELECT * FROM q WHERE pos = 1 UNION ALL SELECT q.* FROM w JOIN q ON q.conv_id IS NOT DISTINCT FROM w.conv_id AND q.pos = w.following) SELECT * FROM w
), z AS (
  SELECT p.conv_id, sum(length(p.formatted)) AS formatted_chars FROM w JOIN p ON p.conv_id IS NOT DISTINCT FROM w.conv_id
    AND ((p.pos >= w.pos - w.reach AND p.pos < coalesce(w.following, 1e18)) OR (p.pos = p.sys AND p.pos < w.pos)) GROUP BY p.conv_id
)
SELECT p.conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  any_value(z.formatted_chars)::BIGINT AS formatted_chars
FROM p JOIN z ON z.conv_id IS NOT DISTINCT FROM p.conv_id GROUP BY p.conv_id
"""

_RULES = "(VALUES " + ", ".join(f"('{v}', '{h}', '{p}', {k})" for k, (v, h, p) in enumerate(URL_RULES)) + ") AS r(verdict, host, path, n)"

URLS = f"""
WITH u AS (
  SELECT page_id, row_number() OVER () AS rid, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, rid, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), m AS (
  SELECT s.rid, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), 1000 * length(r.host || r.path) - r.n) AS best
  FROM s JOIN {_RULES} ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path) GROUP BY s.rid
)
SELECT page_id, host, path, best.rule AS rule, best.verdict AS rule_verdict FROM s LEFT JOIN m USING (rid)
"""

SQL = {"op2_quality_rules": OP2, "op7_ngram_join": OP7, "op10_chat_format": OP10, "url_rules": URLS}
