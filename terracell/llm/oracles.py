"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from terracell.llm.quality_rules import BASE_RULES, RULES, STOP_WORDS, Rule

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') AS n FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM g"""


def near_copies(words: int, percent: int, more: str = "") -> str:
    """Least reachable id by links of similarity ``percent`` or more of shingles of so many words."""
    return f"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + {words}], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - {words - 1}, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2)
    JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= {percent} * (p.n + q.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id{more} FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least ON a = d.doc_id"""

#: CRC-32 of a decimal number, bit by bit.
CRC32 = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda s, z: xor(s >> 1, 3988292384::BIGINT * (s & 1)))))"""

PREFIX_TRIE = rf"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c FROM t),
k AS (SELECT c, c - c % 20 AS base, {CRC32} % 4 AS h FROM ids),
turns AS (
    SELECT k.c, t.pos AS i, t.role, t.text FROM k JOIN t ON t.c = k.base AND t.pos <= k.h
    UNION ALL SELECT k.c, 1000000 + t.pos, t.role, t.text FROM k JOIN t ON t.c = k.c AND t.pos > k.h),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, sha256(length(role)::VARCHAR || ' ' || role || text) AS turn,
    len(regexp_extract_all(text, '{WORD}')) AS words FROM turns),
m AS (SELECT c, d, words, string_agg(turn, '') OVER (PARTITION BY c ORDER BY d) AS node, max(d) OVER (PARTITION BY c) = d AS ends,
    coalesce(string_agg(turn, '') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS parent FROM r
    UNION ALL SELECT c, 0, 0, '', c NOT IN (SELECT c FROM r), NULL FROM ids),
n AS (SELECT d AS depth, node, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256 FROM m GROUP BY d, node),
kids AS (SELECT parent, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON kids.parent = n.node),
sub AS (SELECT a.node, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens
    FROM w a JOIN m ON m.c = a.conv_id AND m.node = a.node JOIN w b ON starts_with(b.node, a.node) GROUP BY 1)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, sub.n_leaves, sub.saved_tokens, w.ends_sha256
FROM w JOIN sub USING (node) LEFT JOIN n p ON p.node = w.parent"""

SOURCE_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
tok AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM tok GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM tok JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gs AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM dense GROUP BY 1, 2),
p AS (SELECT dense.lang, dense.source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v) AS p FROM dense JOIN gs USING (lang, source) JOIN v USING (lang)),
ln AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY 1, 2),
lt AS (SELECT lang, sum(n)::HUGEINT AS total FROM ln GROUP BY 1),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v) AS q FROM ln JOIN lt USING (lang) JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
    SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL
    SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms)
WHERE part = 'pair' OR rank <= 200"""


def broken(rule: Rule) -> str:
    top, base = rule.share
    base = f"{base}::DOUBLE" if base else "1e0"
    tests = [f"{top} < {float(rule.low)!r}::DOUBLE * {base}"] if rule.low is not None else []
    tests += [f"{top} > {float(rule.high)!r}::DOUBLE * {base}"] if rule.high is not None else []
    return "(" + " OR ".join(tests) + ")"


def quality_rules() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    base = " OR ".join(broken(r) for r in RULES if r.name in BASE_RULES)
    names = ", ".join(f"CASE WHEN {broken(r)} THEN '{r.name}' END" for r in RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
k AS (SELECT doc_id, w, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times
    FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2))),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM tri, range(3) r(o) WHERE times > 1 GROUP BY 1),
m AS (SELECT k.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines) AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words FROM k LEFT JOIN rep ON rep.doc_id = k.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed,
    concat_ws(',', {names}) = '' AS kept, concat_ws(',', {names}) AS failed_rules FROM m"""
