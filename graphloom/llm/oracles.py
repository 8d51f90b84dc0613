"""SQL (DuckDB) for those queries that SQL can express, written from their definitions."""

from __future__ import annotations

from graphloom.llm import quality

SPACES = "[\\x20\\x09-\\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bounds() -> str:
    tests = []
    for _, measure, low, high in quality.THRESHOLDS:
        tests += [f"{measure} >= {low}"] * (low is not None) + [f"{measure} <= {high}"] * (high is not None)
    return " AND ".join(tests)


QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{SPACES}+'), lambda x: x <> '') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
        list_filter(string_split_regex(translate(lower(t), '.,;:!?"''()', ''), '{SPACES}+'), lambda x: x <> '') AS plain FROM d),
x AS (SELECT doc_id, i, concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM x) WHERE k > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{SPACES}', '', 'g')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        coalesce(c.n, 0) AS n_repeat_words, length(t) - length(replace(t, '!', '')) AS bangs, greatest(len(lines), 1)::DOUBLE AS n_lines, greatest(len(words), 1)::DOUBLE AS many,
        len(list_filter(plain, lambda x: list_contains([{', '.join(f"'{s}'" for s in sorted(set(quality.STOP_WORDS)))}], x))) AS stops,
        len(list_filter(lines, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) AS bullets, len(list_filter(lines, lambda x: regexp_matches(rtrim(x, ' '), '(\\.\\.\\.|…)$'))) AS dots
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
q AS (SELECT *, word_chars / many AS mean_word_chars, n_repeat_words / many AS repeat_ratio, n_symbols / greatest(word_chars, 1)::DOUBLE AS symbol_ratio, bangs / many AS exclaim_ratio,
        stops / many AS stop_ratio, n_dup_lines / n_lines AS dup_line_ratio, bullets / n_lines AS bullet_ratio, dots / n_lines AS ellipsis_ratio,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_bounds()} AS kept FROM q
"""

TOKENS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {TOKENS} AS w FROM benchmark),
s AS (SELECT item, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM s)),
d AS (SELECT doc_id, {TOKENS} AS w FROM documents),
e AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM s) WHERE len(w) >= k),
h AS (SELECT e.doc_id, e.i, e.k, g.item FROM e JOIN g ON g.k = e.k AND g.g = array_to_string(e.w[e.i:e.i + e.k - 1], ' ')),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACES}+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, w, least(5, len(w)) AS k FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.doc_id),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id),
f AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id
"""
