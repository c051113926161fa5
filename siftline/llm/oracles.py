"""DuckDB SQL for the operators that SQL can express; the constants are those of the operators."""

from __future__ import annotations

from .chat_format import ORACLE as CHAT_FORMAT
from .embedding_dedup import THRESHOLD
from .merkle import ORACLE as MERKLE_MANIFEST
from .phrases import ORACLE as COLLOCATIONS
from .quality_rules import MARKS, MAX_LOST_PERCENT, MAX_REPEAT_PERCENT, MENU, MIN_WORDS, PHRASES

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def held(words: tuple[bytes, ...], column: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w.decode()}')" for w in words) + ")"


def only(kept: str, column: str = "line") -> str:
    """How many characters of a class a column holds."""
    return f"length(regexp_replace({column}, '[^{kept}]', '', 'g'))"


IN_MENU = ", ".join(f"'{x.decode()}'" for x in MENU)
PHRASE = " OR ".join(f"(n <= {3 * size} AND regexp_matches(lower(line), '{x.pattern.decode()}'))" for size, x in PHRASES.items())

QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
  w AS (SELECT k, doc_id, t, regexp_extract_all(t, '{WORD}') AS ws, string_split(t, chr(10)) AS lines FROM d),
  g AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS three FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
  twice AS (SELECT k, i FROM g QUALIFY count(*) OVER (PARTITION BY k, three) > 1),
  inside AS (SELECT k, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY k),
  l AS (SELECT k, line, regexp_extract_all(line, '{WORD}') AS ws FROM (SELECT k, unnest(lines) AS line FROM w)),
  c AS (SELECT k, line, len(ws) AS n, len(list_distinct(ws)) AS kinds, ws, len(list_filter(ws, lambda x: lower(x) IN ({IN_MENU}))) AS menu, {only("#*$%&|<>")} AS symbols, {only("|")} AS pipes,
    {only("!")} AS cries, {only("A-Z")} AS upper, {only("a-z")} AS lower FROM l),
  f AS (SELECT k, length(line) AS size, n > 0 AND (
      (n >= 3 AND 4 * pipes >= n)
      OR (symbols >= 3 AND 8 * symbols > strlen(line))
      OR (n >= 3 AND 2 * cries > n)
      OR (n >= 3 AND upper >= 12 AND upper > 2 * lower)
      OR (n >= 10 AND 3 * kinds < n)
      OR (n >= 3 AND 3 * menu >= 2 * n AND right(ws[-1], 1) NOT IN ('.', '!', '?'))
      OR {PHRASE}
      OR (n >= 30 AND NOT {held(MARKS, "line")})) AS failed FROM c),
  s AS (SELECT k, count(*) AS n_lines, count(*) FILTER (failed) AS n_failed_lines,
    CAST(coalesce(sum(size) FILTER (failed), 0) AS BIGINT) AS lost_chars, CAST(sum(size) AS BIGINT) AS total FROM f GROUP BY k),
  b AS (SELECT w.k, doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars,
    {only("#*$%&|<>", "t")} AS n_symbols,
    CAST(len(list_filter(lines, lambda x: regexp_matches(x, '{WORD}'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '{WORD}')))) AS BIGINT) AS n_dup_lines,
    coalesce(inside.n, 0) AS n_repeat_words FROM w LEFT JOIN inside ON inside.k = w.k),
  e AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_failed_lines, lost_chars,
  NOT base_failed AND 100 * lost_chars <= {MAX_LOST_PERCENT} * total AS kept
FROM e JOIN s ON s.k = e.k
"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
  f AS (SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(x, lambda y: y <> 0)) > 0),
  p AS (SELECT a.k AS a, b.k AS b FROM f a JOIN f b ON a.label = b.label AND len(a.x) = len(b.x) AND a.k <> b.k
    WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
  r AS (SELECT k, k AS seen FROM v UNION SELECT r.k, p.b FROM r JOIN p ON p.a = r.seen),
  c AS (SELECT r.k, min(v.vec_id) AS component_id FROM r JOIN v ON v.k = r.seen GROUP BY r.k),
  n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN c ON c.k = v.k LEFT JOIN n ON n.a = v.k
"""

ORACLES = {
    "op3_chat_format": CHAT_FORMAT,
    "op5_embedding_dedup": EMBEDDING_DEDUP,
    "op7_quality_rules": QUALITY_RULES,
    "op12_collocations": COLLOCATIONS,
    "op13_merkle_manifest": MERKLE_MANIFEST,
}
