"""DuckDB SQL for the operators that SQL can express, over the views documents and benchmark."""

from __future__ import annotations

from lamella.llm.quality_rules import (
    CLASSES,
    COMMON,
    MAX_CLASS_DISTANCE,
    MIN_CHARS,
    MIN_WORDS,
    WORD_SHARE,
)

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
SOLID = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATION = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, {ALNUM}) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({LOWER}, {ALNUM}) AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM b WHERE len(w) > 0)
), places AS (
  SELECT r, size, k, array_to_string(w[k:k + size - 1], ' ') AS t
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM win))
), hits AS (
  SELECT r, k, p.size AS size, item_id FROM places p JOIN win USING (size, t)
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS p FROM hits) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
         array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS names
  FROM hits GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

JACCARD = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, {SOLID}) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS e
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, e.y FROM reach JOIN e ON e.x = reach.r
)
SELECT doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _js(p: str, q: str) -> str:
    """The Jensen-Shannon distance of two lists of counts."""
    x, y = f"({p}[i] / list_sum({p}))", f"({q}[i] / list_sum({q}))"
    m = f"(({x} + {y}) / 2)"
    part = "CASE WHEN {0} > 0 THEN {0} * log2({0} / {1}) ELSE 0 END"
    return (
        f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), "
        f"lambda i: ({part.format(x, m)} + {part.format(y, m)}) / 2)))) END"
    )


_LISTS = ", ".join(f"({_quoted(k)}, [{', '.join(map(_quoted, v))}])" for k, v in COMMON.items())
#: The histogram of a text without common words.
_NONE = f"[{', '.join(['0.0::DOUBLE'] * 16)}, 1.0::DOUBLE]"
_COUNTS = ", ".join(f"len(regexp_extract_all(t, {_quoted(c)}))" for c in CLASSES)

QUALITY_RULES = f"""
WITH lists(lang, words) AS (
  VALUES {_LISTS}
), d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), {SOLID}) AS w FROM documents
), windows AS (
  SELECT r, k, array_to_string(w[k:k + 4], ' ') AS e FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)
), repeats AS (
  SELECT r, count(DISTINCT p) AS n
  FROM (SELECT r, unnest(range(k, k + 5)) AS p FROM (SELECT r, k, count(*) OVER (PARTITION BY r, e) AS m FROM windows) WHERE m > 1)
  GROUP BY r
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, {SOLID}) GROUP BY r
), counted AS (
  SELECT r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         [CAST(c AS DOUBLE) FOR c IN [{_COUNTS}]] AS classes,
         list_transform(words, lambda x: CAST(len(list_filter(w, lambda y: lower(y) = x)) AS DOUBLE)) AS listed
  FROM d LEFT JOIN lists USING (lang)
), rows AS (
  SELECT counted.*, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
         n_words < 10 OR 100 * coalesce(repeats.n, 0) > 20 * n_words AS base_failed,
         list_append(classes, CAST(greatest(word_chars - list_sum(classes), 0) AS DOUBLE)) AS p,
         list_append(listed, CAST(n_words - list_sum(listed) AS DOUBLE)) AS q
  FROM counted LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)
), refs AS (
  SELECT lang, list(s ORDER BY i) FILTER (kind = 'p') AS rp, list(s ORDER BY i) FILTER (kind = 'q') AS rq
  FROM (
    SELECT lang, kind, i, sum(v) AS s FROM (
      SELECT lang, 'p' AS kind, unnest(p) AS v, unnest(range(len(p))) AS i FROM rows WHERE listed IS NOT NULL AND NOT base_failed
      UNION ALL
      SELECT lang, 'q', unnest(q), unnest(range(len(q))) FROM rows WHERE listed IS NOT NULL AND NOT base_failed
    ) GROUP BY lang, kind, i
  ) GROUP BY lang
), limits AS (
  SELECT lang, rp, rq, {WORD_SHARE} * nullif({_js(_NONE, "rq")}, 0) AS word_limit FROM refs
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND NOT coalesce(word_chars >= {MIN_CHARS} AND {_js("p", "rp")} > {MAX_CLASS_DISTANCE}, FALSE)
       AND NOT coalesce(n_words >= {MIN_WORDS} AND {_js("q", "rq")} > word_limit, FALSE) AS kept
FROM rows LEFT JOIN limits USING (lang)
"""

HARD_NEGATIVES = """
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
s AS (
    SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
           CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
    FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
),
p AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
),
n AS (
    SELECT p.*, s.id AS negative_id, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS place
    FROM p JOIN s ON p.anchor_id = s.anchor_id
    WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE place <= 10
"""
