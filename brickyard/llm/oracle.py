"""DuckDB SQL of the training-data queries whose whole result SQL can give."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"

_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(_FIELD.format(f) for f in fields) + ")"


OP11_MERKLE = f"""
WITH RECURSIVE bits AS (SELECT doc_id, source, {_leaf('text')} AS leaf,
    CASE WHEN text IS NOT NULL THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS lowered,
    list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(k AS UBIGINT) FOR k IN range(8)]),
        lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS UBIGINT) ELSE CAST(0 AS UBIGINT) END))) AS crc
  FROM documents),
groups AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, n, count(*) OVER () AS trees
  FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)),
leaves AS (SELECT b.doc_id, b.leaf, g.tree, g.n, g.trees, row_number() OVER (PARTITION BY g.tree ORDER BY b.doc_id NULLS FIRST, b.leaf) - 1 AS pos,
    CASE WHEN xor(crc, CAST(4294967295 AS UBIGINT)) % 5 = 0 AND lowered IS NOT NULL THEN lowered ELSE leaf END AS changed
  FROM bits b JOIN groups g ON b.source IS NOT DISTINCT FROM g.source),
up AS (SELECT tree, 0 AS level, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, level, pos // 16),
tops AS (SELECT tree, h FROM up WHERE n = 1),
over_tops AS (SELECT 0 AS level, t.tree AS pos, g.trees AS n, t.h FROM tops t JOIN groups g USING (tree)
  UNION ALL
  SELECT level + 1, pos // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY pos)) FROM over_tops WHERE n > 1 GROUP BY level, pos // 16),
sides AS (SELECT tree, level, pos, n, coalesce(string_agg(h, '' ) OVER before, '') AS l, coalesce(string_agg(h, '') OVER behind, '') AS r FROM up WHERE n > 1
  WINDOW before AS (PARTITION BY tree, level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         behind AS (PARTITION BY tree, level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
top_sides AS (SELECT level, pos, coalesce(string_agg(h, '') OVER before, '') AS l, coalesce(string_agg(h, '') OVER behind, '') AS r FROM over_tops WHERE n > 1
  WINDOW before AS (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         behind AS (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
walk AS (SELECT tree, pos AS row, doc_id, leaf, 0 AS level, pos, changed AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT w.tree, w.row, w.doc_id, w.leaf, w.level + 1, w.pos // 16, sha256(s.l || w.h || s.r), w.proof || s.l || s.r
  FROM walk w JOIN sides s ON s.tree = w.tree AND s.level = w.level AND s.pos = w.pos),
grown AS (SELECT tree, row, doc_id, leaf, h, proof FROM walk QUALIFY level = max(level) OVER (PARTITION BY tree, row)),
top_walk AS (SELECT tree, row, doc_id, leaf, 0 AS level, tree AS pos, h, proof FROM grown
  UNION ALL
  SELECT w.tree, w.row, w.doc_id, w.leaf, w.level + 1, w.pos // 16, sha256(s.l || w.h || s.r), w.proof || s.l || s.r
  FROM top_walk w JOIN top_sides s ON s.level = w.level AND s.pos = w.pos),
ends AS (SELECT * FROM top_walk QUALIFY level = max(level) OVER (PARTITION BY tree, row)),
root AS (SELECT h AS root FROM over_tops WHERE n = 1)
SELECT e.doc_id, e.leaf, t.h AS subroot, root.root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = root.root AS verified
FROM ends e JOIN tops t USING (tree), root
"""


def op12_lines(least_docs: int, share: float, symbol_words: int, least_words: int, most_repeated: int, least_left: int) -> str:
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id AS id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS words FROM docs),
each AS (SELECT rid, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM w),
five AS (SELECT rid, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d, lead(a, 4) OVER o AS e FROM each WINDOW o AS (PARTITION BY rid ORDER BY i)),
seen AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c, d, e) AS n FROM five WHERE e IS NOT NULL),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM seen WHERE n > 1) GROUP BY rid),
raw AS (SELECT rid, id, host, unnest(string_split(t, chr(10))) AS line FROM docs),
lines AS (SELECT rid, id, host, line, lower(trim(regexp_replace(line, '{_SPACE}', ' ', 'g'))) AS norm, len(regexp_extract_all(line, '{_WORD}')) AS words,
    len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols FROM raw WHERE regexp_matches(line, '{_WORD}')),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY rid),
own AS (SELECT DISTINCT rid, id, host, norm, words FROM lines WHERE symbols * {symbol_words} <= words),
who AS (SELECT rid, host, coalesce('id ' || CAST(id AS VARCHAR), 'row ' || CAST(rid AS VARCHAR)) AS d FROM docs),
hosts AS (SELECT host, count(DISTINCT d) AS all_docs FROM who GROUP BY host),
often AS (SELECT o.host, o.norm FROM own o JOIN who USING (rid) JOIN hosts h ON h.host IS NOT DISTINCT FROM o.host
  GROUP BY o.host, o.norm, h.all_docs HAVING count(DISTINCT d) > greatest({least_docs}, h.all_docs * CAST({share} AS DOUBLE))),
left_over AS (SELECT o.rid, sum(o.words) FILTER (f.norm IS NULL) AS stay, count(f.norm) AS gone FROM own o LEFT JOIN often f ON f.host IS NOT DISTINCT FROM o.host AND f.norm = o.norm GROUP BY o.rid),
m AS (SELECT w.id AS doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(gone, 0) AS BIGINT) AS n_removed_lines, CAST(coalesce(stay, 0) AS BIGINT) AS words_left
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN left_over USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND words_left * 100 >= n_words * {least_left} AS kept, n_removed_lines, words_left
FROM (SELECT *, n_words < {least_words} OR 100 * n_repeat_words > {most_repeated} * n_words AS base_failed FROM m)
"""


OP13_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
pos AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM pos p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 10
"""
