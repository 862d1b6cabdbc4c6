"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from claimcheck.llm.license_scan import GRAM_WORDS, NEAR, NO_WORD, PHRASES, SHARE, TEMPLATES

#: Unsigned crc32 of an expression's text: its bytes, each followed by eight shifts (-1), folded from the left.
CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
    string_split({0}::VARCHAR, ''), lambda c: list_concat([ascii(c)::BIGINT], repeat([-1::BIGINT], 8))))),
    lambda a, b: CASE WHEN b < 0 THEN xor(a >> 1, 3988292384 * (a & 1)) ELSE xor(a, b) END))"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


_LEAF = "sha256({})".format(" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "{0}"))))

MERKLE = f"""
WITH RECURSIVE hashed AS (
    SELECT doc_id, source, {_LEAF.format("text")} AS leaf,
           CASE WHEN {CRC32.format("doc_id")} % 5 = 0 THEN {_LEAF.format(f"translate(text, '{UPPER}', '{LOWER}')")}
                ELSE {_LEAF.format("text")} END AS start
    FROM documents
), leaves AS (
    SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, start) - 1 AS pos,
           count(*) OVER (PARTITION BY source) AS n
    FROM hashed
), nodes (tree, level, pos, n, digest) AS (
    SELECT tree, 0, pos, n, leaf FROM leaves
    UNION ALL
    SELECT tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
    FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 16, n
), tops (tree, level, pos, n, digest) AS (
    SELECT -1, 0, tree, (SELECT count(DISTINCT tree) FROM leaves), digest FROM nodes WHERE n = 1
    UNION ALL
    SELECT -1, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
    FROM tops WHERE n > 1 GROUP BY level, pos // 16, n
), steps AS (
    SELECT *, coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, pos // 16 ORDER BY pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
           coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, pos // 16 ORDER BY pos
                  ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
    FROM (SELECT * FROM nodes UNION ALL SELECT * FROM tops)
), climb (doc_id, leaf, source_tree, tree, level, pos, folded, proof) AS (
    SELECT doc_id, leaf, tree, tree, 0, pos, start, '' FROM leaves
    UNION ALL
    SELECT c.doc_id, c.leaf, c.source_tree,
           CASE WHEN s.n > 1 THEN c.tree ELSE -1 END,
           CASE WHEN s.n > 1 THEN c.level + 1 ELSE 0 END,
           CASE WHEN s.n > 1 THEN c.pos // 16 ELSE c.source_tree END,
           CASE WHEN s.n > 1 THEN sha256(s.before || c.folded || s.after) ELSE c.folded END,
           CASE WHEN s.n > 1 THEN c.proof || s.before || s.after ELSE c.proof END
    FROM climb c JOIN steps s ON s.tree = c.tree AND s.level = c.level AND s.pos = c.pos
    WHERE s.n > 1 OR c.tree >= 0
)
SELECT c.doc_id, c.leaf, u.digest AS subroot, r.digest AS root, sha256(c.proof) AS proof_sha256,
       c.folded AS folded_root, c.folded = r.digest AS verified
FROM climb c JOIN tops r ON r.n = 1 AND c.tree = -1 AND c.level = r.level AND c.pos = r.pos
JOIN nodes u ON u.tree = c.source_tree AND u.n = 1
"""


def _normal_words(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    return f"list_filter(regexp_split_to_array({lower}, '{NO_WORD}'), lambda w: w <> '')"


_NEXT = [f"coalesce(lead(word, {k}) OVER own, '')" for k in range(1, 4)]
_GRAM = " || ' ' || ".join(["word", *_NEXT[: GRAM_WORDS - 1]])
_PLACES = " UNION ALL ".join(
    f"SELECT row, at_word, '{label}' AS label FROM words4 WHERE starts_with(word || ' ' || next_words || ' ', '{phrase} ')"
    for phrase, label in PHRASES.items()
)
_TEMPLATES = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))

LICENSES = f"""
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, {_normal_words("text")} AS words FROM documents
), each AS (
    SELECT row, unnest(words) AS word, unnest(range(len(words))) AS at_word FROM docs
), words4 AS (
    SELECT row, at_word, word, {" || ' ' || ".join(_NEXT)} AS next_words, {_GRAM} AS gram
    FROM each WINDOW own AS (PARTITION BY row ORDER BY at_word)
), places AS ({_PLACES}
), base AS (
    SELECT row, count(*) AS n_base, min(at_word) AS first_word, max(at_word) AS last_word, list(DISTINCT label) AS labels
    FROM places GROUP BY row
), templates (template, label, text) AS (VALUES {_TEMPLATES}
), split AS (
    SELECT template, label, {_normal_words("text")} AS words FROM templates
), template_words AS (
    SELECT template, label, len(words) AS length, unnest(words) AS word, unnest(range(len(words))) AS at_word FROM split
), template_grams AS (
    SELECT template, label, length, at_word AS t, {_GRAM} AS gram
    FROM template_words WINDOW own AS (PARTITION BY template ORDER BY at_word)
), hits AS (
    SELECT DISTINCT w.row, g.template, g.label, g.length, w.at_word - g.t AS diagonal, g.t
    FROM words4 w JOIN template_grams g ON w.gram = g.gram WHERE g.t + {GRAM_WORDS} <= g.length
), diagonals AS (
    SELECT row, template, diagonal,
           CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) > {NEAR} THEN 1 ELSE 0 END AS new
    FROM (SELECT DISTINCT row, template, diagonal FROM hits)
), numbered AS (
    SELECT row, template, diagonal, sum(new) OVER (PARTITION BY row, template ORDER BY diagonal) AS span FROM diagonals
), spans AS (
    SELECT row, label, template, span, count(DISTINCT t + k) / length::DOUBLE AS share
    FROM hits JOIN numbered USING (row, template, diagonal), range({GRAM_WORDS}) AS offsets (k)
    GROUP BY row, label, template, span, length
), own AS (
    SELECT row, max(share) AS share, list(DISTINCT label) FILTER (WHERE share >= {SHARE}) AS labels,
           count(*) FILTER (WHERE share >= {SHARE}) AS n_spans
    FROM spans GROUP BY row
)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(own.share, 0.0) END AS score, coalesce(own.n_spans, 0) AS n_spans
FROM docs LEFT JOIN base USING (row) LEFT JOIN own USING (row)
"""
