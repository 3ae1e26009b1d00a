"""The queries that plain SQL can express, for DuckDB."""

from ledgerloom.llm.common import SPACE, WORD
from ledgerloom.llm.quality_rules import BOILERPLATE, NO_SYMBOLS, SENTENCE_END

QUALITY_RULES = f"""
WITH d AS (
    SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT k, doc_id, t,
        list_filter(regexp_split_to_array(t, '{SPACE}'), lambda x: x <> '') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
    FROM d
), win AS (
    SELECT k, p, count(*) OVER (PARTITION BY k, list_slice(words, p, p + 4)) AS n
    FROM (SELECT k, words, unnest(range(1, len(words) - 3)) AS p FROM w)
), rep AS (
    SELECT k, count(DISTINCT q) AS n_repeat_words
    FROM (SELECT k, unnest(range(p, p + 5)) AS q FROM win WHERE n > 1) GROUP BY k
), line AS (
    SELECT k, l, len(list_filter(regexp_split_to_array(l, '{SPACE}'), lambda x: x <> '')) AS n,
        length(regexp_replace(l, '{NO_SYMBOLS}', '', 'g')) AS marks,
        length(l) - length(replace(l, '!', '')) AS bangs,
        length(l) - length(replace(l, '|', '')) AS pipes
    FROM (SELECT k, unnest(lines) AS l FROM w)
), judged AS (
    SELECT k, l, 100 * marks <= 30 * n AND 100 * bangs <= 50 * n AND 100 * pipes <= 20 * n
        AND (n >= 3 OR regexp_matches(rtrim(l, ' '), '{SENTENCE_END}'))
        AND (n > 30 OR NOT regexp_matches(lower(l), '{BOILERPLATE}')) AS good
    FROM line
), kept AS (
    SELECT k, count(*) AS n_lines, count(*) FILTER (good) AS n_kept_lines,
        sum(length(l)) + count(*) - 1 AS line_chars,
        coalesce(sum(length(l)) FILTER (good) + count(*) FILTER (good) - 1, 0) AS kept_chars
    FROM judged GROUP BY k
), facts AS (
    SELECT k, doc_id, len(words) AS n_words,
        length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars,
        length(regexp_replace(t, '{NO_SYMBOLS}', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words,
        coalesce(n_lines, 0) AS n_lines, coalesce(n_kept_lines, 0) AS n_kept_lines,
        coalesce(line_chars, 0) AS line_chars, coalesce(kept_chars, 0) AS kept_chars
    FROM w LEFT JOIN rep USING (k) LEFT JOIN kept USING (k)
), base AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM facts
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
    CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT base_failed AND 100 * (line_chars - kept_chars) <= 50 * line_chars AS kept,
    CAST(n_lines AS BIGINT) AS n_lines, CAST(n_kept_lines AS BIGINT) AS n_kept_lines,
    CAST(line_chars AS BIGINT) AS line_chars, CAST(kept_chars AS BIGINT) AS kept_chars
FROM base
"""

# terms of a text: maximal runs of ASCII letters, digits and what is not ASCII (a fixed value)
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LEXICAL_SEARCH = f"""
WITH d AS (
    SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS terms
    FROM documents
), full_docs AS (
    SELECT k, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM d WHERE len(terms) > 0
), sums AS (
    SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS all_terms FROM full_docs
), q AS (
    SELECT i, item_id, term, count(*) AS times
    FROM (
        SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term
        FROM benchmark
    ) GROUP BY ALL
), tf AS (
    SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM full_docs)
    WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM tf, sums GROUP BY term, docs
), x AS (
    SELECT k, doc_id, term,
        w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // all_terms))) AS x
    FROM tf JOIN w USING (term) JOIN full_docs USING (k), sums
), scored AS (
    SELECT i, item_id, k, doc_id, CAST(sum(times * x) AS BIGINT) AS score
    FROM q JOIN x USING (term) GROUP BY i, item_id, k, doc_id HAVING sum(times * x) > 0
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (
    SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored
) WHERE rank <= 20
"""

JACCARD_JOIN = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '{SPACE}'), lambda x: x <> '') AS words
    FROM documents
), s AS (
    SELECT row_number() OVER () AS k, doc_id,
        CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(
            range(1, len(words) - 1), lambda i: array_to_string(list_slice(words, i, i + 2), ' ')))
        END AS shingles
    FROM d
), e AS (SELECT k, unnest(shingles) AS shingle FROM s), sizes AS (
    SELECT k, doc_id, CAST(len(shingles) AS BIGINT) AS n FROM s
), links AS MATERIALIZED (
    SELECT a.k AS a, b.k AS b
    FROM e AS a JOIN e AS b USING (shingle) JOIN sizes AS x ON x.k = a.k JOIN sizes AS y ON y.k = b.k
    WHERE a.k <> b.k GROUP BY a.k, b.k, x.n, y.n
    HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reached(k, spot) AS (
    SELECT k, k FROM sizes UNION SELECT reached.k, links.b FROM reached JOIN links ON links.a = reached.spot
)
SELECT sizes.doc_id, sizes.n AS n_shingles, min(other.doc_id) AS component_id
FROM sizes JOIN reached USING (k) JOIN sizes AS other ON other.k = reached.spot
GROUP BY sizes.k, sizes.doc_id, sizes.n
"""
