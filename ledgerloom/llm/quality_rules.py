"""Line-first quality rules, in built-in column functions alone.

Every line is judged by itself: by its punctuation, as navigation and as
boilerplate. Lines that fail are removed, and a document that loses too much of
its text by this is rejected. Document-level facts (words, symbols, repeated
lines, words in repeated five-word windows) are found in the same pass.

Nothing is shuffled: a text is turned into arrays within its own row. Repeated
windows are found by their 64-bit hashes (two different windows of one text
share a hash with a probability of about n * n / 2**65); only a text that has a
repeated window pays for the sort that finds the positions.

Null text is a text without words; a text without words has zero facts, fails
the base rules and is not kept. Repeated rows are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACE, WORD

# --- fixed values: what counts as a symbol, a sentence end, a boilerplate phrase
NO_SYMBOLS = "[^#*$%&|<>]+"
SENTENCE_END = r"[.!?:;,…”»)\]]$"
BOILERPLATE = (
    r"all rights reserved|copyright \(c\)|licensed under|released under|terms of use|"
    r"terms of service|privacy policy|cookie|javascript|sign up|log in|click here|"
    r"read more|share this|subscribe|skip to content|powered by"
)

WINDOW = 5


def line_rule(
    max_symbols: int = 30,
    max_bangs: int = 50,
    max_pipes: int = 20,
    min_words: int = 3,
    boilerplate_words: int = 30,
) -> str:
    """SQL condition that ``x``, a line with its counts, is a line to keep.

    punctuation: at most ``max_symbols`` symbols and ``max_bangs`` exclamation
    marks per hundred words
    navigation: at most ``max_pipes`` separators per hundred words; a line of
    fewer than ``min_words`` words needs a sentence end
    boilerplate: no stock phrase in a line of at most ``boilerplate_words`` words
    """
    return f"""
        100 * x.marks <= {max_symbols} * x.n
        AND 100 * x.bangs <= {max_bangs} * x.n
        AND 100 * x.pipes <= {max_pipes} * x.n
        AND (x.n >= {min_words} OR regexp_like(rtrim(x.line), r'{SENTENCE_END}'))
        AND (x.n > {boilerplate_words} OR NOT regexp_like(lower(x.line), r'{BOILERPLATE}'))
    """


# a line and what the rules count in it
COUNTED = f"""struct(
    l AS line,
    size(filter(split(l, r'{SPACE}'), w -> w != '')) AS n,
    length(regexp_replace(l, r'{NO_SYMBOLS}', '')) AS marks,
    length(l) - length(replace(l, '!', '')) AS bangs,
    length(l) - length(replace(l, '|', '')) AS pipes)"""


def quality_rules(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 10,
    max_repeated: int = 20,
    max_lost: int = 50,
    **rules,
) -> DataFrame:
    """Facts, verdict and cleaned text of every row, in the rows' own partitions.

    ``max_repeated`` is the largest share, in percent, of words that lie in
    repeated windows; ``max_lost`` the largest share, in percent, of a text's line
    characters that may be lost to the line rules; ``rules`` go to ``line_rule``.
    """
    arrays = df.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    ).selectExpr(
        "doc_id",
        "_text",
        f"filter(split(_text, r'{SPACE}'), w -> w != '') AS _words",
        f"filter(split(_text, '\\n'), l -> regexp_like(l, r'{WORD}')) AS _lines",
    )
    hashed = arrays.selectExpr(
        "doc_id",
        "CAST(size(_words) AS BIGINT) AS n_words",
        f"CAST(length(regexp_replace(_text, r'{SPACE}', '')) AS BIGINT) AS word_chars",
        f"CAST(length(regexp_replace(_text, r'{NO_SYMBOLS}', '')) AS BIGINT) AS n_symbols",
        "CAST(size(_lines) - size(array_distinct(_lines)) AS BIGINT) AS n_dup_lines",
        "transform(_words, w -> xxhash64(w)) AS _hashes",
        "_lines",
        f"transform(filter(transform(_lines, l -> {COUNTED}), x -> {line_rule(**rules)}),"
        " x -> x.line) AS _good",
    )
    ahead = ", ".join(f"_hashes[i + {k}]" for k in range(1, WINDOW))
    windows = hashed.selectExpr(
        "*",
        f"""CASE WHEN n_words < {WINDOW} THEN CAST(array() AS ARRAY<BIGINT>)
            ELSE transform(slice(_hashes, 1, CAST(n_words AS INT) - {WINDOW - 1}),
                           (h, i) -> xxhash64(h, {ahead})) END AS _windows""",
    ).drop("_hashes")
    ordered = windows.selectExpr(
        "*",
        """CASE WHEN size(array_distinct(_windows)) < size(_windows)
           THEN sort_array(transform(_windows, (h, i) -> struct(h AS h, i AS i))) END AS _sorted""",
    ).drop("_windows")
    starts = ordered.selectExpr(
        "*",
        """sort_array(transform(filter(_sorted, (x, k) ->
               (k > 0 AND get(_sorted, k - 1).h = x.h) OR get(_sorted, k + 1).h = x.h),
           x -> x.i)) AS _starts""",
    ).drop("_sorted")
    facts = starts.selectExpr(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        # each start covers its window up to the next start
        f"""coalesce(aggregate(transform(_starts, (p, k) ->
                least({WINDOW}, coalesce(get(_starts, k + 1) - p, {WINDOW}))),
            0L, (a, x) -> a + x), 0L) AS n_repeat_words""",
        "_lines",
        "concat_ws('\\n', _good) AS clean_text",
        "CAST(size(_lines) AS BIGINT) AS n_lines",
        "CAST(size(_good) AS BIGINT) AS n_kept_lines",
    )
    measured = facts.selectExpr(
        "*",
        """CAST(aggregate(transform(_lines, l -> length(l)), 0L, (a, x) -> a + x)
           + greatest(n_lines - 1, 0) AS BIGINT) AS line_chars""",
        "CAST(length(clean_text) AS BIGINT) AS kept_chars",
    ).drop("_lines")
    # a filter on the verdict must not be pushed below this, where it would repeat
    # the work of every array within the next one; it stops at a generator
    one = measured.select(F.inline(F.array(F.struct(*measured.columns))))
    judged = one.selectExpr(
        "*",
        f"n_words < {min_words} OR 100 * n_repeat_words > {max_repeated} * n_words AS base_failed",
    )
    return judged.selectExpr(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        f"NOT base_failed AND 100 * (line_chars - kept_chars) <= {max_lost} * line_chars AS kept",
        "n_lines",
        "n_kept_lines",
        "line_chars",
        "kept_chars",
        "clean_text",
    )
