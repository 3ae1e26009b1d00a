"""Periodic runs of words, found by uniting suffix classes by decreasing common prefix.

A run is a stretch of words with a smallest period q, long enough against q, that no
neighbouring word extends keeping q. Its first position s and s + q have a longest
common prefix of exactly ``length - q`` words. So:

1. suffixes of a text are sorted by prefix doubling (a group of equal prefixes is
   sorted on only while it has two members), and the common prefixes of neighbours
   in that order are read off the ranks of the doubling steps;
2. neighbours are united in order of decreasing common prefix, as Kruskal's method
   unites trees. Each class of the union-find holds its positions in order; uniting
   two puts the smaller set into the larger one;
3. two positions that become adjacent when sets of common prefix l meet, at a
   distance q of at most l, seed a run of period q: q is its smallest period, or a
   position between them would have been in the set already. The seed at the run's
   first word is kept; the others repeat it.

Texts are handled whole, one after the other within a task; no shuffle takes place.
A task holds the ranks of some 2^18 words at a time, or of one text if it is longer.

Null and empty texts have no words and no runs; a text shorter than the least
length has none. Repeated rows and null ids give a row each. Of runs that are
equally strong the first start, then the smallest period counts. An empty table
gives no rows. Extra columns of the table do not matter.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, words_of

PIECE_WORDS = 1 << 18
RUN = "struct<start: bigint, length: bigint, period: bigint>"
Words = list[bytes]


def doubled_ranks(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of ``keys`` in order, and their ranks by the first 1, 2, 4, .. keys.

    Every text in ``keys`` ends in a key of its own, which no other position has.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    slots = np.arange(n)
    rank = np.empty(n, dtype=np.int64)
    ordered, levels, step = keys[order], [], 1
    while True:
        # of each group of equal prefixes, the first slot is the rank of all
        fresh = np.append(True, ordered[1:] != ordered[:-1])
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        levels.append(rank.astype(np.int32))
        slots = slots[~(fresh & np.append(fresh[1:], True))]
        if not len(slots):
            return order, levels
        at = order[slots]
        both = rank[at] * n + rank[at + step]
        sort = np.argsort(both, kind="stable")
        order[slots] = at[sort]
        ordered, step = both[sort], 2 * step


def common_prefixes(
    order: np.ndarray, levels: list[np.ndarray], least: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in suffix order that share ``least`` keys or more, and how many."""
    known = min(least.bit_length() - 1, len(levels) - 1)
    rank = levels[known]
    at = np.flatnonzero(rank[order[1:]] == rank[order[:-1]])
    left, right = order[at].copy(), order[at + 1].copy()
    shared = np.zeros(len(at), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        more = np.where(levels[k][left + shared] == levels[k][right + shared], 1 << k, 0)
        shared += more
    enough = shared >= least
    return left[enough], right[enough], shared[enough]


def unite(
    left: np.ndarray, right: np.ndarray, shared: np.ndarray
) -> Iterator[tuple[int, int, int]]:
    """Positions that become adjacent in a class, with the common prefix they have."""
    up: dict[int, int] = {}
    positions: dict[int, list[int]] = {}

    def top(x: int) -> int:
        while (above := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(above, above)
        return x

    falling = np.argsort(-shared, kind="stable")
    for a, b, l in zip(
        left[falling].tolist(), right[falling].tolist(), shared[falling].tolist(), strict=True
    ):
        a, b = top(a), top(b)
        large, small = positions.pop(a, None) or [a], positions.pop(b, None) or [b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        # between two neighbours of the small set, only the nearest of the large one count
        last = -1
        for i, x in enumerate(small):
            k = bisect(large, x)
            if k and large[k - 1] > last:
                yield large[k - 1], x, l
            if k < len(large) and (i + 1 == len(small) or large[k] < small[i + 1]):
                yield x, large[k], l
            last = x
        if 8 * len(small) > len(large):
            large = sorted(large + small)
        else:
            for x in small:
                insort(large, x)
        up[b] = a
        positions[a] = large


def runs_of(texts: list[Words], min_length: int, min_exponent: int) -> list[list[tuple]]:
    """``(start, length, period)`` of every text's runs, by start, then period."""
    found: list[list[tuple]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not sizes.sum():
        return found
    # a key for each word of a text, and before and after each text one of its own
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = [np.fromiter(map(number.__getitem__, t), dtype=np.int64, count=len(t)) for t in texts]
    starts = np.cumsum(sizes + 1) - sizes
    keys = np.full(int(sizes.sum()) + len(texts) + 1, -1, dtype=np.int64)
    for i, (at, own) in enumerate(zip(starts.tolist(), ids, strict=True)):
        keys[at : at + len(own)] = own + i * len(number)
    edges = np.flatnonzero(keys < 0)
    keys[edges] = len(texts) * len(number) + np.arange(len(edges))

    least = min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, min_length + 1))
    left, right, shared = common_prefixes(*doubled_ranks(keys), max(1, least))
    for p, q, l in unite(left, right, shared):
        period = q - p
        if (
            l >= (min_exponent - 1) * period
            and period + l >= min_length
            and keys[p - 1] != keys[q - 1]
        ):
            text = int(np.searchsorted(starts, p, side="right")) - 1
            found[text].append((p - int(starts[text]), period + l, period))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: Words, runs: list[tuple]) -> bytes:
    """The words that no run repeats, one space apart: of each run the first period stays."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def repeated_tail(doc_id, words: Words) -> Words:
    """Words with a tail that repeats itself, for a tenth of the ids: from word
    ``g % n`` on with a period by ``g``, where ``10 * g`` is about the id's crc32.
    A null id has no digits and its words stay."""
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def periodic_runs(
    df: DataFrame,
    min_length: int = 6,
    min_exponent: int = 4,
    rewrite: Callable[[object, Words], Words] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: every run of each whole text, by start,
    then period, and the text without the repetitions.

    A run has ``min_length`` words and ``min_exponent`` periods or more, the latter a
    whole number from 2 on. ``rewrite(id, words)`` may give other words to be used.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has two words and two periods at least")

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, list[Words]]]:
        begin, texts, size = 0, [], 0
        for i, (doc, text) in enumerate(zip(batch.column("doc_id"), batch.column("text"), strict=True)):
            words = words_of(text.as_py())
            if rewrite is not None:
                words = rewrite(doc.as_py(), words)
            if texts and size + len(words) > PIECE_WORDS:
                yield begin, texts
                begin, texts, size = i, [], 0
            texts.append(words)
            size += len(words)
        yield begin, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for begin, texts in pieces(batch):
                found = runs_of(texts, min_length, min_exponent)
                flat = np.array([r for runs in found for r in runs], dtype=np.int64).reshape(-1, 3)
                cuts = np.cumsum([0, *(len(runs) for runs in found)], dtype=np.int32)
                parts = pa.StructArray.from_arrays(
                    [pa.array(flat[:, k].copy()) for k in range(3)], ["start", "length", "period"]
                )
                left = [collapsed(t, runs) for t, runs in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(begin, len(texts)),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(cuts), parts),
                        pa.array(left, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    narrow = id_and_text(df, id_col, text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<{RUN}>, collapsed string"
    )


def run_digests(found: DataFrame) -> DataFrame:
    """Of each text the number of runs, the strongest one (the first of equals) and
    hashes of all runs and of the collapsed text."""
    strongest = F.reduce(
        "runs",
        F.lit(None).cast(RUN),
        lambda best, r: F.when(
            best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r
        ).otherwise(best),
    )
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    return found.withColumn("best", strongest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
