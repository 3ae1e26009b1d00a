"""Language-model scores of whole texts, learned from the rows not held out.

The model is prediction by partial matching (see ``ppm``). One pass counts every
string of a symbol and its context, in the training rows and in all; no string is left
out. The counts stay a table, dealt out by the latest symbols of the context, and of
each string the code length of its symbol is worked out there. The driver sees the
strings of ``SHALLOW + 1`` symbols alone (at most 2^24, by far fewer in any text).

A second pass scores: code lengths of the most frequent strings (at most ``frequent``)
go out with the tasks, the other strings of a text are joined with the table. So do
the words of the base score, a smoothed unigram model over words: the most frequent (at
most ``common``, so no word is a hot key) go out, others are joined by their 64-bit
hashes (the checksum of a short word, XXH64 of a long one). What goes out changes no result. A text's score, its counts, strings and words travel in one shuffle.

Null and empty texts hold the end alone. Repeated rows are scored one by one. If
nothing is left to learn from, the base score is 0 and a symbol is one of 256.
An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, remainder_of
from ledgerloom.llm.ppm import (
    END,
    LENGTH,
    ORDER,
    SHALLOW,
    STRING as STRING_BITS,
    Level,
    found_in,
    kept_bits,
    levels_of,
    log_probabilities,
    string_keys,
    sums_of,
)
from ledgerloom.llm.words import BLANKS, CRC64, LONG_WORD, crc_of, word_bounds, words_by_text
from ledgerloom.storage import cut_lineage

PORTION = 1 << 19  # characters of text looked at together
NAMES = ["row", "kind", "key", "times", "doc_id", "score", "base", "n_tokens", "known"]
WORD, STRING, TEXT = range(3)  # what a count is of
GROUPS = 1 << 18  # strings worked out together, at least
MOST_WORDS = 1 << 18  # different words counted together
COUNT_ROWS = 1 << 17  # counts handed over together
BETWEEN = bytes(c == END or c in BLANKS for c in range(256))


def _portions(batch: pa.RecordBatch):
    """Ids and texts in portions of some characters."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(),
                            strict=True):
        ids.append(doc_id)
        texts.append(text)
        size += len(text)
        if size >= PORTION:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _key_counts(kind: int, keys, learned, every) -> pa.RecordBatch:
    columns = [pa.array(np.asarray(x, dtype=np.int64)) for x in (keys, learned, every)]
    kinds = pa.array(np.full(len(columns[0]), kind, dtype=np.int32))
    return pa.RecordBatch.from_arrays([kinds, *columns], ["kind", "key", "n", "every"])


class Sums:
    """Counts by key, added up whenever many have come together."""

    def __init__(self, most: int = 1_500_000) -> None:
        self.most, self.held = most, 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.held += len(keys)

    def taken(self, last: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """The sums, if there are too many to go on with or these are the last."""
        if not last and 5 * self.held <= 7 * self.most:
            return None
        columns = [np.concatenate([np.zeros(0, dtype=np.int64), *(p[k] for p in self.parts)]) for k in (0, 1)]
        self.parts = []
        sums = sums_of(columns.pop(0), columns.pop(), "stable")  # nothing else holds them
        more = not last and len(sums[0]) <= self.most
        self.parts = [sums] if more else []
        self.held = len(sums[0]) if more else 0
        return None if more else sums


def word_hash(word: bytes) -> int:
    value = xxhash.xxh64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


@dataclass
class Portion:
    """Texts as a stream of symbols (see ``ppm``), and their words; of text i those from
    ``cuts[i]`` to ``cuts[i + 1]``."""

    data: bytes
    symbols: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    cuts: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Portion:
        parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        data = b"\xff".join([b"", *parts, b""])  # no byte of UTF-8
        blank = np.frombuffer(data.translate(BETWEEN), dtype=bool)
        starts, ends = word_bounds(blank)
        portion = cls(data, np.frombuffer(bytearray(data), dtype=np.uint8), starts, ends,
                      words_by_text(starts, parts))
        text_of = portion.text_of
        kept = ~blank | (portion.symbols == END)
        # one space between words
        gaps = ends[:-1][text_of[1:] == text_of[:-1]]
        portion.symbols[gaps], kept[gaps] = 0x20, True
        portion.symbols = portion.symbols[kept]
        return portion

    @property
    def text_of(self) -> np.ndarray:
        """The number of every word's text."""
        return np.repeat(np.arange(len(self.cuts) - 1), np.diff(self.cuts))

    def words(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        sizes = self.ends - self.starts
        long = sizes >= LONG_WORD
        keys = crc_of(np.frombuffer(self.data, dtype=np.uint8), self.starts,
                      np.where(long, 0, sizes), CRC64).view(np.int64)
        for k in np.flatnonzero(long).tolist():
            keys[k] = word_hash(self.data[self.starts[k] : self.ends[k]])
        return keys


def counted(narrow: DataFrame, order: int, modulus: int, held: int) -> DataFrame:
    """``kind, key, n, every``: training occurrences of words, strings and texts, and of
    strings those in all rows."""
    both = 1 << 32  # a sum holds all occurrences there, training ones below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, strings, texts_seen = Sums(MOST_WORDS), Sums(), 0

        def rows_of(kind: int, sums) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(sums[0]), COUNT_ROWS):
                keys, n = (x[at : at + COUNT_ROWS] for x in sums)
                if kind == STRING:
                    yield _key_counts(kind, keys, n & both - 1, n >> 32)
                else:
                    yield _key_counts(kind, keys, n, np.zeros(len(n)))

        for batch in batches:
            for ids, texts in _portions(batch):
                out = [remainder_of(i, modulus) == held for i in ids]
                learned = [t for t, o in zip(texts, out, strict=True) if not o]
                others = [t for t, o in zip(texts, out, strict=True) if o]
                texts_seen += len(learned)
                for own, weight in ((learned, both + 1), (others, both)):
                    if own:
                        portion = Portion.of(own)
                        keys, times = sums_of(string_keys(portion.symbols, order))
                        strings.add(keys, times * weight)
                        if own is learned:
                            words.add(*sums_of(portion.words()))
                for kind, counts in ((WORD, words), (STRING, strings)):
                    sums = counts.taken()
                    if sums is not None:
                        yield from rows_of(kind, sums)
                    sums = None
        yield from rows_of(WORD, words.taken(last=True))
        yield from rows_of(STRING, strings.taken(last=True))
        yield _key_counts(TEXT, [0], [texts_seen], [0])

    parts = narrow.mapInArrow(run, "kind int, key long, n long, every long")
    return parts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))


def _arrays(df: DataFrame, *types: str) -> list[np.ndarray]:
    """The columns of a frame of bounded size."""
    table = df.toArrow()
    return [c.to_numpy().astype(t) for c, t in zip(table.columns, types, strict=True)]


def shallow_levels(strings: DataFrame, order: int) -> list[Level]:
    """The levels of contexts of at most ``SHALLOW`` symbols."""
    depth, key = min(SHALLOW, order), F.col("key")
    length = F.least(F.shiftright(key, LENGTH), F.lit(depth))
    short = key.bitwiseAND(F.lit(kept_bits(depth))).bitwiseOR(F.shiftleft(length, LENGTH))
    few = strings.where("n > 0").groupBy(short.alias("key")).agg(F.sum("n").alias("n"))
    return levels_of(*_arrays(few, "int64", "int64"), range(depth + 1), [])


def code_lengths(strings: DataFrame, order: int, shallow: list[Level]) -> DataFrame:
    """``key, every, value``: of every string the log10 probability of its symbol."""
    shared = strings.sparkSession.sparkContext.broadcast(shallow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []

        def done(columns: list[np.ndarray]) -> pa.RecordBatch:
            _, key, n, every = columns
            value = log_probabilities(key, n, order, shared.value)
            return pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(every), pa.array(value)], ["key", "every", "value"]
            )

        for batch in batches:
            waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(w[0]) for w in waiting) < GROUPS:
                continue
            columns = [np.concatenate(c) for c in zip(*waiting, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last group may go on
            if cut:
                yield done([c[:cut] for c in columns])
            waiting = [[c[cut:] for c in columns]]
        if waiting:
            yield done([np.concatenate(c) for c in zip(*waiting, strict=True)])

    latest = F.shiftright(F.col("key").bitwiseAND(F.lit(STRING_BITS)), LENGTH - 8 * (SHALLOW + 1))
    groups = strings.select(latest.alias("latest"), "key", "n", "every").repartition("latest")
    return groups.sortWithinPartitions("latest").mapInArrow(
        run, "key long, every long, value double"
    )


def _step(times: str) -> Column:
    """Occurrences on a scale of some hundred steps."""
    return F.floor(F.log2(times) * 8)


def _least_step(keys: DataFrame, times: str, frequent: int) -> float:
    """Step of occurrences from which on there are at most ``frequent`` keys."""
    step = _step(times).alias("step")
    sizes = keys.groupBy(step).agg(F.count(F.lit(1)).alias("c")).collect()
    least, many = math.inf, 0
    for of, c in sorted(sizes, reverse=True):
        many += c
        if many > frequent:
            break
        least = of
    return least


def lm_scores(
    df: DataFrame,
    order: int = 6,
    frequent: int = 1 << 21,
    common: int = 1 << 17,
    modulus: int = 7,
    held: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Base score and model score of every row, both log10; ``held`` is the
    remainder of the crc32 of the id, modulo ``modulus``, that is not learned from."""
    if not 0 <= order <= ORDER:
        raise ValueError(f"order has to be 0 to {ORDER}")
    spark = df.sparkSession
    narrow = id_and_text(df, id_col, text_col)
    counts = cut_lineage(counted(narrow, order, modulus, held))
    strings = counts.where(F.col("kind") == STRING).drop("kind")
    lengths = cut_lineage(code_lengths(strings, order, shallow_levels(strings, order)))
    least_string = _least_step(lengths, "every", frequent)
    keys, values = _arrays(
        lengths.where(_step("every") >= F.lit(least_string)).select("key", "value"), "int64", "float64"
    )
    by_key = np.argsort(keys)
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    totals = {k: (v, n or 0) for k, v, n in counts.groupBy("kind").agg(
        F.count(F.lit(1)), F.sum("n")).collect()}
    texts = totals.get(TEXT, (0, 0))[1]
    tokens = totals.get(WORD, (0, 0))[1] + texts
    kinds = totals.get(WORD, (0, 0))[0] + (texts > 0)
    least_word = _least_step(words, "n", common)
    often = _arrays(words.where(_step("n") >= F.lit(least_word)), "int64", "int64")
    norm = np.log10(tokens + kinds + 1)
    own_end = float(np.log10(texts + 1) - norm)
    by_word = np.argsort(often[0])
    shared = spark.sparkContext.broadcast(
        (keys[by_key], values[by_key], often[0][by_word], np.log10(often[1][by_word] + 1) - norm)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_keys, own_values, known, known_values = shared.value
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(),
                     batch.schema.field("doc_id").type,
                     pa.float64(), pa.float64(), pa.int64(), pa.int64())

            def joined(row, kind: int, key, times) -> pa.RecordBatch:
                n = len(row)
                return pa.RecordBatch.from_arrays(
                    [pa.array(row, types[0]), pa.array(np.full(n, kind, dtype=np.int32)),
                     pa.array(key, types[2]), pa.array(times, types[3]),
                     *(pa.nulls(n, t) for t in types[4:])], NAMES,
                )

            for ids, texts_of in _portions(batch):
                portion, many, named = Portion.of(texts_of), len(texts_of), []
                for doc_id, text in zip(ids, texts_of, strict=True):
                    # rows are told apart by what they hold, equal ones by their number
                    name = xxhash.xxh64_intdigest(f"{doc_id}\x00{text}".encode("utf-8", "replace"))
                    seen[name] += 1
                    named.append(xxhash.xxh64_intdigest(f"{name} {task} {seen[name]}") - (1 << 63))
                named = np.array(named, dtype=np.int64)
                ends = np.flatnonzero(portion.symbols == END)  # one before each text, and the last
                found, of = np.unique(string_keys(portion.symbols, order), return_inverse=True)
                at, hit = found_in(own_keys, found)
                value = np.zeros(len(found))
                value[hit] = own_values[at[hit]]
                score = np.add.reduceat(value[of], ends[:-1])
                words_met, text_of = portion.words(), portion.text_of
                at, often_met = found_in(known, words_met)
                own = text_of[often_met]
                base = own_end + np.bincount(own, known_values[at[often_met]], minlength=many)
                hits = int(texts > 0) + np.bincount(own, minlength=many)
                columns = (named, np.full(many, TEXT, dtype=np.int32), named, np.zeros(many, dtype=np.int32),
                           ids, score, base, np.diff(portion.cuts) + 1, hits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], NAMES
                )
                words_met, text_of = words_met[~often_met], text_of[~often_met]
                by_text = np.lexsort((words_met, text_of))
                words_met, text_of = words_met[by_text], text_of[by_text]
                other = (words_met[1:] != words_met[:-1]) | (text_of[1:] != text_of[:-1])
                first = np.flatnonzero(np.append(len(words_met) > 0, other))
                yield joined(named[text_of[first]], WORD, words_met[first],
                             np.diff(np.append(first, len(words_met))).astype(np.int32))
                rest = np.flatnonzero(~hit[of])
                text_of = np.searchsorted(ends, rest, side="right") - 1
                yield joined(named[text_of], STRING, found[of[rest]],
                             np.ones(len(rest), dtype=np.int32))

    kind = narrow.schema["doc_id"].dataType.simpleString()
    parts = narrow.mapInArrow(
        run,
        f"row long, kind int, key long, times int, doc_id {kind}, score double, base double, "
        "n_tokens long, known long",
    )
    rare_words = words.where(_step("n") < F.lit(least_word)).select(
        F.lit(WORD).alias("kind"), "key", "n", (F.log10(F.col("n") + 1) - float(norm)).alias("value")
    )
    rare_strings = lengths.where(_step("every") < F.lit(least_string)).select(
        F.lit(STRING).alias("kind"), "key", F.lit(None).cast("long").alias("n"), "value"
    )
    met = parts.join(rare_words.unionAll(rare_strings), ["kind", "key"], "left")
    is_word, is_string = F.col("kind") == WORD, F.col("kind") == STRING
    of_word = F.coalesce("value", F.lit(-float(norm)))  # never seen in training
    summed = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("score").alias("score"),
        F.max("n_tokens").alias("n_tokens"),
        F.max("base").alias("base"),
        F.max("known").alias("known"),
        F.sum(F.when(is_word, F.col("times") * of_word)).alias("rare_base"),
        F.sum(F.when(is_word & (F.col("n") > 0), F.col("times"))).alias("rare_known"),
        F.sum(F.when(is_string, F.col("times") * F.col("value"))).alias("rare_score"),
    )
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    return summed.select(
        "doc_id",
        F.coalesce(remainder == held, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
