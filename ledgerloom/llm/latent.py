"""Benchmark decontamination by latent semantic retrieval.

Words are hashed to ``buckets`` and weighted by their inverse document frequency,
counted over all documents. A randomised SVD finds ``rank`` directions of the
TF-IDF passages of all documents and benchmark items. One distributed pass over sparse
rows both counts and sketches: the sketch Y = A'AG alone gives the decomposition, as A'A
has no negative directions (Nystroem), and the weights, not known before the counts, can
be put to it afterwards. The sums have a fixed size. With the directions, a window of a
document becomes a short vector, as the sum of its words' vectors.

Each item is compared, by cosine, with the windows of about its own length; the
items are a given query set that goes to every task in blocks of one length. Windows
that cannot match are not turned into vectors: prefix sums bound, from above and for all
windows and items of a block at once, how many of an item's words a region holds
(the most frequent words count as held), and where the bound allows it they are counted,
in any order. A window that is near enough is a candidate only. A document is reported for an item
if the longest common subsequence of words around the window covers enough of the
item and the item's answer is found in it: the text after an answer mark, or the
last sentence. A nearly complete match needs no answer.

Null texts hold no windows and null items match nothing; an item without words
matches nothing. Repeated rows are reported one by one, repeated items too. An
empty table of either kind gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text
from ledgerloom.llm.words import BLANKS, CRC32, LONG_WORD, crc_of, word_bounds, words_by_text

EDGE = b".,;:!?\"'()[]"
ANSWER = re.compile(r"\banswer\s*:", re.IGNORECASE)
PART_WORDS = 32_768  # words looked at together, or two of the longest windows
WINDOWS = 256  # windows whose words are looked up together
STEP = 6  # words that window lengths and starts are multiples of
FREQUENT = 0.005  # share of all words from which on a bucket counts as held
FAN_IN = 32  # tasks whose sums of the fit are added up first
BLOCK_ROWS = 1_024  # buckets of a partial sum in one row
OVERSAMPLED = 8  # directions of the sketch beyond those kept
BLOCK_ITEMS = 64  # items whose words are counted together
SKETCH_WORDS = 65_536  # words whose passages are summed together
PORTION = 1 << 18  # characters of texts whose words are found together
ORDINARY, PUNCTUATION, BLANK = range(3)
KINDS = bytes(
    PUNCTUATION if c in EDGE else BLANK if c in BLANKS else ORDINARY for c in range(256)
)


def raw_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def terms(text: str | None) -> list[bytes]:
    return stripped(raw_words(text))


def stripped(words: list[bytes]) -> list[bytes]:
    return [w.strip(EDGE) or w for w in words]


def bucket_of(word: bytes, buckets: int) -> int:
    """Bucket of a word, punctuation around it aside."""
    return crc32(word.strip(EDGE) or word) % buckets


class Buckets(dict):
    """Buckets of the words of single texts."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        found = self[word] = bucket_of(word, self.buckets)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


@dataclass
class Text:
    """Words of a text: their buckets, and where they lie in some bytes."""

    buckets: np.ndarray
    data: bytes
    starts: np.ndarray
    ends: np.ndarray

    def terms(self, first: int, last: int) -> list[bytes]:
        """The words from one number to another."""
        first, last = max(0, first), min(last, len(self.starts))
        return stripped(self.data[self.starts[first] : self.ends[last - 1]].split()) if first < last else []


def _found(texts: list[str | None], buckets: int) -> Iterator[Text]:
    parts = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    data = b"\n".join([b"", *parts, b""])
    symbols = np.frombuffer(data, dtype=np.uint8)
    kinds = np.frombuffer(data.translate(KINDS), dtype=np.uint8)
    starts, ends = word_bounds(kinds == BLANK)
    low, high = starts.copy(), ends.copy()
    long = ends - starts >= LONG_WORD
    # punctuation around a word is left aside, unless there is nothing else
    at = np.flatnonzero((kinds[low] == PUNCTUATION) & ~long)
    while len(at):
        low[at] += 1
        at = at[kinds[low[at]] == PUNCTUATION]
    at = np.flatnonzero((kinds[high - 1] == PUNCTUATION) & ~long & (low < high))
    while len(at):
        high[at] -= 1
        at = at[kinds[high[at] - 1] == PUNCTUATION]
    bare = low == high
    low[bare], high[bare] = starts[bare], ends[bare]
    sizes = np.where(long, 0, high - low)
    ids = (crc_of(symbols, low, sizes, CRC32) % buckets).astype(np.int64)
    for k in np.flatnonzero(long).tolist():
        ids[k] = bucket_of(data[starts[k] : ends[k]], buckets)
    cuts = words_by_text(starts, parts)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield Text(ids[a:b], data, starts[a:b], ends[a:b])


def words_found(texts: list[str | None], buckets: int) -> Iterator[Text]:
    """The words of each text, found for many texts at a time."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= PORTION:
            yield from _found(part, buckets)
            part, size = [], 0
    if part:
        yield from _found(part, buckets)


@dataclass
class Item:
    """A benchmark item, ready for verification."""

    item_id: object
    words: list[bytes]
    answer: list[bytes]
    masks: dict[bytes, int] = field(default_factory=dict)
    answer_masks: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for masks, words in ((self.masks, self.words), (self.answer_masks, self.answer)):
            for i, w in enumerate(words):
                masks[w] = masks.get(w, 0) | 1 << i


def answer_of(text: str) -> str:
    marks = list(ANSWER.finditer(text))
    if marks:
        return text[marks[-1].end() :]
    sentences = [s for s in re.split(r"[.!?]\s+|\n", text.strip()) if s.strip()]
    return sentences[-1] if sentences else ""


def common_subsequence(masks: dict[bytes, int], size: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence, all of the item's positions at once."""
    full = (1 << size) - 1
    open_ = full
    for w in words:
        m = masks.get(w)
        if m:
            met = open_ & m
            open_ = ((open_ + met) | (open_ - met)) & full
    return size - open_.bit_count()


def scale_of(n: int) -> int:
    """Window length for an item of ``n`` words: 2, 3, 4, 6, 8, 12, 16, .. steps."""
    scale = 2 * STEP
    while scale < n:
        scale = scale * 3 // 2 if (scale // STEP) & (scale // STEP - 1) == 0 else scale * 4 // 3
    return scale


# --- the latent space --------------------------------------------------------


@dataclass
class Frequencies:
    """Documents; for each bucket how many of them hold a word of it, and its words."""

    total: int
    documents: np.ndarray
    words: np.ndarray

    @property
    def idf(self) -> np.ndarray:
        return np.log((self.total + 1) / (self.documents + 1)) + 0.05


class Passages:
    """Word counts of texts cut into passages, as unit rows, all of them together. Of
    passage i the words are ``words[heads[i] : heads[i] + long[i]]``."""

    def __init__(self, texts: list[np.ndarray], buckets: int, length: int) -> None:
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.words = np.concatenate([np.zeros(0, dtype=np.int64), *texts])
        self.counts = np.bincount(self.words, minlength=buckets)
        place = np.arange(len(self.words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.heads = np.flatnonzero(place % length == 0)
        self.long = np.diff(np.append(self.heads, len(self.words)))
        # the norm of a row, from how often the passage holds each of its buckets
        keys = np.sort(np.repeat(np.arange(len(self.heads)), self.long) * buckets + self.words)
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        times = np.diff(np.append(first, len(keys))).astype(np.float64)
        squares = np.bincount(keys[first] // buckets, times**2, minlength=len(self.heads))
        self.norms = np.sqrt(np.maximum(squares, 1e-24))

    def add_sketch(self, total: np.ndarray, basis: np.ndarray) -> np.ndarray:
        """Add A'A times ``basis``, of these rows, to ``total``; words by column."""
        if not len(self.words):
            return self.counts
        # the rows times the basis: the first words of all passages, then the second ones
        order = np.argsort(-self.long, kind="stable")
        heads = self.heads[order]
        across = np.zeros((len(heads), basis.shape[1]), dtype=basis.dtype)
        longer = len(heads) - np.cumsum(np.bincount(self.long))
        for at, many in enumerate(longer[:-1].tolist()):
            across[:many] += basis[self.words[heads[:many] + at]]
        along = np.empty(across.shape[::-1])
        along[:, order] = (across / self.norms[order, None] ** 2).T
        # and those by column: every word of a passage takes its sums
        for of, sums in enumerate(along):
            total[:, of] += np.bincount(self.words, np.repeat(sums, self.long), minlength=len(total))
        return self.counts


def _sum_arrays(partial: DataFrame, width: int) -> dict[int, np.ndarray]:
    """Sums of blocks by their number, added up by Spark in rounds of at most
    ``FAN_IN`` arrays each."""
    import pandas as pd

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(d) for d in group["data"])
        row = {"part": group["part"].iloc[0] // FAN_IN, "block": group["block"].iloc[0]}
        return pd.DataFrame({**row, "data": [total.tobytes()]})

    kinds = "part int, block int, data binary"
    left = partial.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN_IN)
        partial = partial.groupBy("part", "block").applyInPandas(add, kinds)
    return {
        r["block"]: np.frombuffer(r["data"]).reshape(-1, width)
        for r in partial.collect()
    }


def _blocks_of(total: np.ndarray) -> pa.RecordBatch:
    """A task's sum as rows of ``part, block, data``."""
    starts = range(0, len(total), BLOCK_ROWS)
    part = TaskContext.get().partitionId() // FAN_IN
    return pa.RecordBatch.from_arrays(
        [pa.array([part] * len(starts), pa.int32()),
         pa.array([b // BLOCK_ROWS for b in starts], pa.int32()),
         pa.array([total[b : b + BLOCK_ROWS].tobytes() for b in starts],
                  pa.binary())],
        ["part", "block", "data"],
    )


def counted_sketch(
    narrow: DataFrame, buckets: int, wide: int, length: int, seed: int
) -> tuple[Frequencies, np.ndarray]:
    """Counts of all documents, and T'TG for their passages T of word counts and a random
    G, from one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, basis = np.zeros((buckets, wide)), random_basis(buckets, wide, seed)
        held, words = np.zeros(buckets), np.zeros(buckets)
        texts, size, n = [], 0, 0
        for batch in batches:
            for text in words_found(batch.column("text").to_pylist(), buckets):
                ids = text.buckets
                held[ids] += 1  # once for each bucket, however often it is named
                n += 1
                # a long text in parts of whole passages
                step = SKETCH_WORDS // length * length or length
                for start in range(0, len(ids), step):
                    texts.append(ids[start : start + step])
                    size += len(texts[-1])
                    if size >= SKETCH_WORDS:
                        words += Passages(texts, buckets, length).add_sketch(sketch, basis)
                        texts, size = [], 0
        words += Passages(texts, buckets, length).add_sketch(sketch, basis)
        whole = np.column_stack([sketch, held, words])
        yield _blocks_of(np.concatenate([whole, np.full((1, wide + 2), n)]))

    kinds = "part int, block int, data binary"
    blocks = _sum_arrays(narrow.select("text").mapInArrow(run, kinds), wide + 2)
    if not blocks:
        return Frequencies(0, np.zeros(buckets), np.zeros(buckets)), np.zeros((buckets, wide))
    whole = np.concatenate([blocks[b] for b in sorted(blocks)])
    return Frequencies(int(whole[-1, 0]), whole[:-1, wide], whole[:-1, wide + 1]), whole[:-1, :wide]


def random_basis(buckets: int, wide: int, seed: int) -> np.ndarray:
    """Drawn again by every task, not sent."""
    return np.random.default_rng(seed).standard_normal((buckets, wide)).astype(np.float32)


def latent_space(
    sketch: np.ndarray, items: list[np.ndarray], idf: np.ndarray, rank: int, length: int, seed: int
) -> np.ndarray:
    """``buckets x rank``: leading right singular vectors of the TF-IDF passages A = TD,
    D the inverse document frequencies, over the singular values.

    ``sketch`` is T'TG. With G = DH that is D^-1 A'AH, so Y = D T'TG is A'A times a random
    matrix as well, and H'Y = G'T'TG. With H'Y = LL' the rows of B = Y L'^-1 give
    A'A = BB', up to what the sketch cannot see.
    """
    buckets, wide = sketch.shape
    basis, alone = random_basis(buckets, wide, seed).astype(np.float64), np.zeros(sketch.shape)
    # the items weigh as much as the documents' passages, so their directions are kept
    for words in items:
        Passages([words], buckets, max(length, len(words))).add_sketch(alone, basis)
    weight = max(1.0, np.linalg.norm(sketch) / max(np.linalg.norm(alone), 1e-9))
    y, basis = idf[:, None] * (sketch + weight * alone), basis / idf[:, None]
    # a little of the identity keeps the small matrix positive; it is taken off again
    shift = 1e-6 * max(np.linalg.norm(y), 1e-9) / max(np.linalg.norm(basis), 1e-9)
    y += shift * basis
    small = basis.T @ y
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    kept = values > 1e-10 * max(values.max(), 1e-300)
    wide_of = y @ (vectors[:, kept] / np.sqrt(values[kept]))
    left, sizes, _ = np.linalg.svd(wide_of, full_matrices=False)
    found = np.maximum(sizes**2 - shift, 0.0)[:rank]
    # texts are folded in by the inverse singular values, or what nearly all texts
    # share would make all of them alike
    # (within limits: a direction that hardly any passage has would drown the others)
    strength = np.sqrt(np.maximum(found, 1e-2 * max(found.max(initial=0.0), 1e-9)))
    return left[:, :rank] / strength


# --- search and verification -------------------------------------------------


class Searcher:
    """Finds the items in texts, many texts at a time.

    Texts lie one after the other, each begun at a multiple of ``STEP``; a window
    ends with its text, so it holds words of one text. A portion of a text is at
    least two of the longest windows.
    """

    def __init__(self, items: list[Item], vectors: np.ndarray, frequent: np.ndarray,
                 min_cosine: float, min_common: float, sure_common: float,
                 min_answer: float) -> None:
        buckets = len(vectors)
        self.buckets, known = buckets, Buckets(buckets)
        self.vectors = np.append(vectors, np.zeros((1, vectors.shape[1])), axis=0).astype(np.float32)
        self.min_cosine, self.min_common = min_cosine, min_common
        self.sure_common, self.min_answer = sure_common, min_answer
        by_scale: dict[int, list[Item]] = {}
        for item in items:
            if item.words:
                by_scale.setdefault(scale_of(len(item.words)), []).append(item)
        self.blocks = []
        parts = [
            (scale, group[i : i + BLOCK_ITEMS])
            for scale, group in sorted(by_scale.items())
            for i in range(0, len(group), BLOCK_ITEMS)
        ]
        for scale, group in parts:
            rows = np.stack([self.vectors[known.of(i.words)].sum(axis=0) for i in group])
            norms = np.linalg.norm(rows, axis=1, keepdims=True)
            places = np.full((len(group), max(len(i.words) for i in group)), buckets, dtype=np.int32)
            for of, item in zip(places, group, strict=True):
                of[: len(item.words)] = known.of(item.words)
            # of each bucket that is not frequent, how many of an item's words it has
            own = np.setdiff1d(np.unique(places), [buckets])
            own = own[~frequent[own]]
            number = np.zeros(buckets + 1, dtype=np.int32)
            number[own] = np.arange(1, len(own) + 1)
            times = np.zeros((len(own) + 1, len(group)), dtype=np.int32)
            for k, of in enumerate(places):
                np.add.at(times[:, k], number[of], 1)
            times[0] = 0
            # differences of sums are right in 16 bits if they fit
            if 2 * scale * times.max(initial=0) < 1 << 15:
                times = times.astype(np.int16)
            need = min_common * np.array([len(i.words) for i in group])
            held = np.array([len(i.words) for i in group]) - times.sum(axis=0, dtype=np.int64)
            self.blocks.append(
                (scale, group, (rows / np.maximum(norms, 1e-9)).T.copy(), places,
                 need, number, times, np.ceil(need - held - 1e-9).astype(times.dtype))
            )
        self.longest = max((scale for scale, *_ in self.blocks), default=STEP)
        self.portion = max(PART_WORDS, 2 * self.longest)

    def search(self, texts: list[str | None]) -> list[dict[int, tuple[object, float, float, bool]]]:
        """For each text its items: ``item, cosine, common share, answer found``."""
        found: list[dict[int, tuple[object, float, float, bool]]] = [{} for _ in texts]
        part: list[tuple[int, Text, int, int]] = []
        size = 0
        for t, text in enumerate(words_found(texts, self.buckets)):
            many = len(text.buckets)
            # a long text comes in portions that overlap by the longest window
            for start in range(0, many, self.portion - self.longest):
                end = min(start + self.portion, many)
                part.append((t, text, start, end))
                size += end - start
                if size >= PART_WORDS:
                    self._search_part(part, found)
                    part, size = [], 0
                if end == many:
                    break
        self._search_part(part, found)
        return found

    def _search_part(self, part, found) -> None:
        if not part or not self.blocks:
            return
        nothing = len(self.vectors) - 1
        ids, firsts, sizes, at = [], [], [], 0
        around, lows, froms, upto = [], [], [], 0  # portions with what may lie in a region
        pad = np.full(STEP, nothing, dtype=np.int64)
        for _, text, start, end in part:
            low = max(0, start - self.longest)
            near_ids = text.buckets[low : end + self.longest]
            own = near_ids[start - low : end - low]
            around.append(near_ids)
            lows.append(start - low)
            froms.append(upto)
            upto += len(near_ids)
            ids += [own, pad[: -len(own) % STEP]]
            firsts.append(at)
            sizes.append(-(-len(own) // STEP))
            at += sizes[-1]
        ids = np.concatenate(ids)
        place_of = np.repeat(np.arange(len(part)), sizes)
        offset = np.arange(at) - np.array(firsts)[place_of]
        stop = np.arange(at) - offset + np.array(sizes)[place_of]
        around, lows = np.concatenate(around), np.array(lows)
        bounds = np.array([*froms, upto])
        clean: dict[int, list[bytes]] = {}  # words of portions with candidates
        for scale, items, wanted, places, least, number, times, rare in self.blocks:
            width, stride = scale // STEP, max(1, scale // (3 * STEP))
            starts = np.flatnonzero(offset % stride == 0)
            ends = np.minimum(starts + width, stop[starts])
            place = place_of[starts]
            first = bounds[place] + lows[place] + offset[starts] * STEP
            low = np.maximum(bounds[place], first - scale // 2)
            high = np.minimum(bounds[place + 1], first + scale + scale // 2)
            # no region holds more of an item's rare words than it has occurrences of them
            known = number[around]
            held = np.flatnonzero(known)
            before = np.zeros(len(around) + 1, dtype=np.int64)
            np.cumsum(known > 0, out=before[1:])
            some = np.flatnonzero((before[high] - before[low]) * times.max(initial=0) >= rare.min())
            sums = np.zeros((len(held) + 1, len(items)), dtype=times.dtype)
            np.cumsum(times[known[held]], axis=0, dtype=times.dtype, out=sums[1:])
            of_window, of_item = np.nonzero(
                sums[before[high[some]]] - sums[before[low[some]]] >= rare
            )
            if not len(of_window):
                continue
            of_window = some[of_window]
            enough = self._enough(around, low, high, of_window, of_item, places, least)
            if not len(enough):
                continue
            of_window, of_item = of_window[enough], of_item[enough]
            windows, row_of = np.unique(of_window, return_inverse=True)
            long = (ends - starts)[windows] * STEP
            heads = np.cumsum(long) - long
            inside = np.arange(long.sum()) + np.repeat(starts[windows] * STEP - heads, long)
            rows = np.add.reduceat(self.vectors[ids[inside]], heads)
            norms = np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-6)
            cosines = np.einsum("ij,ij->i", rows[row_of], wanted.T[of_item]) / norms[row_of]
            near = np.flatnonzero(cosines >= self.min_cosine)
            for c in near.tolist():
                w, k = int(of_window[c]), int(of_item[c])
                t, text, start, end = part[place[w]]
                base = bounds[place[w]]
                if place[w] not in clean:
                    clean[place[w]] = text.terms(start - self.longest, end + self.longest)
                region = clean[place[w]][low[w] - base : high[w] - base]
                share, answer = self.verify(items[k], region)
                old = found[t].get(id(items[k]))
                if share and (old is None or share > old[2]):
                    found[t][id(items[k])] = (items[k].item_id, float(cosines[c]), share, answer)

    def _enough(self, around, low, high, of_window, of_item, places, least) -> np.ndarray:
        """Numbers of the candidates that can match: a region holds no more of an item
        in order than the item has places whose word is in the region."""
        buckets, passed = len(self.vectors) - 1, [np.zeros(0, dtype=np.int64)]
        windows, row_of = np.unique(of_window, return_inverse=True)
        held = np.zeros((WINDOWS, buckets + 1), dtype=bool)
        for begin in range(0, len(windows), WINDOWS):
            some = windows[begin : begin + WINDOWS]
            long = high[some] - low[some]
            row = np.repeat(np.arange(len(some)), long)
            at = np.arange(len(row)) + np.repeat(low[some] - np.cumsum(long) + long, long)
            word = around[at]
            held[row, word] = True
            ends = np.searchsorted(row_of, (begin, begin + len(some)))
            most = max(1, (1 << 20) // places.shape[1])
            for c in range(ends[0], ends[1], most):
                d = min(c + most, ends[1])
                there = held[(row_of[c:d] - begin)[:, None], places[of_item[c:d]]].sum(axis=1)
                passed.append(c + np.flatnonzero(there >= least[of_item[c:d]]))
            held[row, word] = False
        return np.concatenate(passed)

    def verify(self, item: Item, region: list[bytes]) -> tuple[float, bool]:
        """Share of the item that the region holds in order, and whether it holds
        the answer; a share of 0 if that is no match."""
        size = len(item.words)
        shared = [w for w in region if w in item.masks]
        if len(shared) < self.min_common * size:
            return 0.0, False
        share = common_subsequence(item.masks, size, shared) / size
        if share < self.min_common:
            return 0.0, False
        m = len(item.answer)
        held = common_subsequence(item.answer_masks, m, region) / m if m else 1.0
        answer = held >= self.min_answer
        return (share, answer) if answer or share >= self.sure_common else (0.0, answer)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    rank: int = 32,
    buckets: int = 1 << 14,
    passage: int = 48,
    min_cosine: float = 0.05,
    min_common: float = 0.6,
    sure_common: float = 0.8,
    min_answer: float = 0.5,
    max_items: int = 200_000,
    seed: int = 7,
) -> DataFrame:
    """``doc_id, item_id, cosine, common_share, answer_found`` of documents that
    hold an item. The benchmark is checked to have at most ``max_items`` rows, as
    it goes to every task whole.

    ``min_cosine`` only spares verification. By ``min_common``, words weighing the same,
    a match is at 0.3 / sqrt(1.5) = 0.24 or above (half of the common words outside the
    window, which is up to 1.5 times the item); uneven weights call for less."""
    narrow = id_and_text(docs, id_col, text_col)
    listed = benchmark.select(item_col, item_text).limit(max_items + 1).collect()
    if len(listed) > max_items:
        raise ValueError(f"more than {max_items} benchmark items: search them in several runs")
    items = [Item(i, terms(t), terms(answer_of(t))) for i, t in listed if t]
    counted, sketch = counted_sketch(narrow, buckets, rank + OVERSAMPLED, passage, seed)
    idf, memo = counted.idf, Buckets(buckets)
    space = latent_space(sketch, [memo.of(i.words) for i in items], idf, rank, passage, seed)
    shared = docs.sparkSession.sparkContext.broadcast(
        (items, (space * idf[:, None]).astype(np.float32), counted.words > FREQUENT * counted.words.sum())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*shared.value, min_cosine, min_common, sure_common, min_answer)
        for batch in batches:
            found = searcher.search(batch.column("text").to_pylist())
            rows = [
                (doc_id, *hit)
                for doc_id, hits in zip(batch.column("doc_id").to_pylist(), found, strict=True)
                for hit in hits.values()
            ]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (batch.schema.field("doc_id").type, item_kind, pa.float64(), pa.float64(),
                     pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["doc_id", "item_id", "cosine", "common_share", "answer_found"],
            )

    item_type = benchmark.schema[item_col].dataType
    item_kind = pa.string() if item_type.simpleString() == "string" else pa.int64()
    item_sql = "string" if item_type.simpleString() == "string" else "long"
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(
        run,
        f"doc_id {kind}, item_id {item_sql}, cosine double, common_share double, "
        "answer_found boolean",
    )
