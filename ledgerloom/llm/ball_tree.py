"""Ranked lexical search, exact, with a ball tree over sparse document vectors.

A document's vector has for each term ``(10^9 tf) div (1000 tf + 12 m)``, where m
grows with the document's length; its score for an item is the inner product with
the terms' weights, in whole numbers.

1. Documents are reduced to the terms that items hold, and written out; the counts of
   documents, of terms and of documents by term come from aggregates over all of them.
2. A task goes through its documents in portions. Over the vectors of a portion, in
   the terms of a block of items, a tree is built: a node parts its documents between
   two that are far apart, and has their centroid c and radius r. An item's score in
   a node is at most ``q.c + |q| r``. Coordinates are scaled by the square root of the
   weights, which leaves the product as it is and evens out the two factors. The bound
   is rounded up by more than the arithmetic can lose.
3. For each item the nodes are taken best first; the search of a portion ends with the
   first bound below the score of the item's 20th document so far. Leaves are scored
   in 64-bit integers.
4. Every task's best of each item are ranked, part by part, then together.

Items are taken in portions of at most ``portion_chars``, so that what goes to the
driver and to the tasks is bounded whatever their number.

Null and empty texts have no terms and are never returned, neither are documents
with score 0. An item without terms has no rows. Equal scores are ranked by ascending
id, a null id last; repeated rows are documents of their own. Texts of any length are
read whole. Empty tables give no rows. Extra columns do not matter.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text
from ledgerloom.storage import cut_lineage

PORTION, LEAF, BLOCK = 4096, 64, 32  # documents in a tree, in a leaf; items searched together
# bytes of a term: digits, letters and whatever is not ASCII; A-Z in lower case, others as blanks
_TERMS = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower()
)


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


def term_counts(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of rows ``doc_id, text`` with a term: all their terms
    counted, and those in ``numbers`` with their number of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, counts, cuts = [], [], [], [0]
            for text in batch.column("text"):
                words = terms_of(text.as_py())
                held = Counter(filter(None.__ne__, map(numbers.get, words)))
                sizes.append(len(words))
                terms += held.keys()
                counts += held.values()
                cuts.append(len(terms))
            ends = pa.array(cuts, pa.int32())
            found = pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32())),
                ],
                ["doc_id", "n", "terms", "tfs"],
            )
            yield found.filter(pa.array(np.array(sizes, dtype=np.int64) > 0))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Vectors:
    """Rows of whole numbers in few of many columns: of row i those from ``cuts[i]`` on."""

    def __init__(self, cuts: np.ndarray, cols: np.ndarray, values: np.ndarray):
        self.cuts, self.cols, self.values = cuts, cols, values

    def __len__(self) -> int:
        return len(self.cuts) - 1

    def rows(self, chosen: np.ndarray) -> Vectors:
        sizes = self.cuts[chosen + 1] - self.cuts[chosen]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.cuts[chosen] - (ends - sizes), sizes)
        return Vectors(np.append(0, ends), self.cols[at], self.values[at])

    def products(self, q: np.ndarray) -> np.ndarray:
        """With a vector over all columns. No row is empty."""
        return np.add.reduceat(self.values * q[self.cols], self.cuts[:-1])

    def within(self, number: np.ndarray) -> tuple[np.ndarray, Vectors]:
        """The columns that ``number`` numbers anew (others: -1), and the rows that
        hold one of them."""
        cols = number[self.cols]
        kept = cols >= 0
        before = np.append(0, np.cumsum(kept))[self.cuts]
        full = np.flatnonzero(np.diff(before))
        cuts = np.append(before[full], before[-1])
        return full, Vectors(cuts, cols[kept], self.values[kept])


class BallTree:
    """Nodes over the rows of ``vectors``, their columns scaled by ``scale``."""

    def __init__(self, vectors: Vectors, scale: np.ndarray, leaf: int = LEAF):
        self.children: list[tuple[int, int] | None] = []
        self.leaves: dict[int, tuple[np.ndarray, Vectors]] = {}
        self.centroids: list[np.ndarray] = []
        self.radii: list[float] = []
        self.columns = len(scale)
        self.scaled = Vectors(vectors.cuts, vectors.cols, vectors.values * scale[vectors.cols])
        self.exact = vectors
        self.grow(np.arange(len(vectors)), leaf)
        self.centroid = np.array(self.centroids)
        self.radius = np.array(self.radii)

    def grow(self, rows: np.ndarray, leaf: int) -> int:
        own = self.scaled.rows(rows)
        centroid = np.bincount(own.cols, own.values, self.columns) / len(rows)
        squares = np.add.reduceat(own.values**2, own.cuts[:-1])
        # |x - c|^2, rounded up by more than its three sums can lose
        most = squares + centroid @ centroid
        away = squares - 2 * own.products(centroid) + centroid @ centroid
        radius = math.sqrt(max(0.0, float((away + most * (self.columns + 16) * 2.0**-48).max())))
        node = len(self.children)
        self.children.append(None)
        self.centroids.append(centroid)
        self.radii.append(radius)
        if len(rows) <= leaf:
            self.leaves[node] = (rows, self.exact.rows(rows))
            return node
        first = self.dense(int(rows[np.argmax(away)]))
        second = self.dense(int(rows[np.argmax(squares - 2 * own.products(first))]))
        side = own.products(second - first)
        # half of the rows each, so that depth and work do not depend on their values
        order = np.argsort(side, kind="stable")
        half = len(rows) // 2
        self.children[node] = (
            self.grow(rows[np.sort(order[:half])], leaf),
            self.grow(rows[np.sort(order[half:])], leaf),
        )
        return node

    def dense(self, row: int) -> np.ndarray:
        out = np.zeros(self.columns)
        at = slice(self.scaled.cuts[row], self.scaled.cuts[row + 1])
        out[self.scaled.cols[at]] = self.scaled.values[at]
        return out

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """By node and item, no less than any of the node's products with the items'
        vectors, the columns of ``q``."""
        length = np.sqrt((q * q).sum(axis=0))
        middle = self.centroid @ q
        size = np.sqrt((self.centroid**2).sum(axis=1))[:, None] * length
        reach = self.radius[:, None] * length
        return middle + reach + (size + reach) * (self.columns + 16) * 2.0**-48 + 1

    def search(self, bounds: np.ndarray, exact: np.ndarray, best: Best) -> int:
        """Put the rows that belong there into ``best``; the number of leaves scored."""
        queue, scored = [(-bounds[0], 0)], 0
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < best.least:
                break
            if self.children[node] is None:
                rows, vectors = self.leaves[node]
                best.offer(rows, vectors.products(exact))
                scored += 1
            else:
                for child in self.children[node]:
                    heapq.heappush(queue, (-min(bounds[child], -bound), child))
        return scored


class Best:
    """The highest scores above 0 of one item, equal ones by ascending id."""

    def __init__(self, top: int):
        self.top, self.found, self.least = top, [], 1
        self.ids: list = []

    def offer(self, rows: np.ndarray, scores: np.ndarray) -> None:
        for i in np.flatnonzero(scores >= self.least).tolist():
            doc = self.ids[rows[i]]
            self.found.append((-int(scores[i]), doc is None, doc if doc is not None else 0))
        if len(self.found) > self.top:
            self.found = heapq.nsmallest(self.top, self.found)
        if len(self.found) == self.top:
            self.least = max(1, -max(self.found)[0])


def vectors_of(batch: pa.RecordBatch, documents: int, all_terms: int) -> Vectors:
    terms, tfs = batch.column("terms"), batch.column("tfs")
    cuts = terms.offsets.to_numpy().astype(np.int64)
    span = slice(cuts[0], cuts[-1])
    n, tf = batch.column("n").to_numpy(), tfs.values.to_numpy()[span].astype(np.int64)
    m = np.repeat(75 + (25 * n * documents) // all_terms, np.diff(cuts))
    values = (1_000_000_000 * tf) // (1000 * tf + 12 * m)
    return Vectors(cuts - cuts[0], terms.values.to_numpy()[span].astype(np.int64), values)


def search_portion(
    batch: pa.RecordBatch, items: list[dict[int, int]], best: list[Best], vocabulary: int,
    documents: int, all_terms: int, leaf: int = LEAF,
) -> tuple[int, int]:
    """Go through the documents of ``batch`` for all items, each the weights of its
    terms; leaves scored, and leaves there were."""
    vectors = vectors_of(batch, documents, all_terms)
    ids = batch.column("doc_id").to_pylist()
    scored = there = 0
    for i in range(0, len(items), BLOCK):
        some = items[i : i + BLOCK]
        columns = sorted({t for item in some for t, w in item.items() if w})
        number = np.full(vocabulary, -1)
        number[columns] = np.arange(len(columns))
        rows, own = vectors.within(number)
        if not len(rows):
            continue
        exact = np.zeros((len(columns), len(some)), dtype=np.int64)
        for j, item in enumerate(some):
            for t, w in item.items():
                if w:
                    exact[number[t], j] = w
        # the scale of a column: the root of the largest weight an item gives it
        scale = np.sqrt(exact.max(axis=1))
        tree = BallTree(own, scale, leaf)
        bounds = tree.bounds(exact / scale[:, None])
        there += len(tree.leaves) * len(some)
        held = [ids[r] for r in rows]
        for j in range(len(some)):
            best[i + j].ids = held
            scored += tree.search(bounds[:, j], exact[:, j].copy(), best[i + j])
    return scored, there


def _ranked_portion(
    narrow: DataFrame, items: list, top: int, id_kind: str
) -> DataFrame:
    """``item, doc_id, score`` of the best documents for collected items."""
    counted = [Counter(terms_of(text)) for text in items]
    numbers = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
    docs = cut_lineage(term_counts(narrow, numbers))
    sums = docs.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    documents, all_terms = sums["n"], sums["l"] or 1
    holding = dict(  # a row for each term of the items at most
        docs.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
    )
    # items that share their rarer words are searched together
    weights = {t: weight(documents, holding.get(i, 0)) for t, i in numbers.items() if i in holding}
    vectors = [{numbers[t]: weights[t] * k for t, k in c.items() if t in weights} for c in counted]
    order = sorted(range(len(items)), key=lambda i: sorted(vectors[i], key=lambda t: -holding[t])[:8])
    vectors, vocabulary = [vectors[i] for i in order], len(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in vectors]
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for i in range(0, batch.num_rows, PORTION):
                search_portion(
                    batch.slice(i, PORTION), vectors, best, vocabulary, documents, all_terms
                )
        if kind is None:
            return
        rows = [
            (order[i], None if null else doc, -score)
            for i, b in enumerate(best)
            for score, null, doc in b.found
        ]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], kind), pa.array(columns[2], pa.int64())],
            ["item", "doc_id", "score"],
        )

    return docs.mapInArrow(run, f"item int, doc_id {id_kind}, score long")


def lexical_search(
    df: DataFrame,
    items: DataFrame,
    top: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    portion_chars: int = 1 << 22,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of every item."""
    spark = df.sparkSession
    narrow = id_and_text(df, id_col, text_col)
    id_kind = narrow.schema["doc_id"].dataType.simpleString()
    wanted = cut_lineage(items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")))
    chars = wanted.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    portions = -(-chars // portion_chars) or 1
    out = None
    for k in range(portions):
        # a portion may be some larger than the others, by chance
        some = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(portions)) == k).collect()
        if not some and out is not None:
            continue
        found = _ranked_portion(narrow, [r["text"] for r in some], top, id_kind)
        names = spark.createDataFrame(
            [(i, r["item_id"]) for i, r in enumerate(some)],
            f"item int, item_id {wanted.schema['item_id'].dataType.simpleString()}",
        )
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        part = Window.partitionBy("item", "task").orderBy(*order)
        whole = Window.partitionBy("item").orderBy(*order)
        # the tasks' best meet in parts first, so that no item's rows meet all at once
        found = (
            found.withColumn("task", F.pmod(F.spark_partition_id(), F.lit(64)))
            .withColumn("rank", F.row_number().over(part))
            .where(F.col("rank") <= top)
            .withColumn("rank", F.row_number().over(whole))
            .where(F.col("rank") <= top)
            .join(names, "item")
            .select("item_id", "rank", "doc_id", "score")
        )
        out = found if out is None else out.unionAll(found)
    return out
