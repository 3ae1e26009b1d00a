"""Jaccard join of word n-gram sets by PartEnum signatures.

Two sets of sizes a and b whose Jaccard similarity reaches the threshold differ in
at most k = (a + b)(1 - t) / (1 + t) elements. So for a band of sizes:

1. the elements' domain is dealt by a hash into first-level partitions, so many that
   two such sets differ in at most ``hidden`` elements of one of them; each has
   ``parts`` second-level partitions, of which the sets then agree on all but
   ``hidden``. A signature is the hash of a set's elements in one choice of
   ``parts - hidden`` second-level partitions. Similar sets share a signature; a set
   is signed for its own band and for the bands of the larger sets it may resemble;
2. sets that share a signature are tied to the smallest of them: one row a set and
   signature, never a pair of every two. Components of these ties are candidates;
3. the sets of a candidate component meet and are compared exactly. From a component
   of links that has been reached only the sets not reached yet are compared, and a
   parity sketch (each element flips one bit, so that two sketches differ in no more
   bits than the sets in elements) spares most comparisons without losing any.
   Components with more than ``block`` elements are dealt out as pairs of blocks,
   each pair to a task of its own;
4. components of the links found are the groups.

Only distinct sets take part, whatever the number of copies. A set's elements are
64-bit hashes of its shingles.

Null and empty texts have the empty set, which is linked with nothing: each such
row is a group of its own under its own id. Fewer words than ``width`` make one
shingle. Repeated rows have one set. Rows without an id get a component like any
other; its id is the smallest one that is not null. An empty table gives no rows.
Extra columns of the table do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, lower_words
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.simhash import forest
from ledgerloom.storage import cut_lineage, delete_checkpoint

BAND = 1.25  # the largest size of a band by its smallest
SKETCH_WORDS = 8  # of 64 bits
_ODD = np.uint64(0x9E3779B97F4A7C15)


def spread(number: int) -> np.uint64:
    """Another constant for each number."""
    return np.uint64(number * int(_ODD) % (1 << 64))


class WordHashes(dict):
    """A hash for each word, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, 12)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], width: int, known: WordHashes) -> np.ndarray:
    """Distinct hashes of the word shingles, in order."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    own = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    wide = min(width, len(words))
    n = len(words) - wide + 1
    out = np.full(n, wide, dtype=np.uint64)
    for k in range(wide):
        out = mixed(out * _ODD + own[k : k + n])
    return np.unique(out)


def set_key(elements: np.ndarray) -> int:
    """Of the whole set, as a signed long."""
    total = mixed(elements + np.uint64(1)).sum(dtype=np.uint64, keepdims=True)
    return int(mixed(total + spread(len(elements))).view(np.int64)[0])


def bands_of(size: int, percent: int) -> list[tuple[int, int]]:
    """Number and largest size of the bands of a set of ``size`` and of the larger
    sets it may resemble."""
    largest_partner, found = 100 * size // percent, []
    band, low = 0, 1
    while low <= largest_partner:
        high = max(low, int(low * BAND))
        if high >= size:
            found.append((band, high))
        band, low = band + 1, high + 1
    return found


def differing(total: int, percent: int) -> int:
    """Most elements in which similar sets of ``total`` elements together can differ."""
    return total * (100 - percent) // (100 + percent)


def signatures(elements: np.ndarray, percent: int, hidden: int = 1, parts: int = 3) -> np.ndarray:
    """Of one set; empty if only equal sets can be similar to it."""
    out = []
    for band, high in bands_of(len(elements), percent):
        k = differing(2 * high, percent)
        if not k:
            continue
        first = -(-(k + 1) // (hidden + 1))
        within = -(-(k + 1) // first) - 1  # differing elements in one of them
        cell = mixed(elements + spread(band + 1)) % np.uint64(first * parts)
        sums = np.zeros(first * parts, dtype=np.uint64)
        np.add.at(sums, cell.astype(np.int64), mixed(elements ^ _ODD))
        sums = sums.reshape(first, parts)
        for c, chosen in enumerate(combinations(range(parts), parts - within)):
            place = (np.arange(first, dtype=np.uint64) << np.uint64(16)) + np.uint64(band * 64 + c)
            out.append(mixed(sums[:, chosen].sum(axis=1, dtype=np.uint64) + mixed(place + _ODD)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def signed_sets(
    df: DataFrame, percent: int, width: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, set_id, n, signatures`` of every row; no ``set_id`` without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            keys, sizes, signed = [], [], []
            for text in batch.column("text"):
                own = shingle_set(lower_words(text.as_py()), width, known)
                keys.append(set_key(own) if len(own) else None)
                sizes.append(len(own))
                signed.append(signatures(own, percent).view(np.int64))
            cuts = np.cumsum([0, *map(len, signed)], dtype=np.int32)
            flat = np.concatenate([np.zeros(0, dtype=np.int64), *signed])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(keys, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat)),
                ],
                ["doc_id", "set_id", "n", "signatures"],
            )

    narrow = id_and_text(df, id_col, text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, set_id long, n long, signatures array<long>")


def candidate_ties(rows: DataFrame) -> DataFrame:
    """``a, b``: each set and the smallest one that shares a signature with it.

    The smallest is found by an aggregate with partial sums in the tasks and joined
    back, so that a signature of very many sets is a skewed key of a plain join."""
    signed = rows.select("set_id", F.explode("signatures").alias("signature"))
    shared = (
        signed.groupBy("signature")
        .agg(F.min("set_id").alias("least"), F.max("set_id").alias("most"))
        .where("least < most")
        .select("signature", "least")
    )
    return (
        signed.join(shared, "signature")
        .where("set_id != least")
        .select(F.col("least").alias("a"), F.col("set_id").alias("b"))
        .distinct()
    )


# --- exact comparison ----------------------------------------------------------


def parity_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Bits that count the elements falling on them, modulo two."""
    out = np.zeros((len(sets), SKETCH_WORDS), dtype=np.uint64)
    for i, own in enumerate(sets):
        bit = mixed(own + _ODD)
        word = (bit >> np.uint64(32)) % np.uint64(SKETCH_WORDS)
        np.bitwise_xor.at(out[i], word.astype(np.int64), np.uint64(1) << (bit % np.uint64(64)))
    return out


def similar_links(sets: list[np.ndarray], percent: int, block: int = 4096) -> list[tuple[int, int]]:
    """Pairs of indices that span the components of similar sets."""
    sketch = parity_sketches(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.append(0, np.cumsum(sizes))
    inside = np.zeros(len(values), dtype=np.int64)

    def linked(a: int, others: np.ndarray) -> np.ndarray:
        most = (sizes[others] + sizes[a]) * (100 - percent) // (100 + percent)
        near = others[np.abs(sizes[others] - sizes[a]) <= most]
        most = (sizes[near] + sizes[a]) * (100 - percent) // (100 + percent)
        near = near[np.bitwise_count(sketch[near] ^ sketch[a]).sum(axis=1) <= most]
        own, found = place[cuts[a] : cuts[a + 1]], []
        inside[own] = 1
        for i in range(0, len(near), block):
            some = near[i : i + block]
            ends = np.cumsum(sizes[some])
            at = np.arange(ends[-1]) + np.repeat(cuts[some] - (ends - sizes[some]), sizes[some])
            both = np.add.reduceat(inside[place[at]], ends - sizes[some])
            found.append(some[100 * both >= percent * (sizes[some] + sizes[a] - both)])
        inside[own] = 0
        return np.concatenate(found) if found else near

    left, links = np.argsort(sizes, kind="stable"), []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            a = front.pop()
            hit = linked(a, left)
            if len(hit):
                links += [(a, int(b)) for b in hit]
                front += hit.tolist()
                left = left[~np.isin(left, hit)]
    return links


def compared(groups: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links within each ``meeting`` of ``groups (meeting, set_id, elements)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []
        for batch in batches:
            for meeting, own, elements in zip(
                *(batch.column(c) for c in ("meeting", "set_id", "elements")), strict=True
            ):
                if meeting.as_py() != now:
                    if len(sets) > 1:
                        yield links_of(ids, sets)
                    now, ids, sets = meeting.as_py(), [], []
                ids.append(own.as_py())
                sets.append(np.frombuffer(elements.as_py(), dtype=np.uint64))
        if len(sets) > 1:
            yield links_of(ids, sets)

    def links_of(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        pairs = forest((ids[a], ids[b]) for a, b in similar_links(sets, percent))
        a, b = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(a.copy()), pa.array(b.copy())], ["a", "b"])

    return (
        groups.repartition("meeting")
        .sortWithinPartitions("meeting", "set_id")
        .mapInArrow(run, "a long, b long")
    )


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """``set_id, elements`` of rows ``doc_id, text`` that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sets = [shingle_set(lower_words(t.as_py()), width, known) for t in batch.column("text")]
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([set_key(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                ["set_id", "elements"],
            )

    return docs.select("text").mapInArrow(run, "set_id long, elements binary")


def links_within(
    df: DataFrame,
    members: DataFrame,
    percent: int,
    width: int,
    block: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``a, b``: links that span the components of similar sets among ``members
    (set_id, root, doc_id, n)``, of which those of one ``root`` meet. Sets are computed
    from the texts of the rows named, of which they are not kept."""
    members = cut_lineage(members)
    ids = members.select(F.col("doc_id").alias("wanted")).distinct()
    texts = id_and_text(df, id_col, text_col)
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(ids["wanted"]), "left_semi")
    blocks = members.groupBy("root").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    # a set meets its own block with every other one; one block is a meeting by itself
    meetings = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("own")),
            lambda o: F.least(o, F.col("own")) * F.col("blocks") + F.greatest(o, F.col("own")),
        )
    )
    groups = (
        sets_of(texts, width)
        .join(members.join(blocks, "root").select("set_id", "root", "blocks"), "set_id")
        .groupBy("set_id")
        .agg(*[F.first(c).alias(c) for c in ("root", "blocks", "elements")])
        .withColumn("own", own)
        .select("set_id", "elements", "root", F.explode(meetings).alias("part"))
        .select(F.xxhash64("root", "part").alias("meeting"), "set_id", "elements")
    )
    return compared(groups, percent)


def jaccard_links(
    df: DataFrame,
    rows: DataFrame,
    percent: int = 90,
    width: int = 3,
    block: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``a, b``: links that span the components of similar sets of ``df``; ``rows`` are
    its ``signed_sets``."""
    tied = cut_lineage(connected_components(candidate_ties(rows)))
    member = tied.unionAll(tied.select(F.col("root").alias("node"), "root")).distinct()
    members = rows.join(member.withColumnRenamed("node", "set_id"), "set_id").groupBy(
        "set_id", "root"
    ).agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    return links_within(df, members, percent, width, block, id_col, text_col)


def similar_groups(
    df: DataFrame,
    percent: int = 90,
    width: int = 3,
    block: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: rows whose sets of
    ``width``-word shingles have a Jaccard similarity of ``percent`` / 100 or more
    are linked."""
    if not 50 < percent <= 100:
        raise ValueError("a similarity from 51 to 100 percent is needed")
    rows = cut_lineage(signed_sets(df, percent, width, id_col, text_col))
    links = cut_lineage(jaccard_links(df, rows, percent, width, block, id_col, text_col))
    roots = connected_components(links)
    delete_checkpoint(links)
    nodes = rows.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    rooted = nodes.join(roots, nodes["set_id"] == roots["node"], "left").select(
        "set_id", "first", F.coalesce("root", "set_id").alias("root")
    )
    # written first, so that the join on a root with very many sets can be split
    named = cut_lineage(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    classes = cut_lineage(rooted.join(named, "root").select("set_id", "component_id"))
    return rows.join(classes, "set_id", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("set_id").isNull(), F.col("doc_id"))
        .otherwise(F.col("component_id"))
        .alias("component_id"),
    )
