"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits; two that differ in at most ``most`` of them are linked,
and a component of links is a group of near copies. With the bits parted into m
groups and a threshold for each group, the thresholds adding up to ``most - m + 1``,
two linked fingerprints are within the threshold of some group: if they exceeded
all of them they would differ in more than ``most`` bits (a threshold of -1 leaves
a group out). So it is enough to look for pairs group by group:

1. bits that go together over the corpus are put into one group (their agreement
   is counted over all fingerprints);
2. for every number of groups tried, dynamic programming finds the thresholds
   with the least estimated work: fingerprint pairs that meet, from the counts of
   each group's values, and rows that are sent out;
3. a group with threshold t sends each fingerprint out under its bits with every
   choice of t bits masked; those within t of each other share such a key;
4. whatever meets under a key is verified by its differing bits.

Only distinct fingerprints take part. Under a key, links are reduced to a spanning
forest before they leave the task, so a group of thousands of near copies yields
a link for each member, not for each pair; a component that has been reached is
not compared again. Keys with more than ``split`` fingerprints are dealt out as
pairs of blocks, each pair to a task of its own.

Null and empty texts have fingerprint zero and are linked like any other. Repeated
rows share a fingerprint. Rows without an id get a component like any other; its
id is the smallest one that is not null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, lower_words
from ledgerloom.llm.components import connected_components
from ledgerloom.storage import cut_lineage

BITS = 64
PAIR_COST, KEY_COST = 1.0, 60.0  # of a comparison and of a row sent out, relative
_SLOT = np.arange(8, dtype=np.int64) * 256
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def fingerprint(words: list[bytes], width: int = 4, seed: int = 42) -> int:
    """Bit by bit the majority of the XXH64 of the word shingles; 0 without words."""
    if not words:
        return 0
    if len(words) > width:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    else:
        shingles = [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64)
    by_byte = hashes.view(np.uint8).reshape(-1, 8) + _SLOT
    counts = np.bincount(by_byte.ravel(), minlength=2048).reshape(8, 256) @ _BITS_OF
    major = (2 * counts > len(hashes)).ravel()
    return int(np.packbits(major, bitorder="little").view(np.uint64)[0])


def fingerprints(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42
) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every whole text, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                fingerprint(lower_words(t), width, seed)
                for t in batch.column("text").to_pylist()
            ]
            signed = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(signed)], ["doc_id", "fp"]
            )

    narrow = id_and_text(df, id_col, text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, fp long")


# --- the plan: groups of bits and thresholds ---------------------------------


def bit_agreement(nodes: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, share of ones by bit, correlation of bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint8).reshape(-1, 8)
            ones = np.unpackbits(fps, axis=1, bitorder="little").astype(np.float32)
            both += ones.T @ ones
            n += len(ones)
        at = np.arange(BITS * BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *at]), pa.array([n, *both.ravel().astype(np.int64)])], ["at", "n"]
        )

    rows = nodes.select("fp").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n"))
    sums = {at: n for at, n in rows.collect()}  # 64 * 64 + 1 rows
    n = sums.pop(-1, 0)
    both = np.array([sums.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    together = (both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    return n, share, np.abs(together)


def group_bits(together: np.ndarray, groups: int) -> list[list[int]]:
    """Bits parted into groups of nearly equal width, correlated ones together."""
    left, out = set(range(BITS)), []
    for g in range(groups):
        width = BITS // groups + (g < BITS % groups)
        rest = sorted(left)
        strength = together[np.ix_(rest, rest)].sum(axis=1)
        own = [rest[int(np.argmax(strength))]]
        left.remove(own[0])
        while len(own) < width:
            rest = sorted(left)
            own.append(rest[int(np.argmax(together[np.ix_(rest, own)].mean(axis=1)))])
            left.remove(own[-1])
        out.append(sorted(own))
    return out


def mask_of(bits: list[int] | tuple[int, ...]) -> int:
    """The bits as a signed long."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def within(differ: np.ndarray, most: int) -> np.ndarray:
    """Chance that at most 0, 1, .. ``most`` of independent bits differ."""
    chance = np.zeros(most + 1)
    chance[0] = 1.0
    for d in differ:
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    return np.cumsum(chance)


def allocate(costs: np.ndarray, total: int) -> tuple[float, list[int]]:
    """Thresholds with the least summed cost; ``costs[i, t + 1]`` is group i's cost
    at threshold t, from -1, and the thresholds add up to ``total``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for k, more in enumerate(row):
                t = k - 1
                found = (cost + more, [*chosen, t])
                if done + t not in after or found < after[done + t]:
                    after[done + t] = found
        best = after
    return best[total]


def choose_plan(nodes: DataFrame, most: int, tried: tuple[int, ...]) -> list[tuple[int, int]]:
    """Masks ``(group, kept bits)`` under which fingerprints are sent out."""
    n, share, together = bit_agreement(nodes)
    layouts = {m: group_bits(together, m) for m in tried}
    masks = [(m, g, mask_of(bits)) for m, groups in layouts.items() for g, bits in enumerate(groups)]
    values = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v"))
                  for i, (_, _, mask) in enumerate(masks)])
    )
    meet = (
        nodes.select(values.alias("x")).groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("i").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs"))
    )
    pairs = {(masks[i][0], masks[i][1]): p for i, p in meet.collect()}  # a row for each mask
    differ = 2 * share * (1 - share)
    found = []
    for m, groups in layouts.items():
        costs = np.zeros((m, most + 2))
        for g, bits in enumerate(groups):
            near = within(differ[bits], most)
            for t in range(most + 1):
                meets = pairs.get((m, g), 0.0) * near[t] / max(near[0], 1e-300)
                costs[g, t + 1] = PAIR_COST * max(meets, 1.0) + KEY_COST * n * comb(len(bits), t)
        found.append((*allocate(costs, most - m + 1), m))
    _, thresholds, m = min(found)
    return [
        (g, mask_of([b for b in layouts[m][g] if b not in hidden]))
        for g, t in enumerate(thresholds)
        if t >= 0
        for hidden in combinations(layouts[m][g], t)
    ]


# --- probing and verifying ---------------------------------------------------


def forest(links: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """The links that join two trees so far apart."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    kept = []
    for a, b in links:
        x, y = top(a), top(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def reach(fps: np.ndarray, most: int, block: int = 256) -> list[tuple[int, int]]:
    """Links that span the components of one group: from each component reached,
    only the fingerprints not reached yet are compared."""
    left, links = fps, []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            now, front = front[:block], front[block:]
            hit = np.full(len(left), -1)
            for a in now:
                fresh = (np.bitwise_count(left ^ a) <= most) & (hit < 0)
                if fresh.any():
                    links += [(int(a), int(b)) for b in left[fresh]]
                    hit[fresh] = 1
            if (hit > 0).any():
                front = np.concatenate([front, left[hit > 0]])
                left = left[hit < 0]
    return links


def find_links(keys: np.ndarray, fps: np.ndarray, most: int, small: int = 64) -> np.ndarray:
    """Spanning links of rows in order of ``keys``, within equal keys."""
    fps = fps.view(np.uint64)  # numpy counts the bits of absolute values
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(cuts, len(keys)))
    run = np.repeat(np.arange(len(cuts)), sizes)
    found: list[tuple[int, int]] = []
    usable = np.where(sizes <= small, sizes, 0)
    for d in range(1, int(usable.max(initial=0))):
        at = np.flatnonzero((run[d:] == run[:-d]) & (usable[run[d:]] > d))
        near = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= most]
        found += zip(fps[near].tolist(), fps[near + d].tolist(), strict=True)
    for k in np.flatnonzero(sizes > small):
        found += reach(fps[cuts[k] : cuts[k] + sizes[k]], most)
    kept = forest(found)
    return np.array(kept, dtype=np.uint64).reshape(-1, 2).view(np.int64)


def near_links(
    nodes: DataFrame, most: int = 4, tried: tuple[int, ...] = (2, 3, 4, 5), split: int = 20_000
) -> DataFrame:
    """``a, b``: links that span the components of distinct fingerprints ``fp``."""
    plan = choose_plan(nodes, most, tuple(m for m in tried if m <= most + 1))
    keys = nodes.select(
        "fp",
        F.explode(
            F.array(*[
                F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v"))
                for i, (_, mask) in enumerate(plan)
            ])
        ).alias("x"),
    ).select("fp", "x.k", "x.v", F.lit(0).alias("block"))
    crowded = cut_lineage(
        keys.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split)
    )
    if not crowded.isEmpty():
        # blocks of a crowded key meet pair by pair; every pair is a group of its own
        dealt = keys.join(crowded, ["k", "v"], "left").withColumn(
            "blocks", F.ceil(F.coalesce("n", F.lit(1)) * 2 / split).cast("int")
        )
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        others = F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda o: F.least(o, F.col("own")) * F.col("blocks") + F.greatest(o, F.col("own")),
        )
        keys = dealt.withColumn("own", own).select(
            "fp", "k", "v", F.explode(others).alias("block")
        )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held_fps = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            held_keys = np.concatenate([held_keys, batch.column("key").to_numpy()])
            held_fps = np.concatenate([held_fps, batch.column("fp").to_numpy()])
            # the last key may go on in the next batch
            other = held_keys != held_keys[-1]
            last = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if last:
                yield as_batch(find_links(held_keys[:last], held_fps[:last], most))
                held_keys, held_fps = held_keys[last:], held_fps[last:]
        if len(held_keys):
            yield as_batch(find_links(held_keys, held_fps, most))

    def as_batch(links: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    # two keys that share a hash only meet and are told apart by the verification
    met = keys.select("fp", F.xxhash64("k", "v", "block").alias("key"))
    sorted_keys = met.repartition("key").sortWithinPartitions("key")
    return sorted_keys.mapInArrow(probe, "a long, b long")


def near_duplicates(
    df: DataFrame,
    most: int = 4,
    width: int = 4,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    rows = cut_lineage(fingerprints(df, id_col, text_col, width, seed))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(near_links(nodes, most))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
