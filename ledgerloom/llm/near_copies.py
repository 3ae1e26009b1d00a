"""Near copies by SimHash candidates and exact similarity.

Fingerprints are those of :mod:`ledgerloom.llm.simhash`, here of a text's distinct
words: a changed word costs five shingles of five words, but one word. So texts whose
shingle sets are similar to 0.8 differ in few bits (measured on near copies: 0.97 of
the pairs in at most 6), found by the same partitions of bits, thresholds, probing and
verification. A component of linked fingerprints is a group of candidates; within it the
sets of ``width``-word shingles are compared exactly, and only a Jaccard similarity of
``percent`` / 100 links two texts.

Texts without a word are copies of each other. Rows are told apart by id and text;
repeated rows are copies. Null ids are ids like any other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, lower_words
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.partenum import WordHashes, links_within, set_key, shingle_set
from ledgerloom.llm.simhash import fingerprint, near_links
from ledgerloom.storage import cut_lineage


def fingerprinted_sets(narrow: DataFrame, width: int, seed: int) -> DataFrame:
    """``doc_id, text_hash, fp, set_id, n`` of rows ``doc_id, text, text_hash``: the
    fingerprint of the distinct words, the shingle set's key (0: no word) and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            found, keys, sizes = [], [], []
            for text in batch.column("text"):
                words = lower_words(text.as_py())
                own = shingle_set(words, width, known)
                found.append(fingerprint(sorted(set(words)), 1, seed))
                keys.append(set_key(own) if len(own) else 0)
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(np.array(found, dtype=np.uint64).view(np.int64)),
                    pa.array(keys, pa.int64()),
                    pa.array(sizes, pa.int64()),
                ],
                ["doc_id", "text_hash", "fp", "set_id", "n"],
            )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.select("doc_id", "text", "text_hash").mapInArrow(
        run, f"doc_id {kind}, text_hash long, fp long, set_id long, n long"
    )


def near_copy_groups(
    df: DataFrame,
    most: int = 6,
    percent: int = 80,
    width: int = 5,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, text_hash, group``: a row for each row of ``df``; ``text_hash`` is the
    built-in ``xxhash64`` of the text, ``group`` a number that near copies share."""
    narrow = id_and_text(df, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    rows = cut_lineage(fingerprinted_sets(narrow, width, seed))
    nodes = cut_lineage(rows.select("fp").distinct())
    found = cut_lineage(connected_components(near_links(nodes, most)))
    sets = rows.where("n > 0").groupBy("set_id", "fp").agg(
        F.min("doc_id").alias("doc_id"), F.max("n").alias("n")
    )
    placed = sets.join(found, sets["fp"] == found["node"], "left").select(
        "set_id", F.coalesce("root", "fp").alias("root"), "doc_id", "n"
    )
    # a set has one fingerprint, as equal sets of shingles have equal words
    crowd = placed.groupBy("root").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    members = placed.join(cut_lineage(crowd.select("root")), "root", "left_semi")
    links = cut_lineage(links_within(df, members, percent, width, id_col=id_col, text_col=text_col))
    roots = connected_components(links)
    return rows.join(roots, rows["set_id"] == roots["node"], "left").select(
        "doc_id", "text_hash", F.coalesce("root", "set_id").alias("group")
    )


def first_of_groups(groups: DataFrame) -> DataFrame:
    """``doc_id, text_hash`` of the row with the smallest id of each group, an id before
    none; the one with the smallest hash of those with one id."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    return groups.groupBy("group").agg(F.min(order).alias("first")).select(
        "first.doc_id", "first.text_hash"
    )
