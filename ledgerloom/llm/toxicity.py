"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms, hashed to ``buckets``: its words in lower case,
without punctuation around them, and their beginnings, so that inflected and
compound insults share terms. Beside a weight each term
has a short vector, and the score adds the dot product of the vectors of every pair
of terms: a pair that is toxic together (an insult and a group's name) counts more
than its parts. The pairs are never listed; their sum is half of the squared sum
less the sum of squares.

The machine is fitted by AdaGrad on a bounded sample of labelled rows: at most
``fit_rows`` different ones of those not held out, picked by hashes of ids and texts. Terms found in
fewer than ``min_docs`` sampled texts carry no evidence and are left out. Scoring
covers every whole text and moves nothing.

Null and empty texts have no terms and get the score of the bias alone. Repeated
rows are scored one by one. Without any labels to learn from the score is 0.5. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, id_remainder, lower_words
from ledgerloom.storage import cut_lineage

PREFIXES = (3, 5, 7)  # characters of a word's beginning
PORTION = 100_000  # terms that are scored together; more only where one text has more
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII punctuation


class Terms:
    """Buckets of a text's terms, once each; the memo has a fixed size."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.memo = buckets, {}

    def _of(self, word: bytes) -> tuple[int, ...]:
        text = word.decode().strip(EDGE)
        own = {f"{k}:{text[:k]}" for k in PREFIXES if len(text) >= k} | {f"w:{text}"}
        return tuple(crc32(t.encode()) % self.buckets for t in own) if text else ()

    def __call__(self, text: str | None) -> np.ndarray:
        memo, found = self.memo, set()
        if len(memo) > 200_000:
            memo.clear()
        for word in set(lower_words(text)):
            own = memo.get(word)
            if own is None:
                own = memo[word] = self._of(word)
            found.update(own)
        return np.sort(np.fromiter(found, dtype=np.int64, count=len(found)))


@dataclass
class Machine:
    bias: float
    weight: np.ndarray  # by bucket
    vector: np.ndarray  # bucket x factors

    def logits(self, found: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of documents whose buckets lie one after the other; ``starts`` has an end."""
        return self.parts(found, starts)[0]

    def parts(self, found: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Logits, the terms' vectors and their sums by document."""
        v = self.vector[found]
        both = np.column_stack([self.weight[found] - 0.5 * np.einsum("ij,ij->i", v, v), v])
        total = np.zeros((len(starts) - 1, both.shape[1]))
        some = np.flatnonzero(np.diff(starts))  # texts with terms
        if len(some):
            total[some] = np.add.reduceat(both, starts[some])
        sums = total[:, 1:]
        return self.bias + total[:, 0] + 0.5 * np.einsum("ij,ij->i", sums, sums), v, sums


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def scores_of(machine: Machine, texts: list[str | None], terms: Terms) -> np.ndarray:
    """Scores of texts, taken in portions of some terms."""
    scores, found, starts = [], [], [0]

    def close() -> None:
        flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        scores.append(sigmoid(machine.logits(flat, np.array(starts))))
        found.clear()
        del starts[1:]

    for text in texts:
        own = terms(text)
        if found and starts[-1] + len(own) > PORTION:
            close()
        found.append(own)
        starts.append(starts[-1] + len(own))
    close()
    return np.concatenate(scores)


def fit(
    docs: list[np.ndarray], labels: np.ndarray, buckets: int, factors: int = 6, epochs: int = 20,
    rate: float = 0.2, penalty: float = 5e-3, min_docs: int = 8, batch: int = 64, seed: int = 11,
) -> Machine:
    rng = np.random.default_rng(seed)
    held = np.zeros(buckets, dtype=np.int64)
    for d in docs:
        held[d] += 1
    docs = [d[held[d] >= min_docs] for d in docs]
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3) if len(labels) else 0.5
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(buckets),
                      np.where(held[:, None] >= min_docs, rng.normal(0, 0.01, (buckets, factors)), 0))
    seen_w, seen_v, seen_b = np.full(buckets, 1e-3), np.full((buckets, factors), 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            own = [docs[i] for i in order[at : at + batch]]
            starts = np.cumsum([0, *map(len, own)])
            found = np.concatenate(own)
            if not len(found):
                continue
            of = np.repeat(np.arange(len(own)), np.diff(starts))
            logits, v, sums = machine.parts(found, starts)
            error = sigmoid(logits) - labels[order[at : at + batch]]
            each = error[of] / len(own)
            pull = np.column_stack([each, each[:, None] * (sums[of] - v)])
            by_term = np.argsort(found, kind="stable")
            ranked = found[by_term]
            first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
            used = ranked[first]
            grads = np.add.reduceat(pull[by_term], first)
            grad_w = grads[:, 0] + penalty * machine.weight[used]
            grad_v = grads[:, 1:] + penalty * machine.vector[used]
            seen_w[used] += grad_w**2
            seen_v[used] += grad_v**2
            machine.weight[used] -= rate * grad_w / np.sqrt(seen_w[used])
            machine.vector[used] -= 0.3 * rate * grad_v / np.sqrt(seen_v[used])
            grad_b = error.mean()
            seen_b += grad_b**2
            machine.bias -= rate * grad_b / np.sqrt(seen_b)
    return machine


def labelled_sample(
    narrow: DataFrame, labels: DataFrame, label: str, fit_rows: int, modulus: int, held: int
) -> DataFrame:
    """Different texts with a label that may be learned from: ``fit_rows`` at most, those
    of the ids with the least hash, and of the rows of an id those whose texts have it.
    An id with both labels has label 1. Only these ids are sent to the documents, and
    their hashes alone meet before the texts are taken."""
    usable = labels.where(
        (id_remainder(F.col("doc_id"), modulus) != held) & F.col(label).isin(0, 1)
    ).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    ids = cut_lineage(chosen)
    keyed = narrow.withColumn("text_hash", F.xxhash64("text"))
    keys = (
        keyed.join(F.broadcast(ids), "doc_id")  # at most fit_rows ids
        .select("doc_id", "text_hash", "label").distinct()
        .orderBy(F.xxhash64("doc_id"), F.xxhash64("text_hash")).limit(fit_rows)
    )
    rows = keyed.join(F.broadcast(cut_lineage(keys)), ["doc_id", "text_hash"])  # fit_rows rows
    return rows.dropDuplicates(["doc_id", "text_hash"]).drop("text_hash")


def train(
    narrow: DataFrame, labels: DataFrame, label: str, buckets: int, fit_rows: int, modulus: int,
    held: int, **how,
) -> Machine:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets_of = Terms(buckets)
        for batch in batches:
            found = [buckets_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"),
                 pa.array([f.tolist() for f in found], pa.list_(pa.int64()))],
                ["doc_id", "label", "found"],
            )

    sample = labelled_sample(narrow, labels, label, fit_rows, modulus, held)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "label", "text").mapInArrow(
        run, f"doc_id {kind}, label int, found array<long>"
    ).collect()  # at most fit_rows documents
    rows.sort(key=lambda r: (str(r["doc_id"]), r["found"]))  # the same whatever the partitions
    if not rows:
        return Machine(0.0, np.zeros(buckets), np.zeros((buckets, 1)))
    return fit([np.array(r["found"], dtype=np.int64) for r in rows],
               np.array([r["label"] for r in rows], dtype=float), buckets, **how)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 1 << 18,
    fit_rows: int = 8_000,
    modulus: int = 5,
    held: int = 0,
    threshold: float = 0.5,
    **how,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    narrow = id_and_text(docs, id_col, text_col)
    machine = train(narrow, labels, label, buckets, fit_rows, modulus, held, **how)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets_of = Terms(buckets)
        for batch in batches:
            scores = scores_of(shared.value, batch.column("text").to_pylist(), buckets_of)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"]
            )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    scored = narrow.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        F.coalesce(id_remainder(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
