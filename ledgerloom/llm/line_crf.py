"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. A line's features are facts about
itself (symbols, capitals, separators, repeated words, sentence marks, length, and
whether the line or its words came before) in steps, and the same facts of the
lines before and after it; the chain adds a weight for each pair of neighbouring
labels. Forward-backward gives each line's probability of being good, and a
document's quality is their mean weighted by the lines' lengths.

Line labels are those of the document. The field is fitted on a bounded sample of
labelled rows, at most ``fit_rows`` of those not held out, picked by a hash of
their ids. Scoring covers every whole text and moves nothing.

A text without words, null and empty ones among them, is one empty line. Repeated
rows are scored one by one. Without labels to learn from the score is 0.5. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, id_remainder
from ledgerloom.llm.toxicity import labelled_sample

SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# facts of a line, and the steps each is cut at
STEPS = {
    "symbols": (0.02, 0.3),  # per word
    "bangs": (0.1, 0.5),
    "pipes": (0.05, 0.2),
    "capitals": (0.1, 0.3, 0.6),  # per character
    "again": (0.05, 0.2, 0.4),  # words equal to the one before
    "repeated": (0.1, 0.3, 0.6),  # runs of five words found earlier in the text
    "unlike": (0.3, 0.6, 0.8),  # distinct words per word, below
    "words": (3, 10, 40),
    "line_before": (0.5,),  # the line came before
    "sentence": (0.5,),  # it ends with a sentence mark
}
CUTS = [(i, c) for i, cuts in enumerate(STEPS.values()) for c in cuts]
_AT = np.array([i for i, _ in CUTS])
_CUT = np.array([c for _, c in CUTS])
WIDTH = 3 * len(CUTS) + 3  # own, before, after; bias, first line, last line


def lines_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of the lines with words, and their lengths."""
    raw = (text or "").encode("utf-8", "replace")
    facts, lengths, seen_lines, seen_runs = [], [], set(), set()
    for line in raw.split(b"\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        size = len(line)
        marks = size - len(line.translate(None, SYMBOLS))
        capitals = size - len(line.translate(None, CAPITALS))
        runs = list(zip(*(words[k:] for k in range(5)), strict=False))
        old = 0
        for run in runs:
            h = hash(run)
            if h in seen_runs:
                old += 1
            else:
                seen_runs.add(h)
        facts.append((
            marks / n, line.count(b"!") / n, line.count(b"|") / n, capitals / size,
            sum(map(eq, words, words[1:])) / n, old / max(len(runs), 1), len(set(words)) / n, n,
            line in seen_lines, words[-1][-1:] in (b".", b"!", b"?", b":", b";"),
        ))
        seen_lines.add(line)
        lengths.append(size)
    if not facts:
        facts, lengths = [(0, 0, 0, 0, 0, 0, 1, 0, 0, 0)], [1]
    own = (np.array(facts, dtype=float)[:, _AT] > _CUT).astype(np.float32)
    out = np.zeros((len(own), WIDTH), dtype=np.float32)
    k = len(CUTS)
    out[:, :k] = own
    out[1:, k : 2 * k] = own[:-1]
    out[:-1, 2 * k : 3 * k] = own[1:]
    out[:, -3] = 1
    out[0, -2] = out[-1, -1] = 1
    return out, np.array(lengths, dtype=float)


@dataclass
class Field:
    weight: np.ndarray  # of features, towards good
    pair: np.ndarray  # of neighbouring labels, 2 x 2

    def marginals(self, own: list[float]) -> tuple[list[float], list[list[float]]]:
        """Each line's probability of being good, and those of label pairs, from the
        log-odds ``own`` of the lines. Messages are log-odds, so no length overflows."""
        bb, bg, gb, gg = (exp(x) for x in self.pair.ravel())
        n = len(own)
        ahead, m = [0.0] * n, own[0]
        ahead[0] = m
        for t in range(1, n):
            e = exp(min(max(m, -40.0), 40.0))
            m = own[t] + log((e * gg + bg) / (e * gb + bb))
            ahead[t] = m
        good, pairs, back = [0.0] * n, [], 0.0
        for t in range(n - 1, -1, -1):
            good[t] = 1.0 / (1.0 + exp(-min(max(ahead[t] + back, -40.0), 40.0)))
            if t:
                e = exp(min(max(own[t] + back, -40.0), 40.0))
                a = exp(min(max(ahead[t - 1], -40.0), 40.0))
                four = [bb, bg * e, a * gb, a * gg * e]
                total = sum(four)
                pairs.append([x / total for x in four])
                back = log((gb + gg * e) / (bb + bg * e))
        return good, pairs

    def quality(self, text: str | None) -> float:
        features, lengths = lines_of(text)
        good, _ = self.marginals((features @ self.weight).tolist())
        return float(np.dot(good, lengths) / lengths.sum())


def fit(
    texts: list[np.ndarray], labels: np.ndarray, rounds: int = 120, rate: float = 0.1,
    penalty: float = 1e-3, seed: int = 5,
) -> Field:
    """Maximum likelihood with Adam; a document weighs one, whatever its lines.

    Lines take their document's label, so the weight of a change of label would grow
    without end; ``penalty`` holds it, and the features' weights, back.
    """
    field = Field(np.zeros(WIDTH), np.zeros((2, 2)))
    if not texts:
        return field
    starts = np.cumsum([0, *map(len, texts)])
    rows = np.concatenate(texts)
    share = np.repeat(1.0 / np.diff(starts), np.diff(starts)) / len(texts)
    truth = np.repeat(labels, np.diff(starts))
    moved = [np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)]
    for k in range(1, rounds + 1):
        own = (rows @ field.weight).tolist()
        good, pair_error = [], np.zeros(4)
        for d, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
            found, pairs = field.marginals(own[a:b])
            good += found
            if pairs:
                mean = np.mean(pairs, axis=0)
                mean[3 if labels[d] else 0] -= 1
                pair_error += mean / len(texts)
        error = (np.array(good) - truth) * share
        grad = np.append(rows.T @ error + penalty * field.weight,
                         pair_error + penalty * field.pair.ravel())
        moved[0] = 0.9 * moved[0] + 0.1 * grad
        moved[1] = 0.99 * moved[1] + 0.01 * grad**2
        step = rate * (moved[0] / (1 - 0.9**k)) / (np.sqrt(moved[1] / (1 - 0.99**k)) + 1e-8)
        field.weight = field.weight - step[:WIDTH]
        field.pair = field.pair - step[WIDTH:].reshape(2, 2)
    return field


def line_quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    fit_rows: int = 2_500,
    modulus: int = 5,
    held: int = 0,
    threshold: float = 0.3,
    **how,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    narrow = id_and_text(docs, id_col, text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lines_of(t)[0].tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())],
                ["doc_id", "label", "found"],
            )

    sample = labelled_sample(narrow, labels, label, fit_rows, modulus, held)
    rows = sample.select("doc_id", "label", "text").mapInArrow(
        describe, f"doc_id {kind}, label int, found binary"
    ).collect()  # at most fit_rows documents
    rows.sort(key=lambda r: (str(r["doc_id"]), r["found"]))
    texts = [np.frombuffer(r["found"], dtype=np.float32).reshape(-1, WIDTH) for r in rows]
    field = fit(texts, np.array([r["label"] for r in rows], dtype=float), **how)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.quality(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"]
            )

    scored = narrow.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        F.coalesce(id_remainder(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
