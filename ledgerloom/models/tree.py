"""Classification tree tuned by cross-validated accuracy.

A tree of a smaller depth is the deeper one cut off there, and one of a larger least
gain is cut off where a split gains less: splits of a node do not depend on either.
So each fold is fitted once, at the largest depth and least gain of the grid, and all
grid points are read off it as column expressions, in one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
)
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.models.design import Design
from ledgerloom.models.split import fold_in
from ledgerloom.sources.frames import rows_to_df
from ledgerloom.storage import held


@dataclass(frozen=True)
class Node:
    """What a node predicts and how likely, and how it goes on: to ``left`` where the
    value of ``slot`` is at most ``threshold`` or, with ``values``, one of them."""

    prediction: float
    probability: float
    gain: float = 0.0
    slot: str | None = None
    threshold: float | None = None
    values: tuple[float, ...] = ()
    left: Node | None = None
    right: Node | None = None


def nodes_of(model: DecisionTreeClassificationModel, names: Sequence[str]) -> Node:
    """The fitted tree, its slots by name."""

    def read(node) -> Node:
        counts = [float(v) for v in node.impurityStats().stats()]
        likely = counts[1] / sum(counts) if len(counts) > 1 and sum(counts) else 0.0
        own = (float(node.prediction()), likely)
        if node.getClass().getSimpleName() == "LeafNode":
            return Node(*own)
        split = node.split()
        rule = (
            {"threshold": float(split.threshold())}
            if split.getClass().getSimpleName() == "ContinuousSplit"
            else {"values": tuple(sorted(float(v) for v in split.leftCategories()))}
        )
        return Node(
            *own, float(node.gain()), names[split.featureIndex()], **rule,
            left=read(node.leftChild()), right=read(node.rightChild()),
        )

    return read(model._java_obj.rootNode())


def cut_off(node: Node, depth: int, min_gain: float = 0.0) -> Node:
    """The tree as one fitted with that depth and least gain."""
    if node.slot is None or depth == 0 or node.gain < min_gain:
        return Node(node.prediction, node.probability)
    return Node(
        node.prediction, node.probability, node.gain, node.slot, node.threshold, node.values,
        cut_off(node.left, depth - 1, min_gain), cut_off(node.right, depth - 1, min_gain),
    )


def tree_column(node: Node, columns: Mapping[str, Column], what: str = "probability") -> Column:
    """``prediction`` or ``probability`` (of the second class) as an expression over
    the uncoded columns: no encoding step, one projection."""
    if node.slot is None:
        return F.lit(getattr(node, what))
    left, right = (tree_column(n, columns, what) for n in (node.left, node.right))
    if _same(node.left, node.right, what):
        return left
    value = columns[node.slot]
    rule = value <= node.threshold if node.threshold is not None else value.isin(*node.values)
    return F.when(rule, left).otherwise(right)


def _same(a: Node, b: Node, what: str) -> bool:
    return a.slot is None and b.slot is None and getattr(a, what) == getattr(b, what)


@dataclass(frozen=True)
class TreeFit:
    """The tree refitted on all rows, and the grid points with their accuracy."""

    model: CrossValidatorModel
    grid: list[tuple[int, float]]
    nodes: Node

    @property
    def best_accuracy(self) -> float:
        return float(max(self.model.avgMetrics))

    def results(self, spark: SparkSession) -> DataFrame:
        """``(max_depth, min_info_gain, accuracy, is_best)`` over the grid."""
        scores = [float(v) for v in self.model.avgMetrics]
        first_best = scores.index(max(scores))
        rows = [
            (depth, gain, score, i == first_best)
            for i, ((depth, gain), score) in enumerate(zip(self.grid, scores))
        ]
        return rows_to_df(
            spark,
            rows, "max_depth int, min_info_gain double, accuracy double, is_best boolean"
        )


def tree_cv(
    d: Design,
    id_col: str,
    folds: int = 3,
    depths: Sequence[int] = (2, 4, 6),
    gains: Sequence[float] = (0.0, 0.005, 0.02),
    seed: int = 100,
    fold_col: str | None = None,
    max_bins: int = 32,
) -> TreeFit:
    """Mean accuracy over the folds for each grid point; the best is refitted on
    all rows. Folds are those of ``fold_col`` or come from a hash of the id, so they
    do not change when rows are read again. ``max_bins`` bounds the split points
    tried for a column."""
    tree = DecisionTreeClassifier(
        featuresCol="features", labelCol="label", seed=seed, maxBins=max_bins
    )
    grid = [(depth, gain) for depth in depths for gain in gains]
    deepest = {tree.maxDepth: max(depths), tree.minInfoGain: min(gains)}
    used = list(d.terms)
    fold = fold_in(id_col, folds, seed, fold_col)
    rows = d.frame.select("features", "label", fold.alias("fold"), *[F.col(f"`{t}`") for t in used])
    with held(rows) as matrix:
        columns, right = d.columns(), {}
        for f in range(folds):
            grown = nodes_of(tree.fit(matrix.where(F.col("fold") != f), deepest), d.names)
            for k, (depth, gain) in enumerate(grid):
                said = tree_column(cut_off(grown, depth, gain), columns, "prediction")
                hit = (said == F.col("label")).cast("int")
                right[f, k] = F.avg(F.when(F.col("fold") == f, hit)).alias(f"right_{f}_{k}")
        found = matrix.agg(*right.values()).first()
        shares = [[found[f"right_{f}_{k}"] for f in range(folds)] for k in range(len(grid))]
        scores = [sum(s or 0.0 for s in own) / folds for own in shares]
        depth, gain = grid[scores.index(max(scores))]
        best = tree.fit(matrix, {tree.maxDepth: depth, tree.minInfoGain: gain})
        return TreeFit(CrossValidatorModel(best, scores), grid, nodes_of(best, d.names))
