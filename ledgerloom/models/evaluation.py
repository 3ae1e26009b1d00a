"""Confusion counts and classification metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ordering import best_by


def mean_probability(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """``(model, avg_probability)``: every mean from one aggregate, so scored
    rows are neither multiplied nor shuffled."""
    wide = scores.agg(*[F.avg(m).alias(m) for m in models])
    return wide.unpivot([], list(models), "model", "avg_probability")


def confusion(classes: DataFrame, models: Sequence[str], actual: str) -> DataFrame:
    """``(model, tp, fp, fn, tn)`` with zero cells kept. Rows without a class or
    an outcome count in no cell."""
    y = F.col(actual)
    cells = []
    for m in models:
        c = F.col(m)
        cells.append(
            F.struct(
                F.lit(m).alias("model"),
                F.count_if((c == 1) & (y == 1)).alias("tp"),
                F.count_if((c == 1) & (y == 0)).alias("fp"),
                F.count_if((c == 0) & (y == 1)).alias("fn"),
                F.count_if((c == 0) & (y == 0)).alias("tn"),
            )
        )
    return classes.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def metrics(cells: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1; null where a ratio has no base.

    Precision divides by predicted positives, recall by actual ones. F1 has no
    value when precision or recall has none, or when both are 0.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    with_rates = cells.select(
        "*",
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return with_rates.withColumn("f1", F.try_divide(2 * p * r, p + r))


def best_recall(table: DataFrame) -> DataFrame:
    """The model that finds the largest share of actual positives."""
    return best_by(table, "recall", ["model"])
