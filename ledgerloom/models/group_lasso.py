"""Group lasso for a binary outcome: columns enter or leave by whole groups."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.models.design import Design
from ledgerloom.models.penalized import TOL, PenaltyPath, _solve
from ledgerloom.sources.frames import rows_to_df


def group_lasso_cv(
    d: Design,
    id_col: str,
    groups: Mapping[str, Sequence[str]],
    folds: int = 10,
    n_lambda: int = 100,
    ratio: float = 1e-3,
    seed: int = 100,
    lambdas: Sequence[float] | None = None,
    tol: float = TOL,
    fold_col: str | None = None,
) -> PenaltyPath:
    """Path and cross-validation over raw columns; a group of size s is
    penalized by ``sqrt(s) * |b_g|``. ``groups`` maps a label to its columns and
    has to cover every column of the design."""
    slots = [[d.names.index(c) for c in cols] for cols in groups.values()]
    if sorted(s for g in slots for s in g) != list(range(len(d.names))):
        raise ValueError("groups must cover each column once")
    weights = [math.sqrt(len(g)) for g in slots]
    return _solve(
        d, id_col, slots, weights, [1.0], False, folds, n_lambda, ratio, seed, lambdas, tol,
        fold_col,
    )[0]


def selected_groups(
    spark: SparkSession, path: PenaltyPath, groups: Mapping[str, Sequence[str]], index: int
) -> DataFrame:
    """``(group_label, n_columns, norm, selected)`` at one penalty of the path."""
    at = path.terms_at(index)
    rows = [
        (label, len(cols), math.sqrt(sum(at[c] ** 2 for c in cols)))
        for label, cols in groups.items()
    ]
    frame = rows_to_df(spark, rows, "group_label string, n_columns int, norm double")
    return frame.withColumn("selected", F.col("norm") > 0)
