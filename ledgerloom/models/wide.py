"""Penalized fits over factors of very many levels.

The levels of all factors are rows of a table, numbered by range partitions and joined
to the data; the driver holds numbers by slot, never the levels themselves. No matrix
as wide as the slots is formed either. With t terms in a row, the square of a row's
sum is at most t times the sum of its squares, and the slots of one factor exclude each
other; so the curvature of the log loss on centred, scaled columns is bounded by
``t / 4`` for a number and ``t / 4 / (1 - share)`` for a level. Steps are accelerated
proximal ones along those bounds, all penalties in one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.models.newton import PASS_BYTES, batches_of
from ledgerloom.models.passes import RowBlocks
from ledgerloom.models.penalized import MAX_PASSES, _gradient_sums
from ledgerloom.operators.columns import complete_cases
from ledgerloom.operators.windows import row_id
from ledgerloom.sources.frames import rows_to_df
from ledgerloom.storage import held


@dataclass(frozen=True)
class WideDesign:
    """``rows`` are ``x, slots, y`` and what is kept; slots below ``len(numbers)`` are
    those of numbers, the others lie in ``levels (slot, term, level)``."""

    rows: DataFrame
    numbers: list[str]
    levels: DataFrame
    width: int
    terms: int


def wide_design(
    df: DataFrame, label: str, terms: Sequence[str], intercept: bool = True, keep: Sequence[str] = ()
) -> WideDesign:
    """The coding of :func:`ledgerloom.models.design.design`, numbers before factors:
    a factor drops its alphabetically first level, and without an intercept the first
    factor keeps all. Rows with a null in any input are left out."""
    inputs = complete_cases(df, [label, *terms])
    kinds = dict(df.dtypes)
    factors = [t for t in terms if kinds[t] == "string"]
    numbers = [t for t in terms if t not in factors]
    seen = [
        F.struct(F.lit(k).alias("place"), F.lit(f).alias("term"), F.col(f"`{f}`").alias("level"))
        for k, f in enumerate(factors)
    ]
    pairs = (
        inputs.select(F.explode(F.array(*seen)).alias("p")).select("p.*").distinct()
        if seen
        else rows_to_df(df.sparkSession, [], "place int, term string, level string")
    )
    # the first level of each factor: a row for each factor
    first = pairs.groupBy("place").agg(F.min("level").alias("level"))
    if not intercept:
        first = first.where("place > 0")
    kept = pairs.join(first, ["place", "level"], "left_anti")
    numbered = row_id(kept, ["place", "level"], "slot").select(
        (F.col("slot") - 1 + len(numbers)).cast("int").alias("slot"), "term", "level"
    )
    coded = inputs
    for k, f in enumerate(factors):
        own = numbered.where(F.col("term") == f).select(
            F.col("level").alias(f"_level{k}"), F.col("slot").alias(f"_slot{k}")
        )
        coded = coded.join(own, coded[f] == own[f"_level{k}"], "left")
    empty = F.array().cast("array<int>")
    x = [F.col(f"`{c}`").cast("double") for c in numbers]
    rows = coded.select(
        (F.array(*x) if x else F.array().cast("array<double>")).alias("x"),
        (F.array_compact(F.array(*[F.col(f"_slot{k}") for k in range(len(factors))])) if factors else empty)
        .alias("slots"),
        F.col(f"`{label}`").cast("double").alias("y"),
        *keep,
    )
    return WideDesign(rows, numbers, numbered, len(numbers) + numbered.count(), len(terms))


@dataclass(frozen=True)
class WidePath:
    """Coefficients by penalty, largest first; column 0 is the intercept."""

    design: WideDesign
    lambdas: list[float]
    coefs: Any
    passes: int

    def path(self, spark: SparkSession) -> DataFrame:
        """``(lambda, term, coefficient)`` of the coefficients that are not zero."""
        found = [
            (float(lam), int(s) - 1, float(row[s]))
            for lam, row in zip(self.lambdas, self.coefs)
            for s in np.flatnonzero(row)
        ]
        rows = rows_to_df(spark, found, "lambda double, slot int, coefficient double")
        level = F.concat_ws("_", "term", "level")
        names = self.design.levels.select("slot", level.alias("term")).unionAll(
            rows_to_df(
                spark,
                [(-1, "(Intercept)"), *enumerate(self.design.numbers)],
                "slot int, term string",
            )
        )
        return rows.join(names, "slot").select("lambda", "term", "coefficient")


def _scales(blocks: RowBlocks):
    """Rows, rate of the outcome, and of each slot mean, deviation and null gradient."""
    width, shift = blocks.width, blocks.typical()

    def first(x, y, fold):
        return np.concatenate([[len(y), y.sum()], x.less(shift).sums(np.ones((len(y), 1)))[:, 0]])

    sums = blocks.sum(first, width + 2)
    n, rate = sums[0], sums[1] / max(sums[0], 1)
    mean = sums[2:] / max(n, 1) + shift
    origin = np.zeros(width)
    origin[blocks.dense] = mean[blocks.dense]

    def second(x, y, fold):
        x = x.less(origin)
        squares = np.zeros(width)
        squares[x.dense] = (x.x**2).sum(axis=0)
        return np.concatenate([squares, x.sums((y - rate)[:, None])[:, 0]])

    found = blocks.sum(second, 2 * width)
    spread = mean * (1 - mean)  # of a slot that is set or not
    spread[blocks.dense] = found[:width][blocks.dense] / n
    if not 0 < rate < 1:
        raise ValueError("both outcomes must occur")
    return n, rate, mean, origin, np.sqrt(np.maximum(spread, 0)), found[width:] / n


def wide_path(
    d: WideDesign, alpha: float, lambdas: Sequence[float], tol: float = 1e-6,
    max_passes: int = MAX_PASSES,
) -> WidePath:
    """Elastic-net coefficients, the objective of
    :func:`ledgerloom.models.penalized.penalized_cv`, at given penalties. A pass holds
    as many penalties as its sums allow; the others take passes of their own."""
    grid = sorted(lambdas, reverse=True)
    with held(d.rows.select("x", "slots", "y", F.lit(0).alias("fold")), spread=True) as matrix:
        blocks = RowBlocks(matrix, d.width, range(len(d.numbers)))
        scales = _scales(blocks)
        coefs, passes = [], 2
        for some in batches_of([d.width + 1] * len(grid), PASS_BYTES // 8):
            found, took = _descend_wide(
                blocks, d, scales, alpha, np.array([grid[k] for k in some]), tol, max_passes
            )
            coefs.append(found)
            passes += took
    return WidePath(d, grid, np.concatenate(coefs), passes)


def _descend_wide(blocks, d: WideDesign, scales, alpha: float, lam, tol: float, max_passes: int):
    n, rate, mean, origin, deviation, null = scales
    constant = deviation <= 1e-12 * np.abs(mean)
    scale = np.where(constant, 1.0, deviation)
    bound = np.full(d.width, d.terms / 4)
    level = np.ones(d.width, dtype=bool)
    level[blocks.dense] = False
    bound[level] /= np.maximum(1 - mean[level], 1e-12)
    l1, l2 = (lam * alpha)[:, None], (lam * (1 - alpha))[:, None]
    b = np.zeros((len(lam), d.width))
    b0 = np.full(len(lam), np.log(rate / (1 - rate)))
    z, z0, t = b.copy(), b0.copy(), np.ones(len(lam))
    middle = mean - origin
    active, passes = np.ones(len(lam), dtype=bool), 0
    none = np.full(len(lam), -1)  # no fold is left out
    while active.any() and passes < max_passes:
        k = np.flatnonzero(active)
        slopes = z[k] / scale
        coefs = np.concatenate([(z0[k] - slopes @ middle)[None], slopes.T])
        sums = _gradient_sums(blocks, coefs, none[k], origin)
        passes += 1
        g0 = sums[0] / n
        g = np.where(constant, 0.0, (sums[1:].T / n - middle * g0[:, None]) / scale)
        new0 = z0[k] - 4 * g0
        u = z[k] - g / bound
        new = np.sign(u) * np.maximum(np.abs(u) - l1[k] / bound, 0.0) / (1 + l2[k] / bound)
        # momentum, dropped where it points uphill
        uphill = ((z[k] - new) * bound * (new - b[k])).sum(axis=1) + (z0[k] - new0) * (new0 - b0[k]) / 4
        now = np.where(uphill > 0, 1.0, t[k])
        then = (1 + np.sqrt(1 + 4 * now**2)) / 2
        push = np.where(uphill > 0, 0.0, (now - 1) / then)
        moved = np.maximum(np.abs(new - z[k]).max(axis=1, initial=0.0), np.abs(new0 - z0[k]))
        z[k] = new + push[:, None] * (new - b[k])
        z0[k] = new0 + push * (new0 - b0[k])
        b[k], b0[k], t[k] = new, new0, then
        active[k] = moved > tol
    if active.any():
        raise RuntimeError(f"{int(active.sum())} penalized fits did not settle")
    slopes = b / scale
    return np.concatenate([(b0 - slopes @ mean)[:, None], slopes], axis=1), passes
