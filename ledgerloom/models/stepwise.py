"""Stepwise selection by AIC, whole terms at a time.

All candidates of a step are fitted together, so a step costs about five passes
over the rows however many terms could move.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.models.design import Design
from ledgerloom.models.newton import Fit, fit_many
from ledgerloom.models.passes import RowBlocks
from ledgerloom.sources.frames import rows_to_df
from ledgerloom.storage import held


@dataclass(frozen=True)
class Selection:
    """Final fit and the path of accepted moves."""

    fit: Fit
    path: list[tuple[str, str, Fit]]
    names: list[str]

    def steps(self, spark: SparkSession) -> DataFrame:
        """``(step, action, term, n_coefficients, deviance, aic, bic)``."""
        return rows_to_df(
            spark,
            [
                (i, action, term, f.rank, f.deviance, f.aic, f.bic)
                for i, (action, term, f) in enumerate(self.path)
            ],
            "step int, action string, term string, n_coefficients int,"
            " deviance double, aic double, bic double",
        )

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """Wald table of the final fit."""
        return self.fit.coefficients(spark, self.names)


def stepwise(
    d: Design, terms: Sequence[str] | None = None, direction: str = "both", start: str | None = None
) -> Selection:
    """Add or drop the term that lowers AIC most until none does.

    ``forward`` starts from the intercept, ``backward`` and ``both`` from all
    terms unless ``start`` says ``null`` or ``full``. Ties go to the earlier term.
    """
    return stepwise_all(d, terms, [direction], start)[direction]


def stepwise_all(
    d: Design,
    terms: Sequence[str] | None = None,
    directions: Sequence[str] = ("forward", "backward", "both"),
    start: str | None = None,
) -> dict[str, Selection]:
    """Selections in several directions over rows that are held once; a set of terms
    that two of them come to is fitted once."""
    for direction in directions:
        if direction not in ("forward", "backward", "both"):
            raise ValueError(f"unknown direction {direction!r}")
    terms = list(terms or d.terms)
    with held(d.rows().withColumn("fold", F.lit(0))) as matrix:
        blocks = RowBlocks(matrix, len(d.names), d.dense)
        known: dict[tuple[str, ...], Fit] = {}

        def fits_of(sets: Sequence[tuple[str, ...]], warm: Fit | None = None) -> list[Fit]:
            new = [ts for ts in dict.fromkeys(sets) if ts not in known]
            known.update(zip(new, fit_many(blocks, d, new, warm=warm) if new else []))
            return [known[ts] for ts in sets]

        return {
            direction: _selected(d, terms, direction, start, fits_of) for direction in directions
        }


def _selected(d: Design, terms, direction: str, start: str | None, fits_of) -> Selection:
    start = start or ("null" if direction == "forward" else "full")
    current = fits_of([() if start == "null" else tuple(terms)])[0]
    path = [("start", "", current)]
    while True:
        moves = []
        if direction != "backward":
            moves += [("add", t) for t in terms if t not in current.terms]
        if direction != "forward":
            moves += [("drop", t) for t in terms if t in current.terms]
        if not moves:
            break
        sets = [
            tuple(t for t in terms if (t in current.terms) != (t == moved)) for _, moved in moves
        ]
        fits = fits_of(sets, current)
        best = min(range(len(moves)), key=lambda i: (fits[i].aic, i))
        if fits[best].aic >= current.aic - 1e-9:
            break
        current = fits[best]
        path.append((*moves[best], current))
    return Selection(current, path, d.names)
