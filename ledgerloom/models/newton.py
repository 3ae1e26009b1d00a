"""Maximum-likelihood logistic fits of several column sets at once.

Newton's method with one pass over the rows per iteration: each pass returns
every model's deviance, gradient and information matrix. Used where one fit by
one would read the data once per candidate, and for matrices that bring their
own constant column, which the stock solver would scale away.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.models.design import Design
from ledgerloom.models.passes import RowBlocks, packed, triangle, unpacked
from ledgerloom.sources.frames import rows_to_df
from ledgerloom.storage import held

INTERCEPT = "(Intercept)"
# sums of candidates that are taken in one pass; more of them take several
PASS_BYTES = 32 << 20
WALD_ROWS = "term string, estimate double, std_error double, z_value double, p_value double"


@dataclass(frozen=True)
class Fit:
    """Estimates by slot (slot -1 is the intercept) with their standard errors."""

    terms: tuple[str, ...]
    slots: tuple[int, ...]
    estimates: tuple[float, ...]
    std_errors: tuple[float, ...]
    deviance: float
    rank: int
    n: int

    @property
    def aic(self) -> float:
        return self.deviance + 2 * self.rank

    @property
    def bic(self) -> float:
        return self.deviance + math.log(self.n) * self.rank

    def named(self, names: Sequence[str]) -> dict[str, float]:
        return {
            INTERCEPT if s < 0 else names[s]: b for s, b in zip(self.slots, self.estimates)
        }

    def coefficients(self, spark: SparkSession, names: Sequence[str]) -> DataFrame:
        """``(term, estimate, std_error, z_value, p_value)``, Wald tests."""
        rows = []
        for (term, b), se in zip(self.named(names).items(), self.std_errors):
            z = b / se if se > 0 else None
            p = None if z is None else math.erfc(abs(z) / math.sqrt(2))
            rows.append((term, b, se, z, p))
        return rows_to_df(spark, rows, WALD_ROWS)


def fit_matrix(d: Design, intercept: bool | None = None) -> Fit:
    """One fit on all columns of a design, as they are."""
    with held(d.rows().withColumn("fold", F.lit(0))) as matrix:
        free = d.intercept if intercept is None else intercept
        blocks = RowBlocks(matrix, len(d.names), d.dense)
        return fit_many(blocks, d, [tuple(d.terms)], intercept=free)[0]


def fit_many(
    blocks: RowBlocks,
    d: Design,
    term_sets: Sequence[tuple[str, ...]],
    warm: Fit | None = None,
    intercept: bool = True,
    tol: float = 1e-8,
    max_passes: int = 50,
) -> list[Fit]:
    """Fits of several term sets over the same rows, started from ``warm``. Candidates
    go through the rows together, as many as ``PASS_BYTES`` of sums allow."""
    import numpy as np

    width = len(d.names)
    # columns are counted from a typical row where an intercept can absorb that
    shift = blocks.typical() if intercept else np.zeros(width)
    known = dict(zip(warm.slots, warm.estimates)) if warm else {}
    if intercept and known:
        known[-1] += sum(b * shift[s] for s, b in known.items() if s >= 0)
    free = [-1] if intercept else []
    slots = [free + [s for t in ts for s in d.terms[t]] for ts in term_sets]
    trial = [np.array([known.get(s, 0.0) for s in ss]) for ss in slots]
    # estimates, deviance, rank, rows, information matrix
    accepted = [(b, math.inf, 0, 0, None) for b in trial]
    active = list(range(len(slots)))
    for _ in range(max_passes):
        sums = _newton_sums(blocks, [slots[k] for k in active], [trial[k] for k in active], shift)
        still = []
        for k, (deviance, n, gradient, information) in zip(active, sums):
            before, previous = accepted[k][:2]
            if deviance > previous + tol * (abs(deviance) + 0.1):
                trial[k] = (trial[k] + before) / 2  # overshot: halve the step
                still.append(k)
                continue
            unit = _units(information)
            step, _, rank, _ = np.linalg.lstsq(
                information / np.outer(unit, unit), gradient / unit, rcond=1e-10
            )
            step = step / unit
            gain = float(gradient @ step)  # deviance the step takes off
            if gain <= tol * (abs(deviance) + 0.1):
                # so close that the step's result is known without another pass
                accepted[k] = (trial[k] + step, deviance - gain, int(rank), n, information)
                continue
            accepted[k] = (trial[k], deviance, int(rank), n, information)
            trial[k] = trial[k] + step
            still.append(k)
        active = still
        if not active:
            break
    if active:
        raise RuntimeError(f"{len(active)} logistic fits did not settle")
    fits = []
    for ts, ss, (b, deviance, rank, n, information) in zip(term_sets, slots, accepted):
        unit = np.outer(*[_units(information)] * 2)
        covariance = np.linalg.pinv(information / unit, rcond=1e-10, hermitian=True) / unit
        back = np.eye(len(ss))
        if intercept:
            back[0, 1:] = -shift[ss[1:]]
        b, errors = back @ b, np.sqrt(np.diag(back @ covariance @ back.T))
        fits.append(Fit(ts, tuple(ss), tuple(b.tolist()), tuple(errors.tolist()), deviance, rank, n))
    return fits


def _units(information):
    """Scale of each slot, so that columns of any size count alike."""
    import numpy as np

    diagonal = np.sqrt(np.diag(information))
    return np.where(diagonal > 0, diagonal, 1.0)


def batches_of(sizes: Sequence[int], most: int) -> list[range]:
    """Neighbours that together have at most ``most`` numbers, or one that has more."""
    out, first, total = [], 0, 0
    for k, size in enumerate(sizes):
        if k > first and total + size > most:
            out.append(range(first, k))
            first, total = k, 0
        total += size
    return [*out, range(first, len(sizes))] if sizes else []


def _newton_sums(blocks: RowBlocks, slots, betas, shift):
    """Per candidate: deviance, rows, gradient and information matrix."""
    sizes = [2 + len(ss) + triangle(len(ss)) for ss in slots]
    out = []
    for some in batches_of(sizes, PASS_BYTES // 8):
        out += _sums_of(blocks, [slots[k] for k in some], [betas[k] for k in some], shift)
    return out


def _sums_of(blocks: RowBlocks, slots, betas, shift):
    """One pass; information matrices travel as their upper triangles."""
    import numpy as np

    coef, constant = np.zeros((len(shift), len(slots))), np.zeros(len(slots))
    picks, free = [], []
    for k, (ss, b) in enumerate(zip(slots, betas)):
        free.append(1 if ss and ss[0] < 0 else 0)  # the intercept, if there is one
        constant[k] = b[0] if free[k] else 0.0
        picks.append(ss[free[k] :])
        coef[picks[k], k] = b[free[k] :]
    widths = [len(p) + f for p, f in zip(picks, free)]
    offsets = np.cumsum([0] + [2 + w + triangle(w) for w in widths]).tolist()

    def block(x, y, fold):
        import numpy as np

        x = x.less(shift)
        eta = x.times(coef) + constant
        mu = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
        # log(1 + exp(eta)) - y * eta, without overflow
        loss = np.logaddexp(0, eta) - y[:, None] * eta
        out = np.empty(offsets[-1])
        for k, pick in enumerate(picks):
            sub, p, at = x.pick(pick), widths[k], offsets[k]
            w = mu[:, k] * (1 - mu[:, k])
            sums = sub.sums(np.column_stack([y - mu[:, k], w]))
            information = np.empty((p, p))
            information[free[k] :, free[k] :] = sub.cross(w)
            if free[k]:
                information[0] = information[:, 0] = np.append(w.sum(), sums[:, 1])
            out[at] = 2 * loss[:, k].sum()
            out[at + 1] = len(y)
            head = [(y - mu[:, k]).sum()] * free[k]
            out[at + 2 : at + 2 + p] = np.append(head, sums[:, 0])
            out[at + 2 + p : offsets[k + 1]] = packed(information)
        return out

    total = blocks.sum(block, offsets[-1], len(slots))
    return [
        (
            float(total[at]),
            int(round(total[at + 1])),
            total[at + 2 : at + 2 + p],
            unpacked(total[at + 2 + p : end], p),
        )
        for at, p, end in zip(offsets, widths, offsets[1:])
    ]
