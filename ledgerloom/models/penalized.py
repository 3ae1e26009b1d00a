"""Penalized logistic regression along a whole penalty path, with its folds.

Objective, for rows i and coefficients b with a free intercept::

    mean(log(1 + exp(f_i)) - y_i f_i)
        + lambda * ((1 - alpha) / 2 * sum b_j^2 + alpha * sum_g w_g * |b_g|)

Ridge, lasso and elastic net use groups of one column on standardized columns
(population deviation); the group lasso uses wider groups on raw columns.

The curvature of the log loss never exceeds a quarter, so ``X'X / 4n`` bounds it
everywhere. Those matrices, one for each training set, come from two passes (means,
then products about them); afterwards every iteration is one gradient pass for all
penalties and training sets together, followed by an accelerated proximal step on
arrays as long as the column count. A path of 100 penalties with 10 folds takes some
tens of passes in all, where fitting each of its 1,100 models by itself would take
that many each.

Designs of at most ``NEWTON_SLOTS`` slots get to a start close to the minimum by
proximal Newton steps before: their passes also add up each problem's own curvature,
and about five of them do. A step that leaves the optimality conditions worse is taken
back. The accelerated steps that follow are the same for all designs, and they alone
say when a problem has settled; after such a start one pass is often enough.

Within a proximal step a problem works on few slots: those that are not zero, and
those that the strong rule keeps (gradient at least twice the penalty less the one
before it on the path). The others stay at zero, every one of them is held against
the optimality conditions afterwards, and those that fail take part in another go.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.models.design import Design
from ledgerloom.models.passes import RowBlocks, packed, triangle, unpacked
from ledgerloom.models.split import fold_in
from ledgerloom.operators.ordering import by_magnitude
from ledgerloom.sources.frames import rows_to_df
from ledgerloom.storage import held

TOL = 1e-7
MAX_PASSES = 500
# numbers of the matrices that a group of problems works on together
TOGETHER = 4_000_000
# slots that are stepped along before the others hear of it
SLOTS = 8
# problems that go through a block of rows side by side
ABREAST = 256
# slots up to which Newton steps come first, how many, and when a problem needs no more
NEWTON_SLOTS = 48
NEWTON_STEPS = 12
NEWTON_CLOSE = 1e-4


@dataclass(frozen=True)
class PenaltyPath:
    """Coefficients per penalty, largest penalty first; column 0 is the
    intercept. ``cv`` holds (mean held-out deviance, its standard error)."""

    lambdas: list[float]
    names: list[str]
    coefs: Any
    cv: list[tuple[float, float]] | None
    passes: int

    @property
    def best(self) -> int:
        """Index of the penalty with least held-out deviance."""
        if self.cv is None:
            raise ValueError("fitted without folds")
        return min(range(len(self.lambdas)), key=lambda i: self.cv[i][0])

    @property
    def best_lambda(self) -> float:
        return self.lambdas[self.best]

    def terms_at(self, index: int) -> dict[str, float]:
        terms = ["(Intercept)", *self.names]
        return {t: float(v) for t, v in zip(terms, self.coefs[index])}

    def path(self, spark: SparkSession) -> DataFrame:
        """``(lambda, term, coefficient)``."""
        return rows_to_df(
            spark,
            [
                (lam, term, value)
                for i, lam in enumerate(self.lambdas)
                for term, value in self.terms_at(i).items()
            ],
            "lambda double, term string, coefficient double",
        )

    def at_best(self, spark: SparkSession) -> DataFrame:
        """``(term, coefficient)`` at the chosen penalty."""
        return rows_to_df(
            spark,
            list(self.terms_at(self.best).items()), "term string, coefficient double"
        )

    def cv_table(self, spark: SparkSession) -> DataFrame:
        """``(lambda, deviance, std_error, is_best)``."""
        best = self.best
        return rows_to_df(
            spark,
            [(lam, *self.cv[i], i == best) for i, lam in enumerate(self.lambdas)],
            "lambda double, deviance double, std_error double, is_best boolean",
        )


def penalized_cv(
    d: Design,
    id_col: str,
    alpha: float,
    folds: int = 10,
    n_lambda: int = 100,
    ratio: float = 1e-4,
    seed: int = 100,
    lambdas: Sequence[float] | None = None,
    tol: float = TOL,
    fold_col: str | None = None,
) -> PenaltyPath:
    """Elastic-net path: ``alpha`` 0 is ridge, 1 is lasso. ``folds=0`` skips
    cross-validation. Folds are those of the column ``fold_col``, numbered from 0
    below ``folds``, or hang on a hash of ``id_col``. Passes end once no
    standardized coefficient moves by more than ``tol``."""
    return penalized_cvs(
        d, id_col, [alpha], folds, n_lambda, ratio, seed, lambdas, tol, fold_col
    )[alpha]


def penalized_cvs(
    d: Design,
    id_col: str,
    alphas: Sequence[float],
    folds: int = 10,
    n_lambda: int = 100,
    ratio: float = 1e-4,
    seed: int = 100,
    lambdas: Sequence[float] | None = None,
    tol: float = TOL,
    fold_col: str | None = None,
) -> dict[float, PenaltyPath]:
    """Several elastic-net paths that share their passes, each over its own
    penalties unless ``lambdas`` gives them."""
    groups = [[i] for i in range(len(d.names))]
    paths = _solve(
        d, id_col, groups, [1.0] * len(groups), alphas, True, folds, n_lambda, ratio, seed,
        lambdas, tol, fold_col,
    )
    return dict(zip(alphas, paths))


def coef_path(
    d: Design, id_col: str, alpha: float, lambdas: Sequence[float] | None = None, **kwargs: Any
) -> PenaltyPath:
    """The path alone, over given or data-derived penalties."""
    return penalized_cv(d, id_col, alpha, folds=0, lambdas=lambdas, **kwargs)


def nonzero(coefs: DataFrame) -> DataFrame:
    return coefs.where(F.col("coefficient") != 0)


def split_by_size(coefs: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Coefficients by magnitude, each marked large or near zero."""
    size = F.when(F.abs("coefficient") > threshold, "large").otherwise("near zero")
    return by_magnitude(coefs.withColumn("size", size), "coefficient", "term")


def lambda_grid(largest: float, n: int, ratio: float) -> list[float]:
    """``n`` log-spaced penalties from ``largest`` down to ``ratio * largest``."""
    if n == 1:
        return [largest]
    return [largest * ratio ** (i / (n - 1)) for i in range(n)]


def penalty_grid(
    d: Design, id_col: str, alpha: float, n_lambda: int = 100, ratio: float = 1e-4
) -> list[float]:
    """The data-derived penalties of :func:`penalized_cv`, from one pass."""
    groups = [[i] for i in range(len(d.names))]
    rows = d.rows(None, id_col).withColumn("fold", F.lit(0))
    blocks = RowBlocks(rows, len(d.names), d.dense)
    heads = _Heads(*_moments(blocks, 1), 0, True)
    return lambda_grid(_largest(heads, groups, [1.0] * len(groups), alpha), n_lambda, ratio)


def _largest(heads: _Heads, groups, weights, alpha: float) -> float:
    """The least penalty at which every group is zero. ``alpha`` below 0.001
    counts as 0.001, so that ridge has a finite start."""
    import numpy as np

    c = heads.null_gradient[0]
    top = max(float(np.linalg.norm(c[g])) / w for g, w in zip(groups, weights))
    return top / max(alpha, 1e-3) * (1 + 1e-9)


def _solve(
    d, id_col, groups, weights, alphas, standardize, folds, n_lambda, ratio, seed, lambdas, tol,
    fold_col=None,
) -> list[PenaltyPath]:
    """One path per alpha: ``alpha`` of the penalty on group norms, the rest on
    squares."""
    import numpy as np

    fold = fold_in(id_col, folds, seed, fold_col) if folds else F.lit(0)
    keep = dict.fromkeys([id_col, *([fold_col] if fold_col else [])])
    rows = d.rows(None, *keep).select("x", "slots", "y", fold.alias("fold"))
    with held(rows, spread=True) as matrix:
        blocks = RowBlocks(matrix, len(d.names), d.dense)
        heads = _Heads(*_moments(blocks, max(folds, 1)), folds, standardize)
        grids = [
            sorted(lambdas, reverse=True)
            if lambdas is not None
            else lambda_grid(_largest(heads, groups, weights, a), n_lambda, ratio)
            for a in alphas
        ]
        lam = np.concatenate(grids)
        part = np.repeat(alphas, [len(g) for g in grids])
        before = np.concatenate([[g[0], *g[:-1]] for g in grids])
        raw, passes = _descend(
            blocks, heads, groups, weights, lam * part, lam * (1 - part), before * part, tol
        )
        cv = _held_out(blocks, heads, raw) if folds else None
    paths, at = [], 0
    for grid in grids:
        own = slice(at, at + len(grid))
        paths.append(PenaltyPath(list(grid), d.names, raw[0, own], cv and cv[own], passes + 2))
        at += len(grid)
    return paths


def _moments(blocks: RowBlocks, folds: int):
    """Per fold: rows, rate of the outcome, means, and sums of products about the
    means, of the columns with each other and with the outcome."""
    import numpy as np

    width, shift = blocks.width, blocks.typical()

    def first(x, y, fold):
        import numpy as np

        inside = (fold[:, None] == np.arange(folds)).astype(float)
        sums = x.less(shift).sums(inside)
        return np.concatenate([[inside.sum(0), inside.T @ y], sums]).ravel()

    sums = blocks.sum(first, (width + 2) * folds, folds).reshape(width + 2, folds)
    n, rows = sums[0], np.maximum(sums[0], 1)
    rate, mean = sums[1] / rows, sums[2:].T / rows[:, None] + shift
    # numbers are counted from their own fold's mean, slots of factors from zero
    middle = np.zeros_like(mean)
    middle[:, blocks.dense] = mean[:, blocks.dense]
    size = width + triangle(width)

    def second(x, y, fold):
        import numpy as np

        out = np.zeros((folds, size))
        for f in np.unique(fold):
            rows = fold == f
            own = x.where(rows).less(middle[f])
            out[f, :width] = own.sums((y[rows] - rate[f])[:, None])[:, 0]
            out[f, width:] = packed(own.cross())
        return out.ravel()

    found = blocks.sum(second, folds * size).reshape(folds, size)
    off = mean - middle
    cross = np.array([
        unpacked(found[f, width:], width) - n[f] * np.outer(off[f], off[f]) for f in range(folds)
    ])
    return n, rate, mean, found[:, :width], cross


class _Heads:
    """Training sets: all rows first, then the rows outside each fold. Holds
    their sizes, column means and scales and one curvature bound for each.

    A set's figures are added up from those of its folds, each about its own means:
    nothing is taken off a sum, so a fold with very large values leaves the sets
    without it as precise as they are."""

    def __init__(self, n, rate, mean, with_y, cross, folds: int, standardize: bool):
        import numpy as np

        count = len(n)
        sets = [np.ones(count, bool)] + [np.arange(count) != f for f in range(folds)]
        self.out, self.bases = np.array([-1, *range(folds)]), {}
        self.held_n = n[:folds]
        self.n = np.array([n[s].sum() for s in sets])
        if not self.n.all():
            raise ValueError("no complete row to fit on")
        self.mean = np.array([n[s] @ mean[s] / k for s, k in zip(sets, self.n)])
        rates = np.array([n[s] @ rate[s] / k for s, k in zip(sets, self.n)])
        if not ((0 < rates) & (rates < 1)).all():
            raise ValueError("both outcomes must occur in every training set")
        self.start = np.log(rates / (1 - rates))
        self.bound = np.empty((len(sets), *cross.shape[1:]))
        null = np.empty_like(self.mean)
        for h, own in enumerate(sets):
            off = mean[own] - self.mean[h]
            self.bound[h] = (cross[own].sum(axis=0) + (off.T * n[own]) @ off) / self.n[h]
            null[h] = with_y[own].sum(axis=0) + (off.T * n[own]) @ (rate[own] - rates[h])
        deviation = np.sqrt(np.maximum(np.einsum("hjj->hj", self.bound), 0))
        # a column constant within the set has no coefficient
        self.constant = deviation <= 1e-12 * np.abs(self.mean)
        self.scale = np.where(standardize & ~self.constant, deviation, 1.0)
        self.unit = np.where(self.constant, 1.0, deviation) / self.scale
        factor = np.where(self.constant, 0.0, 0.5 / self.scale)
        self.bound *= factor[:, :, None]
        self.bound *= factor[:, None, :]
        self.null_gradient = np.where(self.constant, 0.0, null / self.n[:, None] / self.scale)

    def raw(self, b0, b, origin=0.0):
        """Coefficients for unscaled columns counted from ``origin``, intercept first:
        (head, penalty, slot)."""
        import numpy as np

        slopes = b / self.scale[:, None, :]
        middle = (self.mean - origin)[:, None, :]
        return np.concatenate([(b0 - (slopes * middle).sum(-1))[..., None], slopes], axis=-1)

    def gradient(self, sums, head, origin):
        """Gradients on centred, scaled columns from sums (slot, problem) of columns
        counted from ``origin``."""
        import numpy as np

        g0 = sums[0] / self.n[head]
        slopes = sums[1:].T / self.n[head][:, None] - (self.mean - origin)[head] * g0[:, None]
        return g0, np.where(self.constant[head], 0.0, slopes / self.scale[head])

    def ridge_step(self, head, g, start, l2):
        """The minima of bounded quadratics with squares alone as penalty: a linear
        system each, solved for all penalties of a head in one basis."""
        import numpy as np

        out = np.empty_like(start)
        for h in np.unique(head):
            if h not in self.bases:
                self.bases[h] = np.linalg.eigh(self.bound[h])
            values, basis = self.bases[h]
            values, own = np.maximum(values, 0.0), head == h
            turned = values * (start[own] @ basis) - g[own] @ basis
            out[own] = (turned / (values + l2[own, None])) @ basis.T
        return np.where(self.constant[head], 0.0, out)

    def bent(self, head, b):
        """Each problem's curvature matrix times its row of ``b``."""
        import numpy as np

        out = np.empty_like(b)
        for h in np.unique(head):
            own = head == h
            out[own] = b[own] @ self.bound[h]
        return out


def _descend(blocks: RowBlocks, heads: _Heads, groups, weights, l1, l2, before, tol):
    """Accelerated proximal steps until every (head, penalty) has settled; ``l1``
    and ``l2`` are the two parts of each penalty, ``before`` is the first part of the
    next larger one on its path."""
    import numpy as np

    n_heads, width = heads.mean.shape
    n_lams = len(l1)
    origin = np.zeros(width)
    origin[blocks.dense] = heads.mean[0, blocks.dense]
    b, b0, passes = _newton(blocks, heads, groups, weights, l1, l2, origin)
    z, z0 = b.copy(), b0.copy()
    t = np.ones((n_heads, n_lams))
    active = np.ones((n_heads, n_lams), dtype=bool)
    most, inner = passes + MAX_PASSES, 1e-3
    top = _largest_curvature(heads.bound, groups)
    while active.any() and passes < most:
        head, lam = np.nonzero(active)
        coefs = heads.raw(z0, z, origin)[head, lam].T
        sums = _gradient_sums(blocks, coefs, heads.out[head], origin)
        passes += 1
        g0, g = heads.gradient(sums, head, origin)
        at, at0 = z[head, lam], z0[head, lam]
        new0 = at0 - 4 * g0
        new, solved = _proximal(
            heads, top, head, g, at, groups, weights, l1[lam], l2[lam], before[lam], inner
        )

        # momentum, dropped where it points uphill
        old, old0 = b[head, lam], b0[head, lam]
        uphill = ((at - new) * heads.bent(head, new - old)).sum(axis=1)
        uphill += (at0 - new0) * (new0 - old0) / 4
        tk = np.where(uphill > 0, 1.0, t[head, lam])
        tn = (1 + np.sqrt(1 + 4 * tk**2)) / 2
        push = np.where(uphill > 0, 0.0, (tk - 1) / tn)
        z[head, lam] = new + push[:, None] * (new - old)
        z0[head, lam] = new0 + push * (new0 - old0)
        b[head, lam], b0[head, lam], t[head, lam] = new, new0, tn

        moved = np.maximum(
            np.abs((new - at) * heads.unit[head]).max(axis=1), np.abs(new0 - at0)
        )
        # a step that was not solved settles nothing, however small it was
        active[head, lam] = (moved > tol) | ~solved
        # the inner problem is solved only as well as the outer step deserves
        inner = 1e-3 * max(float(moved.max()), tol)
    if active.any():
        raise RuntimeError(f"{int(active.sum())} penalized fits did not settle")
    return heads.raw(b0, b), passes


def _newton(blocks: RowBlocks, heads: _Heads, groups, weights, l1, l2, origin):
    """Coefficients (head, penalty, slot) and intercepts to start the descent from, and
    the passes they took: proximal Newton steps. Problems of all rows start from the null
    models, whose gradients and curvatures are known, those of a training set from where
    the same penalty ended on all rows, or from the null model if that is nearer. A
    problem stays at the point that met the optimality conditions best."""
    import numpy as np

    n_heads, width = heads.mean.shape
    n_lams = len(l1)
    b, b0 = np.zeros((n_heads, n_lams, width)), np.repeat(heads.start[:, None], n_lams, axis=1)
    passes = 0
    if width <= NEWTON_SLOTS:
        rate = 1 / (1 + np.exp(-heads.start))
        # the intercept's curvature, its products with the slots, and theirs without it
        own, among = rate * (1 - rate), 4 * (rate * (1 - rate))[:, None, None] * heads.bound
        terms = groups, weights, l1, l2

        def null(h):
            curve = np.full(n_lams, own[h]), np.zeros((n_lams, width)), np.tile(among[h], (n_lams, 1, 1))
            return np.zeros(n_lams), np.tile(-heads.null_gradient[h], (n_lams, 1)), curve

        every = np.arange(n_lams)
        off = _off_optimum(b[0], *null(0)[:2], *terms)
        b[0], b0[0], passes = _newton_steps(
            blocks, heads, np.zeros(n_lams, dtype=int), every, b[0], b0[0], null(0), off, terms, origin, 1e-4
        )
        if n_heads > 1:
            starts, at, more = _from_whole(blocks, heads, b[0], b0[0], origin)
            passes += more
            kept = []
            for h in range(1, n_heads):
                (own_b, own_b0), (g0, g, curve), bare = starts[h - 1], at[h - 1], null(h)
                off, now = _off_optimum(b[h], *bare[:2], *terms), _off_optimum(own_b, g0, g, *terms)
                good = now < off
                b[h][good], b0[h][good] = own_b[good], own_b0[good]
                kept.append([
                    np.where(good, now, off),
                    *(np.where(good.reshape(-1, *[1] * (x.ndim - 1)), x, y)
                      for x, y in zip((g0, g, *curve), (*bare[:2], *bare[2]), strict=True)),
                ])
            off, g0, g, *curve = (np.concatenate(x) for x in zip(*kept, strict=True))
            rest, rest0, more = _newton_steps(
                blocks, heads, np.repeat(np.arange(1, n_heads), n_lams), np.tile(every, n_heads - 1),
                b[1:].reshape(-1, width), b0[1:].ravel(), (g0, g, tuple(curve)), off, terms, origin, 1e-9,
            )
            b[1:], b0[1:] = rest.reshape(b[1:].shape), rest0.reshape(b0[1:].shape)
            passes += more
    return b, b0, passes


def _newton_steps(
    blocks: RowBlocks, heads: _Heads, head, lam, b, b0, local, off, terms, origin, inner
):
    """Proximal Newton steps of some problems, by head and penalty, from points of which
    ``local`` holds gradients and curvatures; ``off`` is how far these are off, ``inner``
    how well the first step is solved."""
    import numpy as np

    groups, weights, l1, l2 = terms
    l1, l2, b, b0, off = l1[lam], l2[lam], b.copy(), b0.copy(), off.copy()
    g0, g, curve = local
    left, passes = np.arange(len(head)), 0
    for _ in range(NEWTON_STEPS):
        at, at0, h = b[left], b0[left], head[left]
        new = _curved_step(curve[2], g, at, groups, weights, l1[left], l2[left], heads.unit[h], inner)
        new0 = at0 - (g0 + (curve[1] * (new - at)).sum(axis=1)) / curve[0]
        moved = np.maximum(np.abs((new - at) * heads.unit[h]).max(axis=1), np.abs(new0 - at0))
        fine = np.isfinite(moved)
        close = fine & (moved <= NEWTON_CLOSE)
        b[left[close]], b0[left[close]] = new[close], new0[close]
        busy = fine & ~close
        left, new, new0, h = left[busy], new[busy], new0[busy], h[busy]
        if not len(left):
            break
        inner = max(1e-3 * float(moved[busy].max()) ** 2, 1e-9)
        g0, g, curve, more = _curvatures(blocks, heads, h, new0, new, origin)
        passes += more
        now = _off_optimum(new, g0, g, groups, weights, l1[left], l2[left])
        better = now < off[left]
        off[left] = np.where(better, now, off[left])
        left = left[better]
        b[left], b0[left] = new[better], new0[better]
        g0, g, curve = g0[better], g[better], tuple(c[better] for c in curve)
    return b, b0, passes


def _off_optimum(b, g0, g, groups, weights, l1, l2):
    """How far a plain proximal gradient step goes from each problem's point."""
    import numpy as np

    u = (b - g - l2[:, None] * b).T
    size = _norms(u, groups)
    keep = np.maximum(size - l1 * np.array(weights)[:, None], 0.0) / np.where(size > 0, size, 1.0)
    out = g0**2
    for i, group in enumerate(groups):
        out = out + ((b.T[group] - u[group] * keep[i]) ** 2).sum(axis=0)
    return np.sqrt(out)


def _curvatures(blocks: RowBlocks, heads: _Heads, head, b0, b, origin):
    """Of each problem at its point: gradient of the intercept and of the slots; the
    curvature of the intercept, its products with the slots, and those among the slots
    once the intercept follows them; and the passes that took.

    Gradients are exact sums. Curvatures only shape the next step, so they are summed
    in single precision."""
    import numpy as np

    width = b.shape[1]
    size = 1 + width + triangle(width + 1)
    share = max(1, TOGETHER // size)
    parts = [slice(i, i + share) for i in range(0, len(head), share)]
    found = []
    for part in parts:
        h = head[part]
        block = _bent_block(heads, _plain(heads, h, b0[part], b[part], origin), origin, heads.out[h])
        sums = blocks.sum(block, size * len(h), min(ABREAST, len(h)))
        found.append(_local(heads, h, sums.reshape(size, len(h)), origin))
    g0, g, *curve = (np.concatenate(x) for x in zip(*found, strict=True))
    return g0, g, tuple(curve), len(parts)


def _plain(heads: _Heads, head, b0, b, origin):
    """Coefficients (slot, problem) for unscaled columns counted from ``origin``."""
    import numpy as np

    slopes = b / heads.scale[head]
    free = b0 - (slopes * (heads.mean[head] - origin)).sum(axis=1)
    return np.concatenate([free[None], slopes.T])


def _bent_block(heads: _Heads, coefs, origin, out):
    """For ``RowBlocks.sum``: by problem the sums over the rows outside its fold ``out``
    that gradient and curvature are worked out from in ``_local``."""
    width = len(coefs) - 1
    mean, scale = heads.mean[0] - origin, heads.scale[0]

    def block(x, y, fold):
        import numpy as np

        pairs = np.triu_indices(width + 1)
        x = x.less(origin).filled()
        ones = np.ones((len(x), 1), dtype=np.float32)
        full = np.hstack([ones, ((x.x - mean) / scale).astype(np.float32)])
        products = (full[:, pairs[0]] * full[:, pairs[1]]).T
        sums = np.empty((1 + width + len(products), len(out)))
        for some in _abreast(len(out)):
            mu = _rates(x, coefs[:, some])
            weight = mu.astype(np.float32)
            weight -= weight * weight
            mu -= y[:, None]
            for rows, own in _held_parts(fold, out[some]):
                mu[rows, own] = weight[rows, own] = 0.0
            sums[0, some] = mu.sum(axis=0)
            sums[1 : 1 + width, some] = x.sums(mu)
            sums[1 + width :, some] = products @ weight
        return sums.ravel()

    return block


def _local(heads: _Heads, h, sums, origin):
    """Gradients and curvatures of problems of heads ``h`` from the sums of
    ``_bent_block`` (figure, problem)."""
    import numpy as np

    width = heads.mean.shape[1]
    pairs = np.triu_indices(width + 1)
    scale = heads.scale[0]
    g0, g = heads.gradient(sums[: 1 + width], h, origin)
    matrix = np.empty((len(h), width + 1, width + 1))
    matrix[:, pairs[0], pairs[1]] = matrix[:, pairs[1], pairs[0]] = (sums[1 + width :] / heads.n[h]).T
    # from columns about the first head's means to those of the problem's own head
    turn = np.zeros_like(matrix)
    turn[:, 0, 0] = 1.0
    slot = np.arange(width)
    turn[:, slot + 1, slot + 1] = scale / heads.scale[h]
    turn[:, 1:, 0] = (heads.mean[0] - heads.mean[h]) / heads.scale[h]
    turn[:, 1:][heads.constant[h]] = 0.0
    matrix = turn @ matrix @ turn.transpose(0, 2, 1)
    # a little more, so that rounding leaves no direction bent downwards
    at = np.arange(width + 1)
    matrix[:, at, at] *= 1 + 1e-5
    own = np.maximum(matrix[:, 0, 0], 1e-12)
    with_slots = matrix[:, 0, 1:]
    lost = with_slots / own[:, None]
    among = matrix[:, 1:, 1:] - with_slots[:, :, None] * lost[:, None, :]
    # gradients of the slots once the intercept follows them
    return g0, g - lost * g0[:, None], own, with_slots, among


def _from_whole(blocks: RowBlocks, heads: _Heads, b, b0, origin):
    """The points of the first head's problems, and gradients and curvatures there, for
    every other head; and the passes that took.

    A row lies in one fold alone. So a pass sums up its folds apart, at the points of
    the problems of all rows, and a training set's sums are those of its folds: all
    heads are served for what the first one costs."""
    import numpy as np

    width, folds = b.shape[1], len(heads.n) - 1
    size = 1 + width + triangle(width + 1)
    share = max(1, TOGETHER // (size * folds))
    coefs = _plain(heads, np.zeros(len(b), dtype=int), b0, b, origin)
    slopes = coefs[1:].T
    parts = [slice(i, i + share) for i in range(0, len(b), share)]
    others = 1.0 - np.eye(folds)
    sums = []
    for part in parts:
        some = coefs[:, part]
        whole = _bent_block(heads, some, origin, np.full(some.shape[1], -1))

        def block(x, y, fold, whole=whole, shape=(folds, size * some.shape[1])):
            import numpy as np

            out = np.zeros(shape)
            for f in np.unique(fold):
                rows = fold == f
                out[f] = whole(x.where(rows), y[rows], fold[rows])
            return out.ravel()

        side_by_side = max(1, min(ABREAST, some.shape[1]) // folds)  # rows of a fold are so few
        found = blocks.sum(block, folds * size * some.shape[1], side_by_side)
        sums.append((others @ found.reshape(folds, -1)).reshape(folds, size, -1))
    sums = np.concatenate(sums, axis=2)
    starts, at = [], []
    for h in range(1, folds + 1):
        head = np.full(len(b), h)
        own0, own, *curve = _local(heads, head, sums[h - 1], origin)
        at.append((own0, own, tuple(curve)))
        # a column constant within the set goes to the intercept
        starts.append((
            np.where(heads.constant[h], 0.0, slopes * heads.scale[h]),
            coefs[0] + slopes @ (heads.mean[h] - origin),
        ))
    return starts, at, len(parts)


def _curved_step(curve, g, start, groups, weights, l1, l2, unit, tol, sweeps=2_000):
    """Minimize each problem's own quadratic plus its penalty: a linear system with
    squares alone as penalty, else coordinate descent, one group of slots at a time, for
    all problems at once; problems leave as they settle."""
    import numpy as np

    out = start.copy()
    smooth = (l1 == 0) & (l2 > 0)
    if smooth.any():
        c = curve[smooth]
        right = (c @ start[smooth][:, :, None])[:, :, 0] - g[smooth]
        c = c + l2[smooth, None, None] * np.eye(len(unit[0]))
        out[smooth] = np.linalg.solve(c, right[:, :, None])[:, :, 0]
    left = np.flatnonzero(~smooth)
    if not len(left):
        return out
    curve = np.ascontiguousarray(curve[left].transpose(1, 2, 0))  # slot, slot, problem
    bends = np.empty((len(groups), len(left)))
    for i, group in enumerate(groups):
        block = curve[np.ix_(group, group)]
        bends[i] = np.linalg.eigvalsh(block.transpose(2, 0, 1))[:, -1] if len(group) > 1 else block[0, 0]
    bends = np.where(bends > 0, bends, 1.0)
    b, r, l1, l2, unit = start[left].T.copy(), g[left].T.copy(), l1[left], l2[left], unit[left].T
    for sweep in range(1, sweeps + 1):
        change = np.zeros(len(left))
        for i, group in enumerate(groups):
            u = bends[i] * b[group] - r[group]
            size = np.abs(u[0]) if len(group) == 1 else np.sqrt((u**2).sum(axis=0))
            keep = np.maximum(size - l1 * weights[i], 0.0) / np.where(size > 0, size, 1.0)
            delta = u * (keep / (bends[i] + l2)) - b[group]
            if not delta.any():
                continue
            b[group] += delta
            for j, d in zip(group, delta):
                r += curve[j] * d
            np.maximum(change, np.abs(delta * unit[group]).max(axis=0), out=change)
        if sweep % 16 == 0 or change.max() < tol:
            busy = ~(change < tol)
            out[left] = b.T
            if not busy.any():
                break
            if not busy.all():
                left, b, r, unit = left[busy], b[:, busy], r[:, busy], unit[:, busy]
                l1, l2, bends = l1[busy], l2[busy], bends[:, busy]
                curve = np.ascontiguousarray(curve[:, :, busy])
    out[left] = b.T
    return out


def _largest_curvature(bound, groups):
    """By group and head: the largest eigenvalue of the group's own block."""
    import numpy as np

    out = np.empty((len(groups), len(bound)))
    for i, group in enumerate(groups):
        own = bound[:, group][:, :, group]
        out[i] = np.linalg.eigvalsh(own)[:, -1] if len(group) > 1 else own[:, 0, 0]
    return np.where(out > 0, out, 1.0)


def _norms(r, groups):
    """Of each group's rows of ``r`` (slot, problem)."""
    import numpy as np

    if all(len(g) == 1 for g in groups):
        return np.abs(r[[g[0] for g in groups]])
    return np.array([np.sqrt((r[g] ** 2).sum(axis=0)) for g in groups])


def _proximal(heads: _Heads, top, head, g, start, groups, weights, l1, l2, before, tol, sweeps=1_000):
    """Minimize the bounded quadratic plus the penalty for all problems. Problems
    that together need matrices of ``TOGETHER`` numbers at most go through the sweeps
    at once. Also says which ones settled within ``sweeps``; the others go on from
    where they are in the caller's next pass."""
    import numpy as np

    weight = np.array(weights)[:, None]
    done, solved = start.T.copy(), np.zeros(len(l1), dtype=bool)
    # slots that are not zero, and those the strong rule keeps
    works = (_norms(done, groups) > 0) | (_norms(g.T, groups) >= (2 * l1 - before) * weight)
    # neighbours on a path have like sets of slots
    order = np.lexsort((head, -l1))
    smooth = (l1 == 0) & (l2 > 0)
    if smooth.any():
        done[:, smooth] = heads.ridge_step(head[smooth], g[smooth], start[smooth], l2[smooth]).T
        solved |= smooth
        order = order[~smooth[order]]
    share = max(len(heads.n), TOGETHER // max(1, len(done)) ** 2)
    for i in range(0, len(order), share):
        left = order[i : i + share]
        while len(left):
            done[:, left], solved[left] = _sweeps(
                heads, top, head[left], g[left].T, start[left].T, done[:, left], works[:, left],
                groups, weights, l1[left], l2[left], tol, sweeps,
            )
            # every slot left out must be zero at the minimum as well
            moved = heads.bent(head[left], (done[:, left] - start[left].T).T).T
            size = _norms(g[left].T + moved, groups)
            wrong = ~works[:, left] & (size > l1[left] * weight * (1 + 1e-12))
            works[:, left] |= wrong
            left = left[wrong.any(axis=0)]
    return done.T, solved


def _sweeps(heads, top, head, g, start, b, works, groups, weights, l1, l2, tol, sweeps):
    """Coordinate descent, one group of slots at a time, for all problems at once, each
    on the groups it ``works`` on. Slots come first and problems last; problems leave
    the loop as they settle. Curvature matrices are shared, never copied by problem:
    groups are taken ``SLOTS`` slots or so at a time, what their steps do to the other
    slots is one matrix product for each training set."""
    import numpy as np

    used = np.flatnonzero(works.any(axis=1))
    if not len(used):
        return b, np.ones(len(l1), dtype=bool)
    held = np.concatenate([groups[i] for i in used]).astype(int)
    blocks, own, at = [], [], 0  # of each block its groups as (row of works, slots in the block)
    first = 0
    for k, i in enumerate(used):
        own.append((k, list(range(at - first, at - first + len(groups[i])))))
        at += len(groups[i])
        if at - first >= SLOTS or k == len(used) - 1:
            blocks.append((slice(first, at), own))
            own, first = [], at
    whole = len(held) == len(g) and (held == np.arange(len(g))).all()
    bound = heads.bound if whole else heads.bound[:, held][:, :, held]
    done, solved = b.copy(), np.zeros(len(l1), dtype=bool)
    moved = heads.bent(head, (b - start).T).T
    left = np.argsort(head, kind="stable")  # problems of one training set side by side
    b, r = b[np.ix_(held, left)], (g + moved)[np.ix_(held, left)]
    unit = np.sqrt(np.einsum("hjj->jh", bound))
    curvature, works, weight = top[used], works[np.ix_(used, left)], np.array(weights)[used]
    l1, l2, head = l1[left], l2[left], head[left]
    parts = close = None
    for sweep in range(1, sweeps + 1):
        if parts is None:  # problems are as they were after the last that left
            sets, froms = np.unique(head, return_index=True)
            parts = list(zip(sets, map(slice, froms, [*froms[1:], len(head)])))
            close = [bound[:, s, s].transpose(1, 2, 0)[:, :, head] for s, _ in blocks]
            units, bends = unit[:, head], curvature[:, head]
        change = np.zeros(len(left))
        for (span, members), near in zip(blocks, close):
            local, steps = r[span].copy(), np.zeros((span.stop - span.start, len(left)))
            for k, slots in members:
                rows = slice(span.start + slots[0], span.start + slots[-1] + 1)
                u = bends[k] * b[rows] - local[slots]
                size = np.abs(u[0]) if len(slots) == 1 else np.sqrt((u**2).sum(axis=0))
                keep = np.maximum(size - l1 * weight[k], 0.0) / np.where(size > 0, size, 1.0)
                delta = (u * (keep / (bends[k] + l2)) - b[rows]) * works[k]
                if not delta.any():
                    continue
                b[rows] += delta
                steps[slots] = delta
                for j, d in zip(slots, delta):
                    local += near[j] * d
                np.maximum(change, np.abs(delta * units[rows]).max(axis=0), out=change)
            for h, part in parts:
                r[:, part] += bound[h][:, span] @ steps[:, part]
        busy = change >= tol
        if sweep % 8 == 0 or not busy.any():
            done[np.ix_(held, left)] = b
            solved[left[~busy]] = True
            if not busy.any():
                break
            if not busy.all():
                left, l1, l2, head = left[busy], l1[busy], l2[busy], head[busy]
                b, r, works, parts = b[:, busy], r[:, busy], works[:, busy], None
    done[np.ix_(held, left)] = b
    return done, solved


def _gradient_sums(blocks: RowBlocks, coefs, out, origin):
    """Per problem: sum of (mu - y) * (1, x) over the rows outside its fold, x counted
    from ``origin``."""
    shape = coefs.shape

    def block(x, y, fold):
        import numpy as np

        x = x.less(origin).filled()
        sums = np.empty(shape)
        for some in _abreast(shape[1]):
            residual = _rates(x, coefs[:, some])
            residual -= y[:, None]
            for rows, own in _held_parts(fold, out[some]):
                residual[rows, own] = 0.0
            sums[0, some], sums[1:, some] = residual.sum(axis=0), x.sums(residual)
        return sums.ravel()

    return blocks.sum(block, shape[0] * shape[1], min(ABREAST, shape[1])).reshape(shape)


def _abreast(problems: int):
    return [slice(i, i + ABREAST) for i in range(0, problems, ABREAST)]


def _rates(x, coefs):
    """Rate of the outcome by row and problem."""
    import numpy as np

    rates = x.times(-coefs[1:])
    rates -= coefs[0]
    with np.errstate(over="ignore"):
        np.exp(rates, out=rates)
    rates += 1
    return np.reciprocal(rates, out=rates)


def _held_parts(fold, out):
    """Rows of a block and the problems (side by side, by head) that leave them out."""
    import numpy as np

    for f in np.unique(fold):
        own = slice(*np.searchsorted(out, [f, f + 1]))
        if own.stop > own.start:
            yield np.flatnonzero(fold == f), own


def _held_out(blocks: RowBlocks, heads: _Heads, raw):
    """Mean held-out deviance per penalty and its standard error over folds."""
    import numpy as np

    n_heads, n_lams, width = raw.shape
    coefs = raw[1:]  # fold set f at position f

    def block(x, y, fold):
        import numpy as np

        loss = np.zeros((n_heads - 1, n_lams))
        for f in np.unique(fold):
            rows = fold == f
            eta = x.where(rows).filled().times(coefs[f][:, 1:].T) + coefs[f][:, 0]
            loss[f] = (np.logaddexp(0, eta) - y[rows, None] * eta).sum(axis=0)
        return loss.ravel()

    sums = 2 * blocks.sum(block, (n_heads - 1) * n_lams, n_lams).reshape(n_heads - 1, n_lams)
    n = heads.held_n[:, None]
    mean = sums.sum(axis=0) / n.sum()
    filled = heads.held_n > 0
    per_fold = sums[filled] / n[filled]
    spread = (n[filled] * (per_fold - mean) ** 2).sum(axis=0) / n.sum()
    error = np.sqrt(spread / max(int(filled.sum()) - 1, 1))
    return [(float(m), float(e)) for m, e in zip(mean, error)]
