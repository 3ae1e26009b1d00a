"""Wide designs, shared matrices, trees as expressions, stored models."""

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from ledgerloom.models import glm, newton, passes, penalized, scoring, stored
from ledgerloom.models.design import assemble, design
from ledgerloom.models.group_lasso import group_lasso_cv
from ledgerloom.models.passes import Block, RowBlocks, packed, unpacked
from ledgerloom.models.penalized import coef_path, penalized_cv
from ledgerloom.models.split import fold_of
from ledgerloom.models.stepwise import stepwise, stepwise_all
from ledgerloom.models.wide import wide_design, wide_path
from ledgerloom.models.tree import cut_off, nodes_of, tree_column, tree_cv


def rows_of(spark, n, levels, seed=0):
    rng = np.random.default_rng(seed)
    effect = {i: rng.normal() for i in range(levels)}
    rows = []
    for i in range(n):
        town, kind, age = int(rng.integers(levels)), int(rng.integers(4)), float(rng.normal(40, 10))
        p = 1 / (1 + math.exp(-(effect[town] + 0.05 * (age - 40) + (kind == 2))))
        rows.append((i, f"t{town:04d}", f"k{kind}", age, float(rng.integers(0, 3)), int(rng.random() < p)))
    return spark.createDataFrame(
        rows, "row_id long, town string, kind string, age double, few double, label int"
    ).repartition(3).cache()


def full_matrix(d):
    rows = d.matrix(None, "row_id").orderBy("row_id").collect()
    return np.array([r.x for r in rows]), np.array([r.y for r in rows])


def kkt(x, y, row, lam, alpha):
    s = x.std(0)
    s[s == 0] = 1.0
    z, beta = (x - x.mean(0)) / s, row[1:] * s
    p = 1 / (1 + np.exp(-(x @ row[1:] + row[0])))
    g = z.T @ (p - y) / len(y) + lam * (1 - alpha) * beta
    at_zero = np.maximum(np.abs(g) - lam * alpha, 0)
    return max(np.where(beta != 0, np.abs(g + lam * alpha * np.sign(beta)), at_zero).max(), abs((p - y).mean()))


# --- row blocks


def test_blocks_equal_matrix_products():
    rng = np.random.default_rng(1)
    n, width, dense = 70, 11, np.array([0, 5, 10])
    x, a, b = rng.normal(size=(n, 3)), rng.integers(0, 5, n), rng.integers(0, 5, n)
    one, two = np.flatnonzero(a < 4), np.flatnonzero(b < 4)
    full = np.zeros((n, width))
    full[:, dense] = x
    full[one, 1 + a[one]] = 1
    full[two, 6 + b[two]] = 1
    layers = [slice(0, len(one)), slice(len(one), len(one) + len(two))]
    block = Block(
        x, dense, np.concatenate([one, two]), np.concatenate([1 + a[one], 6 + b[two]]), layers, width
    )
    c, r, w, mask = rng.normal(size=(width, 4)), rng.normal(size=(n, 4)), rng.random(n), rng.random(n) < 0.4
    assert np.allclose(block.times(c), full @ c)
    assert np.allclose(block.sums(r), full.T @ r)
    assert np.allclose(block.cross(w), full.T @ (full * w[:, None]))
    assert np.allclose(block.where(mask).cross(), full[mask].T @ full[mask])
    some = [6, 10, 2, 0]
    assert np.allclose(block.pick(some).cross(w), full[:, some].T @ (full[:, some] * w[:, None]))
    shift = np.where(np.isin(np.arange(width), dense), rng.normal(size=width), 0.0)
    assert np.allclose(block.less(shift).sums(r), (full - shift).T @ r)
    assert np.array_equal(unpacked(packed(block.cross()), width), block.cross())
    empty = block.where(np.zeros(n, bool))
    assert np.allclose(empty.cross(), 0) and empty.times(c).shape == (0, 4)


def test_a_factor_of_many_levels_costs_a_row_two_numbers(spark):
    df = rows_of(spark, 3_000, 2_000)
    d = design(df, "label", ["town", "kind", "age"])
    rows = d.rows().collect()
    assert len(rows) == 3_000 and len(d.names) > 1_000
    assert all(len(r.x) == 1 and len(r.slots) <= 2 for r in rows)
    coded = {i: r for i, r in enumerate(d.matrix().collect())}
    for i, r in enumerate(rows):
        dense = np.zeros(len(d.names))
        dense[d.dense], dense[r.slots] = r.x, 1.0
        assert np.array_equal(dense, np.array(coded[i].x)) and r.y == coded[i].y
    blocks = RowBlocks(d.rows().withColumn("fold", F.lit(0)), len(d.names), d.dense)

    def counts(x, y, fold):
        return x.sums(np.ones((len(y), 1)))[:, 0]

    full = np.array([coded[i].x for i in range(3_000)])
    assert blocks.sum(counts, len(d.names)) == pytest.approx(full.sum(0))


def test_factor_rows_give_the_fits_of_dense_rows(spark):
    df = rows_of(spark, 900, 12)
    d = design(df, "label", ["age", "town", "kind"])
    wide = d.usable(df)
    for name in d.names:
        wide = wide.withColumn(f"n_{name}", d.columns()[name])
    plain = assemble(wide, "label", [f"n_{n}" for n in d.names])
    a, b = newton.fit_matrix(d), newton.fit_matrix(plain)
    assert a.estimates == pytest.approx(b.estimates, abs=1e-7)
    assert a.std_errors == pytest.approx(b.std_errors, rel=1e-5)
    lambdas = [0.05, 0.01]
    for alpha in (0.0, 0.5):
        p = penalized_cv(d, "row_id", alpha, folds=2, lambdas=lambdas)
        q = penalized_cv(plain, "row_id", alpha, folds=2, lambdas=lambdas)
        assert p.coefs == pytest.approx(q.coefs, abs=1e-5)
        assert [c[0] for c in p.cv] == pytest.approx([c[0] for c in q.cv], rel=1e-6)


# --- penalties on many slots


@pytest.mark.parametrize("alpha", [0.5, 1.0])
def test_five_hundred_slots_share_one_matrix_a_set(spark, monkeypatch, alpha):
    """Eleven training sets have eleven matrices, problems have none of their own, and
    every slot left out by screening meets the optimality conditions."""
    d = design(rows_of(spark, 2_500, 510), "label", ["town", "kind", "age", "few"], intercept=False)
    width, seen = len(d.names), []
    assert width > 500
    before = penalized._Heads.__init__

    def kept(self, *args, **kwargs):
        before(self, *args, **kwargs)
        seen.append(self.bound)

    monkeypatch.setattr(penalized._Heads, "__init__", kept)
    peaks = []
    step = penalized._proximal

    def watched(*args, **kwargs):
        tracemalloc.start()
        out = step(*args, **kwargs)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        return out

    monkeypatch.setattr(penalized, "_proximal", watched)
    path = penalized_cv(d, "row_id", alpha, folds=10, n_lambda=8, ratio=0.2)
    assert [b.shape for b in seen] == [(11, width, width)]
    # a matrix of its own for each of the 88 problems would take ten times as much
    assert max(peaks) < 5 * seen[0].nbytes < 88 * 8 * width**2
    x, y = full_matrix(d)
    for lam, row in zip(path.lambdas, path.coefs):
        assert kkt(x, y, row, lam, alpha) < 1e-6
    assert 0 < np.count_nonzero(path.coefs[3][1:]) < width


def test_screening_changes_no_coefficient(spark, monkeypatch):
    d = design(rows_of(spark, 800, 25), "label", ["town", "kind", "age"], intercept=False)
    screened = penalized_cv(d, "row_id", 1.0, folds=2, n_lambda=6, ratio=0.05, tol=1e-8)
    step = penalized._proximal

    def whole(heads, top, head, g, start, groups, weights, l1, l2, before, tol):
        return step(heads, top, head, g, start, groups, weights, l1, l2, before + 1e9, tol)

    monkeypatch.setattr(penalized, "_proximal", whole)
    unscreened = penalized_cv(d, "row_id", 1.0, folds=2, n_lambda=6, ratio=0.05, tol=1e-8)
    assert screened.coefs == pytest.approx(unscreened.coefs, abs=1e-6)
    assert screened.best == unscreened.best
    monkeypatch.setattr(penalized, "_proximal", step)
    monkeypatch.setattr(penalized, "TOGETHER", 1)
    apart = penalized_cv(d, "row_id", 1.0, folds=2, n_lambda=6, ratio=0.05, tol=1e-8)
    assert apart.coefs == pytest.approx(screened.coefs, abs=1e-6)


def test_one_huge_value_spoils_only_the_sets_that_hold_it(spark):
    df = rows_of(spark, 600, 5)
    one = fold_of("row_id", 3)
    where = df.where(one == 1).agg(F.min("row_id")).first()[0]
    spoilt = df.withColumn("age", F.when(F.col("row_id") == where, F.lit(1e12)).otherwise(F.col("age")))
    lambdas = [0.01]
    path = penalized_cv(assemble(spoilt, "label", ["age", "few"]), "row_id", 0.5, folds=3, lambdas=lambdas)
    alone = coef_path(
        assemble(df.where(one != 1), "label", ["age", "few"]), "row_id", 0.5, lambdas
    )
    assert alone.coefs[0][1] != 0
    seen = []
    heads = penalized._Heads
    d = assemble(spoilt, "label", ["age", "few"])
    rows = d.rows(None, "row_id").withColumn("fold", one)
    blocks = RowBlocks(rows, 2, d.dense)
    found = heads(*penalized._moments(blocks, 3), 3, True)
    without = df.where(one != 1).agg(F.stddev_pop("age"), F.avg("age")).first()
    # the set without fold 1 is as precise as if the value did not exist
    assert found.scale[2][0] == pytest.approx(without[0], rel=1e-9)
    assert found.mean[2][0] == pytest.approx(without[1], rel=1e-9)
    assert not found.constant.any() and not seen and path.coefs.shape == (1, 3)


def test_group_lasso_over_factor_slots(spark):
    d = design(rows_of(spark, 800, 6), "label", ["town", "kind", "age", "few"], intercept=False)
    groups = {t: [d.names[s] for s in slots] for t, slots in d.terms.items()}
    path = group_lasso_cv(d, "row_id", groups, folds=2, n_lambda=6)
    x, y = full_matrix(d)
    for lam, row in zip(path.lambdas, path.coefs):
        g = x.T @ (1 / (1 + np.exp(-(x @ row[1:] + row[0]))) - y) / len(y)
        for slots in d.terms.values():
            b, w = row[1:][slots], lam * math.sqrt(len(slots))
            norm = np.linalg.norm(b)
            gap = np.abs(g[slots] + w * b / norm).max() if norm else max(np.linalg.norm(g[slots]) - w, 0)
            assert gap < 1e-5


# --- sums bounded by bytes


def test_partial_sums_are_added_within_bounded_bytes(spark, monkeypatch):
    """64 parts of 2 MB each: never more than a few at once on the driver."""
    rows = spark.range(0, 640, 1, 64).select(
        F.array(F.col("id").cast("double")).alias("x"), F.lit(1.0).alias("y"), F.lit(0).alias("fold")
    )
    size = 250_000
    monkeypatch.setattr(passes, "FAN_BYTES", 8 << 20)
    assert passes.fan_of(size) == 4 and passes.fan_of(10) == passes.FAN and passes.fan_of(10**9) == 2

    def block(x, y, fold):
        return np.full(size, x.sum())

    blocks = RowBlocks(rows)
    tracemalloc.start()
    total = blocks.sum(block, size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == pytest.approx(np.full(size, 640 * 639 / 2))
    assert peak < 40 << 20 < 64 * 8 * size


def test_candidates_go_in_batches(spark, monkeypatch):
    df = rows_of(spark, 500, 4)
    d = design(df, "label", ["town", "kind", "age", "few"])
    together = {k: s.fit for k, s in stepwise_all(d).items()}
    assert newton.batches_of([5, 5, 5, 50, 1], 10) == [range(0, 2), range(2, 3), range(3, 4), range(4, 5)]
    assert newton.batches_of([], 10) == []
    monkeypatch.setattr(newton, "PASS_BYTES", 8)
    for direction, fit in together.items():
        alone = stepwise(d, direction=direction).fit
        assert alone.terms == fit.terms and alone.estimates == pytest.approx(fit.estimates)


# --- trees


def test_a_tree_cut_off_is_the_tree_fitted_there(spark):
    d = design(rows_of(spark, 1_200, 9), "label", ["town", "kind", "age", "few"])
    rows = d.frame.withColumn("fold", fold_of("row_id", 3)).cache()
    tree = DecisionTreeClassifier(featuresCol="features", labelCol="label", seed=100)
    for f in range(2):
        inside = rows.where(F.col("fold") != f)
        deep = nodes_of(tree.fit(inside, {tree.maxDepth: 6, tree.minInfoGain: 0.0}), d.names)
        for depth, gain in ((2, 0.0), (4, 0.005), (6, 0.0), (6, 0.02), (1, 0.0)):
            own = tree.fit(inside, {tree.maxDepth: depth, tree.minInfoGain: gain})
            said = tree_column(cut_off(deep, depth, gain), d.columns(), "prediction").alias("said")
            wrong = own.transform(rows).where(F.col("prediction") != said)
            assert wrong.count() == 0


def test_tree_grid_equals_a_fit_for_each_point(spark):
    d = design(rows_of(spark, 700, 5), "label", ["town", "kind", "age"])
    fit = tree_cv(d, "row_id", depths=(1, 3), gains=(0.0, 0.01))
    rows = d.frame.withColumn("fold", fold_of("row_id", 3)).cache()
    tree = DecisionTreeClassifier(featuresCol="features", labelCol="label", seed=100)
    for r in fit.results(spark).collect():
        shares = []
        for f in range(3):
            own = tree.fit(
                rows.where(F.col("fold") != f),
                {tree.maxDepth: r.max_depth, tree.minInfoGain: r.min_info_gain},
            )
            hit = F.avg((F.col("prediction") == F.col("label")).cast("int"))
            shares.append(own.transform(rows.where(F.col("fold") == f)).agg(hit).first()[0])
        assert r.accuracy == pytest.approx(np.mean(shares), abs=1e-12)


# --- stored models


def test_stored_models_score_as_fitted_ones(spark, tmp_path):
    df = rows_of(spark, 700, 5)
    d = design(df, "label", ["town", "kind", "age"])
    fit = glm.fit_logistic(d)
    coefs = {r.term: r.estimate for r in fit.coefficients(spark).collect()}
    tree = tree_cv(d, "row_id", depths=(3,), gains=(0.0,))
    rows = stored.coefficient_rows("glm", d, coefs) + stored.tree_rows("tree", d, tree.nodes)
    stored.model_table(spark, rows).write.parquet(str(tmp_path / "models"))
    table = spark.read.parquet(str(tmp_path / "models"))
    fitted = scoring.score_fitted(df, d, {"glm": fit.model, "tree": tree.model.bestModel}, "row_id")
    by_table = stored.score_stored(df, table, "row_id").withColumnsRenamed({"glm": "g", "tree": "t"})
    both = fitted.join(by_table, "row_id").collect()
    assert len(both) == 700
    for r in both:
        assert r.g == pytest.approx(r.glm, abs=1e-12) and r.t == pytest.approx(r.tree, abs=1e-12)
    holes = df.withColumn("age", F.when(F.col("row_id") > 4, F.col("age")))
    assert stored.known_rows(holes, table, {"kind": ["k1", "k2", "k3", "k0"]}).count() == 695


# --- levels as a table


@pytest.mark.parametrize("alpha,intercept", [(1.0, True), (0.5, False)])
def test_wide_path_equals_the_path_on_a_matrix(spark, alpha, intercept):
    df = rows_of(spark, 500, 12)
    terms, lambdas = ["town", "age", "kind"], [0.05, 0.01]
    wide = wide_path(wide_design(df, "label", terms, intercept), alpha, lambdas, tol=1e-8)
    d = design(df, "label", terms, intercept)
    path = coef_path(d, "row_id", alpha, lambdas, tol=1e-9)
    names = ["(Intercept)", *d.names]
    assert wide.design.width == len(d.names)
    found = {(r["lambda"], r.term): r.coefficient for r in wide.path(spark).collect()}
    for lam, row in zip(lambdas, path.coefs):
        for name, value in zip(names, row):
            assert found.get((lam, name), 0.0) == pytest.approx(value, abs=2e-5)


def test_fifty_thousand_levels(spark):
    """Fitted without the levels on the driver; every slot meets its condition."""
    n, levels = 120_000, 50_000
    df = spark.range(n).select(
        F.concat(F.lit("u"), F.col("id") % levels).alias("user"),
        (F.xxhash64("id") % 100 / 25.0).alias("x"),
        ((F.col("id") % levels < 40) | (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 0)).cast("int").alias("y"),
    )
    d = wide_design(df, "y", ["user", "x"], intercept=False)
    assert d.width == levels + 1 and d.levels.count() == levels
    lam = 0.0025
    path = wide_path(d, 1.0, [lam], tol=1e-5)
    row = path.coefs[0]
    found = {r.term for r in path.path(spark).where("coefficient > 0 and term like 'user%'").collect()}
    assert {f"user_u{i}" for i in range(40)} <= found and len(found) < 20_000
    sums = df.withColumn("p", F.lit(0.0))
    by_user = {r.user: (r.n, r.y) for r in sums.groupBy("user").agg(F.count("y").alias("n"), F.sum("y").alias("y")).collect()}
    names = {r.slot: r.level for r in d.levels.collect()}
    xs = {}
    for r in df.select("user", "x").collect():
        xs.setdefault(r.user, []).append(r.x)
    worst = 0.0
    for slot in range(1, d.width, 97):
        user = names[slot]
        count, hits = by_user[user]
        p = sum(1 / (1 + math.exp(-(row[0] + row[1] * x + row[1 + slot]))) for x in xs[user])
        share = count / n
        g = (p - hits) / n / math.sqrt(share * (1 - share))
        worst = max(worst, abs(g + lam * np.sign(row[1 + slot])) if row[1 + slot] else abs(g) - lam)
    assert worst < 1e-4
