import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import RFormula
from pyspark.sql import functions as F

from ledgerloom.models import evaluation, glm, newton, passes, penalized, scoring
from ledgerloom.models.design import assemble, design
from ledgerloom.models.group_lasso import group_lasso_cv, selected_groups
from ledgerloom.models.penalized import (
    coef_path,
    lambda_grid,
    nonzero,
    penalized_cv,
    penalized_cvs,
    penalty_grid,
    split_by_size,
)
from ledgerloom.models.split import fold_of, train_test
from ledgerloom.models.stepwise import stepwise
from ledgerloom.models.tree import tree_cv

TERMS = ["age", "country", "remote_hours", "job_satisfaction", "tech_tools", "company_size"]
NUMBERS = ["age", "remote_hours", "job_satisfaction", "tech_tools"]


@pytest.fixture(scope="module")
def people(spark):
    """600 rows with two true signals, a factor and noise."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        sat, hours = int(rng.integers(1, 11)), int(rng.integers(0, 40))
        p = 1 / (1 + math.exp(-(-6 + 0.6 * sat + 0.1 * hours)))
        rows.append(
            (
                i, int(rng.integers(18, 66)), str(rng.choice(["x", "y", "z"])), hours, sat,
                int(rng.integers(0, 7)), str(rng.choice(["small", "large"])), int(rng.random() < p),
            )
        )
    return spark.createDataFrame(
        rows,
        "row_id long, age int, country string, remote_hours int, job_satisfaction int,"
        " tech_tools int, company_size string, preference int",
    ).repartition(3).cache()


def arrays(d):
    rows = d.matrix().collect()
    return np.array([r.x for r in rows]), np.array([r.y for r in rows])


# --- splits -----------------------------------------------------------------


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 1.0])
def test_exact_split(people, share):
    train, test = train_test(people, "row_id", share)
    ids = {r.row_id for r in test.select("row_id").collect()}
    assert len(ids) == int(share * 600)
    assert not ids & {r.row_id for r in train.select("row_id").collect()}
    assert train.count() + len(ids) == 600
    again = {r.row_id for r in train_test(people.repartition(5), "row_id", share)[1].collect()}
    assert again == ids


def test_exact_split_takes_the_smallest_hashes(people):
    _, test = train_test(people, "row_id", 0.3, seed=4)
    ranked = people.orderBy(F.xxhash64("row_id", F.lit(4))).limit(180)
    assert {r.row_id for r in test.collect()} == {r.row_id for r in ranked.collect()}


def test_expected_split_and_folds(people):
    train, test = train_test(people, "row_id", 0.25, exact=False)
    assert train.count() + test.count() == 600 and 100 < test.count() < 200
    sizes = people.groupBy(fold_of("row_id", 5).alias("f")).count().collect()
    assert {r.f for r in sizes} == set(range(5)) and min(r["count"] for r in sizes) > 60


# --- designs ----------------------------------------------------------------


@pytest.mark.parametrize("intercept", [True, False])
def test_design_codes_as_a_formula_does(people, intercept):
    d = design(people, "preference", TERMS, intercept)
    formula = "preference ~ " + " + ".join(TERMS) + ("" if intercept else " - 1")
    coded = RFormula(formula=formula, stringIndexerOrderType="alphabetDesc").fit(people)
    expected = [tuple(r.features) for r in coded.transform(people).orderBy("row_id").collect()]
    ours = [tuple(r.features) for r in d.frame.orderBy("row_id").collect()]
    assert ours == expected
    kept = 3 if not intercept else 2
    assert [n for n in d.names if n.startswith("country_")] == ["country_z", "country_y", "country_x"][:kept]
    assert d.terms["company_size"] == [len(d.names) - 1] and d.names[-1] == "company_size_small"


def test_design_leaves_out_incomplete_rows_and_unknown_levels(people, spark):
    holes = people.withColumn("age", F.when(F.col("row_id") > 9, F.col("age")))
    d = design(holes, "preference", TERMS)
    assert d.frame.count() == 590
    other = people.limit(3).withColumn("country", F.lit("unseen"))
    assert d.matrix(other).count() == 0


# --- maximum likelihood -----------------------------------------------------


def test_score_equations(people, spark):
    d = design(people, "preference", TERMS)
    fit = glm.fit_logistic(d)
    x, y = arrays(d)
    table = {r.term: r for r in fit.coefficients(spark).collect()}
    b = np.array([table[n].estimate for n in d.names])
    p = 1 / (1 + np.exp(-(x @ b + table["(Intercept)"].estimate)))
    assert np.abs(x.T @ (y - p)).max() < 1e-5 and abs((y - p).sum()) < 1e-6
    small = {r.term for r in glm.significant(fit.coefficients(spark), 1e-4).collect()}
    assert small == {"(Intercept)", "job_satisfaction", "remote_hours"}
    assert fit.aic == pytest.approx(fit.deviance + 2 * fit.rank)
    rate = y.mean()
    null = -2 * (y * math.log(rate) + (1 - y) * math.log(1 - rate)).sum()
    assert fit.null_deviance == pytest.approx(null)
    lines = {r.model: (r.deviance, r.df) for r in glm.deviance_table(spark, fit).collect()}
    assert lines["null"][1] == 599 and lines["residual"][1] == 600 - fit.rank
    odds = {r.term: r.odds_ratio for r in glm.odds_ratios(fit.coefficients(spark)).collect()}
    assert odds["remote_hours"] == pytest.approx(math.exp(table["remote_hours"].estimate))


def test_newton_agrees_with_the_stock_fit(people, spark):
    d = design(people, "preference", TERMS)
    stock = {r.term: r for r in glm.fit_logistic(d).coefficients(spark).collect()}
    ours = {r.term: r for r in newton.fit_matrix(d).coefficients(spark, d.names).collect()}
    assert stock.keys() == ours.keys()
    for term, r in stock.items():
        assert ours[term].estimate == pytest.approx(r.estimate, abs=1e-6)
        assert ours[term].std_error == pytest.approx(r.std_error, rel=1e-4)
        assert ours[term].p_value == pytest.approx(r.p_value, abs=1e-5)


def test_matrix_with_its_own_constant(people):
    by_formula = newton.fit_matrix(design(people, "preference", NUMBERS))
    plain = assemble(people.withColumn("one", F.lit(1.0)), "preference", ["one", *NUMBERS], False)
    by_matrix = newton.fit_matrix(plain)
    assert by_matrix.estimates == pytest.approx(by_formula.estimates)
    assert by_matrix.std_errors == pytest.approx(by_formula.std_errors)


def test_redundant_column_lowers_the_rank(people):
    twice = people.withColumn("again", F.col("age") * 2.0)
    fit = newton.fit_matrix(assemble(twice, "preference", ["age", "again", "remote_hours"]))
    once = newton.fit_matrix(assemble(people, "preference", ["age", "remote_hours"]))
    assert fit.rank == once.rank == 3
    assert fit.deviance == pytest.approx(once.deviance)


@pytest.mark.parametrize(
    "x, df, p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05)]
)
def test_chi_square_tail(x, df, p):
    assert glm.chi_square_tail(x, df) == pytest.approx(p, abs=1e-6)
    assert glm.chi_square_tail(0.0, df) == pytest.approx(1.0)


def test_published_criteria_pair_belongs_to_800_rows():
    assert (493.4636 - 441.9328) / 11 + 2 == pytest.approx(math.log(800), abs=1e-4)


# --- selection --------------------------------------------------------------


@pytest.mark.parametrize("direction", ["forward", "backward", "both"])
def test_stepwise(people, spark, direction):
    d = design(people, "preference", TERMS)
    chosen = stepwise(d, direction=direction)
    aics = [f.aic for _, _, f in chosen.path]
    assert aics == sorted(aics, reverse=True)
    assert {"remote_hours", "job_satisfaction"} <= set(chosen.fit.terms)
    steps = chosen.steps(spark).collect()
    assert [r.step for r in steps] == list(range(len(steps)))
    # no single move improves the final model
    one_by_one = glm.fit_logistic(design(people, "preference", list(chosen.fit.terms)))
    assert chosen.fit.aic == pytest.approx(one_by_one.aic, abs=1e-5)
    for term in chosen.fit.terms if direction != "forward" else []:
        fewer = [t for t in chosen.fit.terms if t != term]
        assert glm.fit_logistic(design(people, "preference", fewer)).aic >= chosen.fit.aic - 1e-6


def test_likelihood_ratio(people, spark):
    d = design(people, "preference", TERMS)
    chosen = stepwise(d, direction="both")
    full = chosen.path[0][2]
    line = glm.likelihood_ratio(
        spark, (chosen.fit.deviance, chosen.fit.rank), (full.deviance, full.rank)
    ).first()
    assert 0 <= line.p_value <= 1 and line.df == full.rank - chosen.fit.rank
    assert line.p_value > 0.05


# --- penalties --------------------------------------------------------------


def standardized(x):
    return (x - x.mean(0)) / x.std(0), x.std(0)


def kkt_gap(x, y, b0, b, lam, alpha):
    """Largest violation of the optimality conditions, standardized columns."""
    z, s = standardized(x)
    beta = b * s
    p = 1 / (1 + np.exp(-(x @ b + b0)))
    g = z.T @ (p - y) / len(y) + lam * (1 - alpha) * beta
    gap = np.where(
        beta != 0, np.abs(g + lam * alpha * np.sign(beta)), np.maximum(np.abs(g) - lam * alpha, 0)
    )
    return max(gap.max(), abs((p - y).mean()))


@pytest.mark.parametrize("alpha", [0.0, 0.5, 1.0])
def test_path_is_optimal(people, alpha):
    d = design(people, "preference", TERMS, intercept=False)
    path = coef_path(d, "row_id", alpha, n_lambda=8)
    x, y = arrays(d)
    for lam, row in zip(path.lambdas, path.coefs):
        assert kkt_gap(x, y, row[0], row[1:], lam, alpha) < 1e-6
    if alpha:
        assert np.abs(path.coefs[0][1:]).max() == 0
        assert path.coefs[0][0] == pytest.approx(math.log(y.mean() / (1 - y.mean())), abs=1e-5)


@pytest.mark.parametrize("alpha", [0.0, 0.5, 1.0])
def test_path_agrees_with_the_stock_fit(people, spark, alpha):
    lam = 0.03
    x, _ = arrays(d := assemble(people, "preference", NUMBERS))
    _, s = standardized(x)
    scaled = people.withColumns({c: F.col(c) / float(v) for c, v in zip(NUMBERS, s)})
    stock = LogisticRegression(
        regParam=lam, elasticNetParam=alpha, standardization=False, tol=1e-12, maxIter=500
    ).fit(assemble(scaled, "preference", NUMBERS).frame.select("features", "label"))
    path = coef_path(d, "row_id", alpha, [lam])
    assert path.coefs[0][1:] * s == pytest.approx(np.array(stock.coefficients), abs=1e-4)
    assert path.coefs[0][0] == pytest.approx(stock.intercept, abs=1e-3)


def test_cross_validation_leaves_each_fold_out(people, spark):
    d = assemble(people, "preference", NUMBERS)
    lambdas = [0.1, 0.01]
    path = penalized_cv(d, "row_id", 1.0, folds=3, lambdas=lambdas)
    rows = d.matrix(None, "row_id").withColumn("fold", fold_of("row_id", 3)).collect()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    fold = np.array([r.fold for r in rows])
    loss = np.zeros(2)
    for f in range(3):
        inside = people.where(fold_of("row_id", 3) != f)
        own = coef_path(assemble(inside, "preference", NUMBERS), "row_id", 1.0, lambdas)
        held = fold == f
        for i, row in enumerate(own.coefs):
            eta = x[held] @ row[1:] + row[0]
            loss[i] += 2 * (np.logaddexp(0, eta) - y[held] * eta).sum()
    assert [c[0] for c in path.cv] == pytest.approx(loss / len(y), rel=1e-5)
    table = path.cv_table(spark).collect()
    assert [r.is_best for r in table].count(True) == 1
    assert path.best_lambda == min(table, key=lambda r: r.deviance)["lambda"]


def test_paths_that_share_passes_equal_single_ones(people):
    d = assemble(people, "preference", NUMBERS)
    shared = penalized_cvs(d, "row_id", [0.0, 1.0], folds=2, n_lambda=5)
    for alpha, path in shared.items():
        alone = penalized_cv(d, "row_id", alpha, folds=2, n_lambda=5)
        assert path.lambdas == pytest.approx(alone.lambdas)
        assert path.coefs == pytest.approx(alone.coefs, abs=1e-6)
        assert path.best == alone.best


def test_grid_and_tables(people, spark):
    d = assemble(people, "preference", NUMBERS)
    grid = penalty_grid(d, "row_id", 1.0, n_lambda=4, ratio=1e-3)
    assert grid == pytest.approx(lambda_grid(grid[0], 4, 1e-3)) and grid[-1] / grid[0] == pytest.approx(1e-3)
    path = penalized_cv(d, "row_id", 1.0, folds=3, lambdas=grid)
    assert path.path(spark).count() == 4 * 5
    best = path.at_best(spark)
    assert {"remote_hours", "job_satisfaction"} <= {r.term for r in nonzero(best).collect()}
    sizes = split_by_size(best, 0.1).collect()
    values = [abs(r.coefficient) for r in sizes]
    assert values == sorted(values, reverse=True)
    assert all((r.size == "large") == (abs(r.coefficient) > 0.1) for r in sizes)


def test_constant_column_gets_no_coefficient(people):
    d = assemble(people.withColumn("c", F.lit(3.0)), "preference", [*NUMBERS, "c"])
    path = coef_path(d, "row_id", 0.5, [0.01])
    assert path.coefs[0][-1] == 0
    without = coef_path(assemble(people, "preference", NUMBERS), "row_id", 0.5, [0.01])
    assert path.coefs[0][1:-1] == pytest.approx(without.coefs[0][1:], abs=1e-6)


GROUPS = {"a": ["age"], "b": ["remote_hours", "tech_tools"], "c": ["job_satisfaction"]}


def test_group_lasso_is_optimal(people, spark):
    d = assemble(people, "preference", ["age", "remote_hours", "tech_tools", "job_satisfaction"])
    path = group_lasso_cv(d, "row_id", GROUPS, folds=3, n_lambda=10)
    x, y = arrays(d)
    assert np.abs(path.coefs[0][1:]).max() == 0
    for lam, row in zip(path.lambdas, path.coefs):
        p = 1 / (1 + np.exp(-(x @ row[1:] + row[0])))
        g = x.T @ (p - y) / len(y)
        assert abs((p - y).mean()) < 1e-6
        for cols in GROUPS.values():
            slots = [d.names.index(c) for c in cols]
            b, w = row[1:][slots], lam * math.sqrt(len(slots))
            norm = np.linalg.norm(b)
            if norm > 0:
                assert np.abs(g[slots] + w * b / norm).max() < 1e-5
            else:
                assert np.linalg.norm(g[slots]) <= w + 1e-5
    chosen = {r.group_label: r.selected for r in selected_groups(spark, path, GROUPS, path.best).collect()}
    assert chosen["b"] and chosen["c"]
    with pytest.raises(ValueError):
        group_lasso_cv(d, "row_id", {"a": ["age"]})


def test_groups_of_one_column_are_the_lasso(people):
    x, _ = arrays(assemble(people, "preference", NUMBERS))
    _, s = standardized(x)
    scaled = people.withColumns({c: F.col(c) / float(v) for c, v in zip(NUMBERS, s)})
    d = assemble(scaled, "preference", NUMBERS)
    lambdas = [0.05, 0.01]
    grouped = group_lasso_cv(d, "row_id", {c: [c] for c in NUMBERS}, folds=0, lambdas=lambdas)
    lasso = coef_path(d, "row_id", 1.0, lambdas)
    assert grouped.coefs == pytest.approx(lasso.coefs, abs=1e-6)


def test_large_values_that_differ_little(people):
    """Columns far from zero: same slopes, rank and penalized fit as near zero."""
    far = people.withColumn("age", F.col("age") * 10.0 + 1.6e9)
    near = people.withColumn("age", F.col("age") * 10.0)
    a = newton.fit_matrix(assemble(far, "preference", NUMBERS))
    b = newton.fit_matrix(assemble(near, "preference", NUMBERS))
    assert a.rank == b.rank == 5
    assert a.estimates[1:] == pytest.approx(b.estimates[1:], rel=1e-4, abs=1e-7)
    assert a.std_errors[1:] == pytest.approx(b.std_errors[1:], rel=1e-4)
    p = coef_path(assemble(far, "preference", NUMBERS), "row_id", 0.5, [0.01])
    q = coef_path(assemble(near, "preference", NUMBERS), "row_id", 0.5, [0.01])
    assert p.coefs[0][1:] == pytest.approx(q.coefs[0][1:], rel=1e-3, abs=1e-6)


def test_sums_over_many_partitions_take_more_rounds(people, monkeypatch):
    d = assemble(people, "preference", NUMBERS)
    rows = d.matrix().withColumn("fold", F.lit(0)).repartition(9)

    def total():
        def block(x, y, fold):
            import numpy as np

            return np.append(x.sum(axis=0), len(y))

        return passes.RowBlocks(rows).sum(block, 5)

    direct = total()
    monkeypatch.setattr(passes, "FAN", 2)
    assert total() == pytest.approx(direct) and direct[-1] == 600


# --- trees, scores, metrics -------------------------------------------------


def test_tree(people, spark):
    d = design(people, "preference", TERMS)
    fit = tree_cv(d, "row_id", depths=(1, 3), gains=(0.0, 0.05))
    table = fit.results(spark).collect()
    assert len(table) == 4 and [r.is_best for r in table].count(True) == 1
    assert fit.best_accuracy == max(r.accuracy for r in table) > 0.6


def test_scores_of_fitted_models_and_of_coefficients_agree(people, spark):
    d = design(people, "preference", TERMS)
    fit = glm.fit_logistic(d)
    coefs = {r.term: r.estimate for r in fit.coefficients(spark).collect()}
    tree = tree_cv(d, "row_id", depths=(2,), gains=(0.0,)).model.bestModel
    fitted = scoring.score_fitted(people, d, {"glm": fit.model, "tree": tree}, "row_id")
    named = scoring.score_coefficients(people, d, {"same": coefs}, "row_id").drop("y")
    rows = fitted.join(named, "row_id").collect()
    assert len(rows) == 600
    for r in rows:
        assert r.glm == pytest.approx(r.same, abs=1e-9) and 0 <= r.tree <= 1
    means = {r.model: r.avg_probability for r in evaluation.mean_probability(fitted, ["glm", "tree"]).collect()}
    assert means["glm"] == pytest.approx(np.mean([r.y for r in rows]), abs=1e-6)
    last = scoring.last_classes(fitted, ["glm", "tree"], ["row_id"]).collect()
    assert [r.row_id for r in last] == list(range(590, 600))
    assert scoring.long_scores(fitted, ["glm", "tree"], ["row_id"]).count() == 1200


def test_metrics(spark):
    pairs = [(1, 1)] * 3 + [(1, 0)] + [(0, 1)] * 2 + [(0, 0)] * 4
    classes = spark.createDataFrame([(c, 0, y) for c, y in pairs], "m int, never int, y int")
    table = evaluation.metrics(evaluation.confusion(classes, ["m", "never"], "y"))
    by_model = {r.model: r for r in table.collect()}
    m, never = by_model["m"], by_model["never"]
    assert (m.tp, m.fp, m.fn, m.tn) == (3, 1, 2, 4)
    assert (m.accuracy, m.precision, m.recall) == pytest.approx((0.7, 0.75, 0.6))
    assert m.f1 == pytest.approx(2 / 3)
    assert (never.tp, never.fp, never.recall) == (0, 0, 0.0)
    assert never.precision is None and never.f1 is None
    assert evaluation.best_recall(table).first().model == "m"


@pytest.mark.parametrize("alpha", [0.0, 0.5, 1.0])
def test_newton_starts_change_the_passes_alone(people, monkeypatch, alpha):
    """Few passes over the rows, and the minima that the descent finds by itself."""
    d = design(people, "preference", TERMS, intercept=False)
    found = penalized_cv(d, "row_id", alpha, folds=4, n_lambda=30)
    assert found.passes <= 14
    monkeypatch.setattr(penalized, "NEWTON_SLOTS", 0)
    alone = penalized_cv(d, "row_id", alpha, folds=4, n_lambda=30)
    assert found.lambdas == alone.lambdas
    assert np.allclose(found.coefs, alone.coefs, atol=1e-5)
    assert ((found.coefs == 0) == (alone.coefs == 0)).all()
    assert np.allclose(found.cv, alone.cv, atol=1e-6)
    assert found.passes < alone.passes or alpha == 0.0


def test_newton_starts_of_groups_and_rare_outcomes(people, monkeypatch):
    """Groups of raw columns of unlike sizes, and an outcome that few rows have."""
    rare = people.withColumn("preference", F.when(F.col("row_id") % 7 == 0, F.col("preference")).otherwise(0))
    d = assemble(rare.withColumn("age", F.col("age") * 1000), "preference", NUMBERS)
    groups = {"a": NUMBERS[:2], "b": NUMBERS[2:]}
    found = group_lasso_cv(d, "row_id", groups, folds=3, n_lambda=20, ratio=1e-2)
    monkeypatch.setattr(penalized, "NEWTON_SLOTS", 0)
    alone = group_lasso_cv(d, "row_id", groups, folds=3, n_lambda=20, ratio=1e-2)
    assert np.allclose(found.coefs, alone.coefs, rtol=1e-4, atol=1e-4)
    assert found.passes < alone.passes


def test_training_sets_start_from_the_path_of_all_rows(people, monkeypatch):
    """Newton passes over all rows come first, for their problems alone; the training
    sets of the folds take part in few of them."""
    seen, summed = [], penalized._curvatures

    def counted(blocks, heads, head, *rest):
        seen.append(len(head))
        return summed(blocks, heads, head, *rest)

    monkeypatch.setattr(penalized, "_curvatures", counted)
    d = design(people, "preference", TERMS, intercept=False)
    penalized_cv(d, "row_id", 1.0, folds=10, n_lambda=20)
    assert seen[0] <= 20
    assert sum(seen) < 3 * 11 * 20
