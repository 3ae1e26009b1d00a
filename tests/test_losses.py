"""Values and rows that must not be lost or counted twice."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.labels import size_bin
from ledgerloom.models import penalized
from ledgerloom.models.design import design
from ledgerloom.models.glm import fit_logistic
from ledgerloom.models.split import train_test
from ledgerloom.operators.aggregates import total
from ledgerloom.operators.filters import tag_cohort, where_in
from ledgerloom.plans.onboarding import mark_unknown
from ledgerloom.sources.files import read_csv, rejected_values


@pytest.mark.parametrize("expression", ["id % 2", "if(id % 2 = 0, null, id)", "null", "id"])
def test_split_is_exact_for_repeated_and_null_ids(spark, expression):
    df = spark.range(1000).select("id", F.expr(f"cast({expression} as long)").alias("few"))
    train, test = train_test(df, "few", 0.2)
    got = sorted(r.id for r in test.collect())
    assert len(got) == 200
    assert sorted([*got, *(r.id for r in train.collect())]) == list(range(1000))


def test_identical_rows_are_split_too(spark):
    df = spark.range(100).select(F.lit("same").alias("key"))
    train, test = train_test(df, "key", 0.25)
    assert (train.count(), test.count()) == (75, 25)


def test_a_member_listed_twice_counts_once(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "filer string, amount double")
    tagged = tag_cohort(df, {"A": ["x", "x"], "B": ["x"]}, "filer")
    assert sorted(r.cohort for r in tagged.collect()) == ["A", "B"]


def test_nan_is_no_amount(spark):
    df = spark.createDataFrame([(float("nan"),), (5.0,), (None,)], "v double")
    labels = df.select(size_bin(F.col("v"), [(1, "high")], "low")).collect()
    assert [r[0] for r in labels] == ["low", "high", "low"]
    assert df.select(total(F.col("v"))).first()[0] == 5.0


def test_long_and_short_lists_agree(spark):
    df = spark.createDataFrame([("1",), ("2",), ("900",), (None,)], "k string")
    for values in ([1, 2], [1, "2", None], list(range(1500))):
        found = {max_: sorted(r.k for r in where_in(df, "k", values, max_).collect())
                 for max_ in (0, 10_000)}
        assert found[0] == found[10_000]
    assert found[0] == ["1", "2", "900"]


def test_unfinished_fits_raise(spark):
    rows = [(i, float(i), int(i >= 20)) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, x double, y int")
    with pytest.raises(RuntimeError, match="did not settle"):
        fit_logistic(design(df, "y", ["x"]), max_iter=10)


def test_folds_can_be_given(spark):
    from ledgerloom.models.penalized import penalized_cv
    from ledgerloom.models.split import fold_of
    from ledgerloom.models.tree import tree_cv

    df = spark.range(200).select(
        F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("x"),
        ((F.col("id") % 7 > 3) != (F.col("id") % 11 == 0)).cast("int").alias("y"),
    ).withColumn("own", fold_of("row_id", 3, 100)).withColumn("odd", F.col("row_id") % 5)
    d = design(df, "y", ["x"], intercept=False)
    how = dict(folds=3, lambdas=[0.1, 0.01])
    hashed = penalized_cv(d, "row_id", 1.0, **how).cv_table(spark).collect()
    given = penalized_cv(d, "row_id", 1.0, **how, fold_col="own").cv_table(spark).collect()
    assert hashed == given
    one = dict(depths=(1,), gains=(0.0,))
    a = tree_cv(d, "row_id", **one).results(spark).collect()
    assert a == tree_cv(d, "row_id", **one, fold_col="own").results(spark).collect()
    with pytest.raises(Exception, match="no fold below 3"):
        penalized_cv(d, "row_id", 1.0, **how, fold_col="odd")


def test_wide_factors_are_refused(spark):
    df = spark.range(500).select(F.concat(F.lit("v"), "id").alias("f"), (F.col("id") % 2).alias("y"))
    with pytest.raises(ValueError, match="levels"):
        design(df, "y", ["f"], max_levels=100)


def test_an_unsolved_step_is_not_settled():
    import numpy as np

    def solved(bound, sweeps):
        heads = object.__new__(penalized._Heads)
        heads.bound, heads.n, heads.bases = np.array([bound]), np.array([2.0]), {}
        groups = [[0], [1]]
        top = penalized._largest_curvature(heads.bound, groups)
        l1 = np.array([1e-6])
        return penalized._proximal(
            heads, top, np.array([0]), np.array([[0.3, -0.2]]), np.zeros((1, 2)), groups,
            [1.0, 1.0], l1, np.array([0.0]), l1, 1e-14, sweeps=sweeps,
        )[1]

    assert not solved([[1.0, 1 - 1e-9], [1 - 1e-9, 1.0]], 5).any()
    assert solved([[1.0, 0.0], [0.0, 1.0]], 50).all()


def test_values_that_do_not_fit_are_counted(spark, tmp_path):
    (tmp_path / "a.csv").write_text('amount,n\n"1,200.00",1\n$50,x\n12.345,3\n7.50,\n')
    types = {"amount": "decimal(18,2)", "n": "int"}
    path = str(tmp_path / "a.csv")
    found = {tuple(r) for r in rejected_values(spark, path, types).collect()}
    assert found == {("amount", 2, 1), ("n", 1, 0)}
    assert read_csv(spark, path, types).where("amount is null").count() == 2
    with pytest.raises(Exception, match="not a decimal"):
        read_csv(spark, path, types, strict=True).collect()


def test_what_could_not_be_listed_is_unknown(spark):
    lines = spark.createDataFrame(
        [("tp1", "835", "True", "False"), ("tp2", "835", "True", "False")],
        "trading_partner_id string, table_type_ingested string, standardized_completed string, "
        "shared_completed string",
    )
    errors = spark.createDataFrame([("tp1__claims__shared", "denied")], "schema_name string, message string")
    got = {r.trading_partner_id: (r.standardized_completed, r.shared_completed)
           for r in mark_unknown(lines, errors).collect()}
    from ledgerloom.functions.text import base_schema
    base = errors.select(base_schema(F.col("schema_name"))).first()[0]
    renamed = mark_unknown(lines.withColumn("trading_partner_id", F.lit(base)), errors)
    assert got["tp2"] == ("True", "False")
    assert {(r[2], r[3]) for r in renamed.collect()} == {("True", "Unknown")}
