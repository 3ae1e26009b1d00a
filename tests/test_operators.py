import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import aggregates, columns, filters, joins, ordering, sets, windows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_column_sets(spark):
    df = spark.createDataFrame(
        [("a", None, None), ("b", None, 2)], "name string, memo string, x_id int"
    )
    assert columns.drop_matching(df, "_").columns == ["name", "memo"]
    assert columns.drop_all_null(df).columns == ["name", "x_id"]
    assert rows(columns.column_fill(df)) == [("memo", 0), ("name", 2), ("x_id", 1)]
    assert rows(columns.fill(df, "")) == [("a", "", None), ("b", "", 2)]
    assert columns.complete_cases(df, ["x_id"]).count() == 1
    assert dict(columns.as_factor(df, ["x_id"]).dtypes)["x_id"] == "string"
    assert rows(columns.as_levels(df.select("name"), "name", ["a"])) == [("a",), (None,)]


def test_with_period(spark):
    df = spark.createDataFrame([("2020-05-06",)], "ts string")
    assert columns.with_period(df, "ts", "month").first().period == "2020-05"


def test_where_in_short_and_long(spark):
    df = spark.createDataFrame([(i,) for i in range(5)] + [(None,)], "k int")
    assert rows(filters.where_in(df, "k", [1, 3, 9])) == [(1,), (3,)]
    assert rows(filters.where_in(df, "k", list(range(3, 3 + filters.MAX_LITERALS + 1)))) == [
        (3,), (4,),
    ]


def test_tag_cohort(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "k string, n int")
    tagged = filters.tag_cohort(df, {"one": ["a", "b"], "two": ["b"]}, "k")
    assert rows(tagged.select("n", "cohort")) == [(1, "one"), (2, "one"), (2, "two")]


@pytest.mark.parametrize("kind", ["string", "timestamp", "timestamp_ntz", "date"])
def test_in_years(spark, kind):
    days = ["2018-12-31", "2019-01-01", "2020-06-01", "2021-12-31", "2023-02-02", None]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast(kind))
    kept = df.where(filters.in_years(df, "d", [2019, "2020", 2023]))
    found = sorted(r[0] for r in kept.select(F.left(F.col("d").cast("string"), F.lit(10))).collect())
    assert found == ["2019-01-01", "2020-06-01", "2023-02-02"]
    assert df.where(filters.in_years(df, "d", [])).count() == 0


def test_year_filter_reaches_the_scan(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    plan = orders.where(filters.in_years(orders, "o_orderdate", [1996, 1997])).select("o_orderkey")
    text = plan._jdf.queryExecution().executedPlan().toString()
    pushed = text[text.index("PushedFilters") :]
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in pushed
    assert "LessThan(o_orderdate" in pushed


def test_joins(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, n int")
    right = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert rows(joins.exclude_keys(left, right, "k")) == [("b", 2), (None, 3)]
    assert rows(joins.flag_exists(left, right, "k", "seen").select("n", "seen")) == [
        (1, True), (2, False), (3, False),
    ]
    assert joins.distinct_keys(right, "k").count() == 2


def test_two_part_keys_do_not_collide(spark):
    left = spark.createDataFrame([("a_b", "c"), ("a", "b_c")], "p string, t string")
    right = spark.createDataFrame([("a", "b_c")], "p string, t string")
    assert rows(joins.exclude_keys(left, right, ["p", "t"])) == [("a_b", "c")]


def test_totals(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", None), ("b", None), (None, 5.0)], "k string, v double"
    )
    assert rows(aggregates.total_by(df, "k", "v")) == [("a", 1.0), ("b", 0.0)]
    assert rows(aggregates.count_and_sum(df, "k", "v")) == [
        ("", 1, 5.0), ("a", 2, 1.0), ("b", 1, 0.0),
    ]
    assert rows(aggregates.count_by(df, "k", "v")) == [("a", 1), ("b", 0), (None, 1)]
    assert rows(aggregates.size_by(df, "k")) == [("a", 2), ("b", 1), (None, 1)]


def test_flags_per_table(spark):
    tagged = spark.createDataFrame(
        [("s", "t", None), ("s", "t", "A"), ("s", "u", "NaN")],
        "schema_name string, table_name string, id string",
    )
    assert rows(aggregates.any_populated(tagged, "id")) == [("s", "t", True), ("s", "u", False)]
    schemas = spark.createDataFrame([("s",), ("empty",)], "schema_name string")
    assert rows(aggregates.has_tables(schemas, tagged)) == [("empty", False), ("s", True)]


def test_subset_statistics(spark):
    df = spark.createDataFrame([("x", 1, 2.0), ("x", 0, 4.0), ("y", 1, 9.0)], "g string, y int, v double")
    x = F.col("g") == "x"
    assert aggregates.percent_where(df, x, F.col("y") == 1).first().percent == 50.0
    assert aggregates.percent_where(df, F.lit(False), x).first().percent is None
    stats = aggregates.mean_sd(df, x, "v").first()
    assert stats.mean == 3.0 and abs(stats.sd - 2**0.5) < 1e-12


def test_shares(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 0), ("b", 0)], "g string, y int")
    overall = {(r.g, r.y): r.share for r in windows.share_overall(df, "g", "y").collect()}
    assert overall == {("a", 1): 0.5, ("a", 0): 0.25, ("b", 0): 0.25}
    within = {(r.g, r.y): r.share for r in windows.share_within(df, "g", "y").collect()}
    assert abs(within["a", 1] - 2 / 3) < 1e-12 and within["b", 0] == 1.0
    totals = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "label string, total_amount double")
    assert rows(windows.percent_of_total(totals)) == [("a", 1.0, 33.3), ("b", 2.0, 66.7)]
    nothing = windows.percent_of_total(totals.withColumn("total_amount", F.lit(0.0)))
    assert {r.pct for r in nothing.collect()} == {None}


@pytest.mark.parametrize("small", [False, True])
def test_keep_false_or_first(spark, small):
    df = spark.createDataFrame(
        [
            ("g", "True", "a", 1), ("g", "False", "b", 2), ("g", "False", "c", 3),
            ("h", "True", "b", 4), ("h", "True", None, 5), (None, "True", "z", 6),
        ],
        "k string, flag string, o string, n int",
    )
    kept = windows.keep_false_or_first(df, ["k"], "flag", ["o", "n"], small_groups=small)
    assert kept.columns == df.columns
    assert sorted(r.n for r in kept.collect()) == [2, 3, 5, 6]
    other = windows.keep_false_or_first(df, ["k"], "flag", ["o", "n"], "True", small)
    assert sorted(r.n for r in other.collect()) == [1, 4, 5, 6]


def test_row_id_is_a_total_order(spark):
    values = [random.Random(7).randrange(50) for _ in range(3_000)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v int").repartition(7)
    numbered = windows.row_id(df, ["v", "id"]).collect()
    expected = sorted((v, i) for i, v in enumerate(values))
    assert [(r.v, r.id) for r in sorted(numbered, key=lambda r: r.row_number)] == expected
    assert sorted(r.row_number for r in numbered) == list(range(1, 3_001))


def test_ordering(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", -3.0), ("c", None), ("d", 1.0)], "k string, v double")
    names = lambda d: [r.k for r in d.collect()]
    assert names(ordering.top_totals(df, "v", "k")) == ["a", "d", "b", "c"]
    assert names(ordering.first_rows(df, 2, ["k"])) == ["a", "b"]
    assert names(ordering.last_rows(df, 2, ["k"])) == ["c", "d"]
    assert names(ordering.by_magnitude(df, "v", "k"))[:3] == ["b", "a", "d"]
    assert names(ordering.best_by(df, "v", ["k"])) == ["a"]
    assert rows(filters.where_abs_over(df, "v", 1.0)) == [("b", -3.0)]


def test_stacking(spark):
    a = spark.createDataFrame([("x", 1.0)], "category string, total double")
    b = spark.createDataFrame([(1.0, "x")], "total double, bin string")
    assert rows(sets.stack([(a, "category"), (b, "bin")], "label", ["total"])) == [("x", 1.0)] * 2
    assert sets.stack_results([a, a, a]).count() == 3


def test_row_numbers_of_one_value_spread_over_tasks(spark, request):
    """A column of a single value is dealt out evenly, its numbers are a permutation."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    same = spark.range(0, 4_000, 1, 8).select(F.lit(7).alias("v"), F.col("id"))
    numbered = windows.row_id(same, ["v"])
    sizes = [r["count"] for r in numbered.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 2 and max(sizes) < 2 * 4_000 / len(sizes)
    numbers = sorted(r.row_number for r in numbered.collect())
    assert numbers == list(range(1, 4_001))
    # rows that are equal in every column as well
    alone = windows.row_id(same.select("v"), ["v"])
    sizes = [r["count"] for r in alone.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and sorted(r.row_number for r in alone.collect()) == list(range(1, 4_001))
    ordered = windows.row_id(spark.range(100).select((F.col("id") % 7).alias("v"), "id"), ["v"])
    values = [r.v for r in ordered.orderBy("row_number").collect()]
    assert values == sorted(values)


def test_union_of_sources(spark):
    a, b = spark.range(2).withColumn("x", F.lit("p")), spark.range(3).withColumn("y", F.lit(1))
    both = sets.union_sources({"a": a, "b": b})
    assert sorted(map(tuple, both.where("source_table = 'b'").collect())) == [
        (i, None, "b", 1) for i in range(3)
    ]
    assert both.count() == 5
    assert sets.union_sources({"a": a}, "from").columns == ["id", "x", "from"]
