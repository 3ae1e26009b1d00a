from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fixtures import fixture
from ledgerloom.plans import contributions as contrib

ROWS = [
    ("A1", "IND", "Ann", "Lee", "Elmton", 100), ("A1", "IND", "Bob", "Red", "elmton", 50),
    ("A2", "OTH", None, "Red Plate Co", "Oro", 700), ("A2", "OTH", "", "Red Plate Co", None, None),
    ("A2", None, "", "Lee", "Oro", 10), ("B1", "IND", "Cy", "Day", "ORO", 30),
    ("C", "IND", "No", "Body", "Oro", 1), ("A1", "OTH", "", None, "Oro", 5),
    ("A1", "COM", None, "Void Co", "Far", None),
]


@pytest.fixture
def gifts(spark):
    return spark.createDataFrame(
        ROWS,
        "filer string, contributor_code string, contributor_first string, contributor_last string,"
        " contributor_city string, amount int",
    ).withColumn("amount", F.col("amount").cast("decimal(18,2)"))


def totals(df, key, value="total_amount"):
    return {r[key]: float(r[value]) for r in df.collect()}


def test_by_code(gifts):
    lines = {r.contributor_code: (r.n_rows, float(r.total_amount)) for r in contrib.by_code(gifts).collect()}
    assert lines[""] == (1, 10.0) and lines["COM"] == (1, 0.0)


def test_org_totals_are_zero_for_only_nulls_and_drop_null_names(gifts):
    assert totals(contrib.org_totals(gifts), "contributor_last") == {
        "Red Plate Co": 700.0, "Lee": 10.0, "Void Co": 0.0,
    }


def test_individuals_agree_with_the_anti_join(gifts):
    anti = contrib.individuals(contrib.contributor_totals(gifts), contrib.org_totals(gifts))
    one_pass = contrib.donors(gifts).where("not is_org")
    expected = {"Red": 50.0, "Day": 30.0, "Body": 1.0}  # Lee is lost with the organization Lee
    assert totals(anti, "contributor_last") == totals(one_pass, "contributor_last") == expected


def test_combined_adds_up(spark, sf):
    rows = fixture(spark, sf, "contributions")
    cuts, rules = [(3_000_000, "Large")], [("Plates", ["plate"])]
    combined = contrib.combined(rows, rules, cuts, "Small")
    orgs = contrib.org_totals(rows)
    people = contrib.donors(rows).where("not is_org")
    stacked = contrib.stacked(
        contrib.industry_totals(orgs, rules), contrib.size_bins(people, cuts, "Small")
    )
    assert sorted(map(tuple, combined.collect())) == sorted(map(tuple, stacked.collect()))
    assert abs(sum(r.pct for r in combined.collect()) - 100) < 0.5


def test_cities(gifts):
    assert totals(contrib.city_totals(gifts, normalize=True), "contributor_city") == {
        "elmton": 150.0, "oro": 746.0, "far": 0.0,
    }
    labels = ("home", "near", "other")
    plain = totals(contrib.city_classes(gifts, "Elmton", ["Oro"], labels), "category")
    assert plain == {"home": 100.0, "near": 716.0, "other": 80.0}
    folded = totals(contrib.city_classes(gifts, "Elmton", ["Oro"], labels, normalize=True), "category")
    assert folded == {"home": 150.0, "near": 746.0, "other": 0.0}


def test_cohorts_with_titles_and_an_empty_one(gifts):
    found = contrib.cohort_totals(
        gifts, {"A": ["A1", "A2"], "B": ["B1"], "none": ["Z"]}, {"A": "Received by A"}
    )
    assert totals(found, "cohort") == {"Received by A": 865.0, "B": 30.0, "none": 0.0}


def test_cohorts_and_the_rest_make_the_total(spark, sf):
    rows = fixture(spark, sf, "contributions")
    sums = defaultdict(float)
    for r in rows.groupBy("filer").agg({"amount": "sum"}).collect():
        sums[r.filer] = float(r[1])
    cohorts = {"A": ["BUILDING", "MACHINERY"], "B": ["AUTOMOBILE", "FURNITURE"]}
    found = totals(contrib.cohort_totals(rows, cohorts), "cohort")
    assert found["A"] == pytest.approx(sums["BUILDING"] + sums["MACHINERY"])
    assert found["A"] + found["B"] + sums["HOUSEHOLD"] == pytest.approx(sum(sums.values()))
