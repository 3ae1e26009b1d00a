import re

import pytest

from fixtures import fixture
from ledgerloom.plans import reconciliation as recon

LEDGER = [
    ("TP_A", "835", "/in/f1.txt.bz2", "2022-03-01"),
    ("TP_A", "835", "/in/again/f1.txt", "2022-04-01"),
    ("TP_A", "837", "/in/f2.txt", "2022-03-09"),
    ("TP_B", "835", "/in/f3.bz2y.bz2", "2023-01-01"),
    ("TP_B", "835", None, "2023-01-02"),
    ("TP_B", "835", "/in/f4.txt", None),
    (None, "835", "/in/f5.txt", "2023-01-03"),
]
LAYER = [
    "s3://a/f1.txt", "s3://b/f1.txt.bz2", "s3://c/f1.txt", "s3://a/f2.txt", "s3://a/f3y", "s3://a/f3",
    "s3://a/f4.txt", "s3://a/other.txt", None,
]


@pytest.fixture
def ledger(spark):
    return spark.createDataFrame(
        LEDGER, "trading_partner string, data_feed string, file_path string, src_last_modified string"
    )


@pytest.fixture
def layer(spark):
    return spark.createDataFrame([(n,) for n in LAYER], "meta_lineage_source_name string")


def found(df):
    return {r.period: r.unique_file_paths for r in df.collect()}


def brute_layer_counts(length):
    """The join row by row, as the steps are written."""
    seen = {}
    for partner, _, path, stamp in LEDGER:
        if partner is None or path is None:
            continue
        base = path.rsplit("/", 1)[-1]
        key = base.split(".bz2")[0] if path.endswith(".bz2") else base
        for name in LAYER:
            if name is not None and name.rsplit("/", 1)[-1].replace(".bz2", "") == key:
                seen.setdefault(stamp and stamp[:length], set()).add(name.rsplit("/", 1)[-1])
    return {k: len(v) for k, v in seen.items()}


def test_acquired_files(ledger):
    assert found(recon.files_by_period(ledger, "month")) == {
        "2022-03": 2, "2022-04": 1, "2023-01": 1, None: 1,
    }
    assert found(recon.files_by_period(ledger, "year", [2022], feed="835")) == {"2022": 2}
    assert found(recon.files_by_period(ledger, "year", ["2023"], partner="B")) == {"2023": 1}


@pytest.mark.parametrize("grain, length", [("month", 7), ("year", 4)])
def test_layer_counts_match_brute_force(ledger, layer, grain, length):
    counts = found(recon.layer_files_by_period(ledger, layer, grain))
    assert counts == brute_layer_counts(length)
    assert counts[None] == 1


def test_names_with_and_without_suffix_count_twice(ledger, layer):
    assert found(recon.layer_files_by_period(ledger, layer, "year"))["2022"] == 3


def test_coverage_counts_canonical_keys(ledger, layer):
    lines = recon.coverage(
        ledger, {"raw": (layer, "meta_lineage_source_name")}, "year"
    ).collect()
    by_year = {r.period: (r.acquired_files, r.raw_files, r.raw_coverage) for r in lines}
    assert by_year == {"2022": (2, 2, 1.0), "2023": (1, 1, 1.0), None: (1, 1, 1.0)}


def test_coverage_stays_between_zero_and_one(spark, sf):
    layers = {
        "ingested": (fixture(spark, sf, "layer_ingested"), "meta_lineage_source_name"),
        "shared": (fixture(spark, sf, "layer_shared"), "FileName"),
    }
    lines = recon.coverage(fixture(spark, sf, "acquisition"), layers, "month").collect()
    assert lines
    for r in lines:
        assert 0 <= r.shared_coverage <= r.ingested_coverage <= 1


def test_hot_name_shuffles_as_few_rows(spark):
    """A base name shared by most records is one row per key after grouping."""
    rows = spark.range(50_000).selectExpr(
        "concat('s3://x/', id, '/', if(id % 3 = 0, concat('f', id), 'part-0')) as meta_lineage_source_name"
    )
    keys = recon.layer_keys(rows, "meta_lineage_source_name")
    assert keys.where("file_key = 'part-0'").first().n_names == 1


def test_records_are_reduced_before_the_join(spark, sf):
    df = recon.layer_files_by_period(
        fixture(spark, sf, "acquisition"), fixture(spark, sf, "layer_ingested"), "year"
    )
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join")
    assert len(re.findall("Aggregate", plan[join:])) >= 2  # both sides of the join
    assert "Generate" not in plan and "Cross" not in plan
