import pytest

from ledgerloom.sources import catalog, files
from ledgerloom.sources.frames import rows_to_df


def test_contributions_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(
        'Filer,ContributorNameLast,AmountReceivedThisPeriod,Tran_ID\n"A, B",,12.50,t1\nC,x,,t2\nD,"",bad,t3\n'
    )
    df = files.read_contributions(spark, str(path))
    assert dict(df.dtypes)["AmountReceivedThisPeriod"] == "decimal(18,2)"
    rows = {r.Filer: r for r in df.collect()}
    assert float(rows["A, B"].AmountReceivedThisPeriod) == 12.5
    assert rows["A, B"].ContributorNameLast is None
    assert rows["D"].ContributorNameLast is None
    assert rows["C"].AmountReceivedThisPeriod is None
    assert rows["D"].AmountReceivedThisPeriod is None


def test_survey_csv_trims_names_and_reads_empty_as_null(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("Age ,Gender,Salary  ,RemoteWorkPreference\n30,,100.5,yes\n,F,,no\n")
    df = files.read_survey(spark, str(path))
    assert df.columns == ["Age", "Gender", "Salary", "RemoteWorkPreference"]
    assert [tuple(r) for r in df.collect()] == [
        (30, None, 100.5, "yes"), (None, "F", None, "no"),
    ]


@pytest.fixture(scope="module")
def lake(spark):
    for schema in ("tp1__ingested", "tp1__claims__standardized", "tp1__claims__shared"):
        spark.sql(f"create database {schema}")
    spark.sql("create table tp1__ingested.`835__history` (meta_lineage_source_name string) using parquet")
    spark.sql("create table tp1__claims__standardized.`835__crosswalk` (account_number string) using parquet")
    spark.sql("create table tp1__claims__standardized.`837__crosswalk` (other string) using parquet")
    spark.sql("create table tp1__claims__standardized.`835__b_crosswalk` (account_number string) using parquet")
    spark.sql("insert into tp1__claims__standardized.`835__crosswalk` values (' '), (null), ('A1')")
    spark.sql("insert into tp1__claims__standardized.`835__b_crosswalk` values (' '), ('NaN')")
    spark.range(1).createOrReplaceTempView("session_view_835")
    yield "spark_catalog"
    for schema in ("tp1__ingested", "tp1__claims__standardized", "tp1__claims__shared"):
        spark.sql(f"drop database {schema} cascade")
    spark.catalog.dropTempView("session_view_835")


def test_inventory(spark, lake):
    found = catalog.inventory(spark, lake)
    assert {r.schema_name for r in found.schemas.collect()} >= {"tp1__claims__shared"}
    tables = {tuple(r) for r in found.tables.collect()}
    assert ("tp1__ingested", "835__history") in tables
    assert not any(name == "session_view_835" for _, name in tables)
    assert found.errors.count() == 0
    assert {tuple(r) for r in catalog.list_tables(spark, lake).collect()} == tables
    assert catalog.list_schemas(spark, lake).count() == found.schemas.count()


def test_inventory_skips_a_schema_that_fails(spark, lake, monkeypatch):
    monkeypatch.setattr(catalog, "_schema_names", lambda *_: ["tp1__ingested", "no_such_schema"])
    found = catalog.inventory(spark, lake)
    assert [r.schema_name for r in found.errors.collect()] == ["no_such_schema"]
    assert [tuple(r) for r in found.tables.collect()] == [("tp1__ingested", "835__history")]
    with pytest.raises(Exception):
        catalog.inventory(spark, lake, skip_errors=False)


def test_tables_by_name(spark, lake):
    assert catalog.table(spark, "spark_catalog.tp1__ingested.835__history").columns == [
        "meta_lineage_source_name"
    ]
    layer = catalog.layer_table(
        spark, lake, "{partner}__ingested", "{feed}__history", partner="tp1", feed="835"
    )
    assert catalog.has_column(layer, "meta_lineage_source_name")
    assert not catalog.has_column(layer, "FileName")
    with pytest.raises(ValueError):
        catalog.layer_table(spark, lake, "{p}__x", "t", p="tp1`; drop")


def test_probe_tables(spark, lake):
    from ledgerloom.plans.onboarding import probe_tables

    names = [
        ("tp1__claims__standardized", t)
        for t in ("835__crosswalk", "837__crosswalk", "835__b_crosswalk")
    ]
    found = probe_tables(spark, names, lake)
    assert {r.table_name: r.populated for r in found.collect()} == {
        "835__crosswalk": True, "837__crosswalk": False, "835__b_crosswalk": False,
    }
    assert probe_tables(spark, [], lake).count() == 0
    assert probe_tables(spark, names[1:2], lake).first().populated is False


def test_rows_to_df(spark):
    assert rows_to_df(spark, [], "a string, n bigint").dtypes == [("a", "string"), ("n", "bigint")]
    assert [tuple(r) for r in rows_to_df(spark, [("x", None)], "a string, n double").collect()] == [
        ("x", None)
    ]


def test_status_of_a_live_catalog(spark, lake):
    from ledgerloom.plans.onboarding import catalog_status

    found = [tuple(r) for r in catalog_status(spark, lake).collect()]
    # 835 is linked; the 837 crosswalk lacks the column, and that reaches all lines
    assert found == [("tp1", "835", "True", "False", "False")]
    per_type = [tuple(r) for r in catalog_status(spark, lake, per_type=True).collect()]
    assert per_type == [("tp1", "835", "True", "False", "False")]


def test_survey_from_csv_to_model_input(spark, tmp_path):
    from ledgerloom.models.design import design
    from ledgerloom.plans.survey import prepare

    path = tmp_path / "s.csv"
    lines = [f"{20 + i},{'FM'[i % 2]},{'yes' if i % 3 else 'no'}" for i in range(12)]
    path.write_text("Age ,Gender,Prefers \n" + "\n".join(lines) + "\n,F,yes\n30,F,\n")
    rows = prepare(files.read_survey(spark, str(path)), "Prefers", "yes", ["Gender"])
    assert {r.Prefers for r in rows.collect()} == {0, 1, None}
    d = design(rows, "Prefers", ["Age", "Gender"])
    assert d.names == ["Age", "Gender_M"] and d.frame.count() == 12
    assert rows.select("row_id").distinct().count() == 14


def test_rows_with_other_numbers_of_fields(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text('name,amount,note\na,1.50,x\nb,2.00\nc,3.00,y,extra,more\n"d, e",bad,\n,,\n')
    path, types = str(path), {"amount": "decimal(18,2)"}
    read = files.read_csv(spark, path, types).collect()
    assert [(r.name, r.note) for r in read] == [
        ("a", "x"), ("b", None), ("c", "y"), ("d, e", None), (None, None),
    ]
    odd = {(r.record, r.reason) for r in files.corrupt_rows(spark, path, types).collect()}
    assert {("b,2.00", "fields"), ("c,3.00,y,extra,more", "fields")} <= odd
    assert {reason for _, reason in odd} == {"fields", "amount"} and len(odd) == 3
    with pytest.raises(Exception, match="not as many fields"):
        files.read_csv(spark, path, {}, strict=True).collect()
    with pytest.raises(Exception, match="not as many fields"):
        files.read_csv(spark, path, {}, strict=True).select("name").collect()
    good = tmp_path / "good.csv"
    good.write_text("name ,amount\na,1\nb,\n")
    assert files.read_csv(spark, str(good), types, trim_names=True, strict=True).count() == 2
    assert files.corrupt_rows(spark, str(good), types, trim_names=True).count() == 0


def test_several_tables_of_a_layer(spark, lake):
    choices = [{"partner": "tp1", "feed": f} for f in ("835__b", "837_", "835_")]
    both = catalog.layer_tables(
        spark, lake, "{partner}__claims__standardized", "{feed}_crosswalk", choices
    )
    assert both.columns == ["account_number", "source_table", "other"]
    rows = {(r.source_table, r.account_number) for r in both.collect()}
    first = "tp1__claims__standardized.835__crosswalk"
    assert (first, "A1") in rows and len(rows) == 5
    # a filter on the source leaves the other tables unread
    plan = both.where(both.source_table == first)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
    with pytest.raises(ValueError):
        catalog.layer_tables(spark, lake, "{p}", "{t}", [])
    with pytest.raises(ValueError):
        catalog.layer_tables(
            spark, lake, "{partner}__claims__standardized", "{feed}_crosswalk", choices, "account_number"
        )


def test_probes_are_plans_of_one_table(spark, monkeypatch):
    """Two thousand names: no plan holds more than one of them, same rows."""
    from ledgerloom.plans import onboarding

    seen = []

    class Tables:
        def table(self, name):
            seen.append(name)
            return spark.createDataFrame([("A1" if name.endswith("7`") else " ",)], "account_number string")

        def __getattr__(self, name):
            return getattr(spark, name)

    names = [("s", f"t{i}") for i in range(60)] * 2
    found = onboarding.probe_tables(Tables(), names, "c").collect()
    assert len(seen) == 60 and len(found) == 60
    assert {r.table_name for r in found if r.populated} == {f"t{i}" for i in range(7, 60, 10)}
