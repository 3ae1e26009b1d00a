import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoint-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return str(SF)


@pytest.fixture(scope="session")
def survey(spark, sf):
    from fixtures import fixture

    return fixture(spark, sf, "survey")


@pytest.fixture
def column(spark):
    """Values of an expression over one column ``v`` of given rows."""

    def evaluate(values, expression, kind="string"):
        df = spark.createDataFrame(
            [(i, v) for i, v in enumerate(values)], f"i int, v {kind}"
        )
        return [r[0] for r in df.orderBy("i").select(expression).collect()]

    return evaluate
