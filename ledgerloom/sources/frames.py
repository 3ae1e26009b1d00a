"""Small local rows as frames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def rows_to_df(
    spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType | str
) -> DataFrame:
    """Rows with a declared schema, so no rows is fine too.

    Handed over as Arrow, they become a local relation: Spark knows its size,
    can broadcast it by its own threshold, and starts no Python task for it.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) or [()] * len(arrow)
    table = pa.table(
        [pa.array(list(values), type=f.type) for values, f in zip(columns, arrow)], schema=arrow
    )
    return spark.createDataFrame(table, schema)
