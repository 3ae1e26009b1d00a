"""Catalog tables and listings.

Listings are metadata: one row per schema or table. They are the only rows the
driver ever holds here; table data is never collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.sets import union_sources
from ledgerloom.sources.frames import rows_to_df

SCHEMA_ROWS = T.StructType([T.StructField("schema_name", T.StringType())])
TABLE_ROWS = T.StructType(
    [T.StructField("schema_name", T.StringType()), T.StructField("table_name", T.StringType())]
)
ERROR_ROWS = T.StructType(
    [T.StructField("schema_name", T.StringType()), T.StructField("message", T.StringType())]
)


def quoted(*parts: str) -> str:
    """Back-ticked multi-part name; a part may hold any character but a back-tick."""
    for part in parts:
        if not part or "`" in part:
            raise ValueError(f"not a valid identifier part: {part!r}")
    return ".".join(f"`{p}`" for p in parts)


def table(spark: SparkSession, name: str) -> DataFrame:
    """Scan ``catalog.schema.table`` given as one dotted name."""
    return spark.table(quoted(*name.split(".")))


def layer_table(
    spark: SparkSession, catalog: str, schema_pattern: str, table_pattern: str, **params: str
) -> DataFrame:
    """Scan a table whose schema and name are patterns over parameters, such as
    ``"{partner}__ingested"`` and ``"{feed}__history"``."""
    return spark.table(
        quoted(catalog, schema_pattern.format(**params), table_pattern.format(**params))
    )


def layer_tables(
    spark: SparkSession,
    catalog: str,
    schema_pattern: str,
    table_pattern: str,
    choices: Sequence[Mapping[str, str]],
    source: str = "source_table",
) -> DataFrame:
    """Scan several tables of one layer as one, for each of ``choices`` the parameters
    of the patterns; see :func:`ledgerloom.operators.sets.union_sources`. The source
    is the table's schema and name with a dot between."""
    tables = {}
    for params in choices:
        schema, name = schema_pattern.format(**params), table_pattern.format(**params)
        tables[f"{schema}.{name}"] = spark.table(quoted(catalog, schema, name))
    return union_sources(tables, source)


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def _schema_names(spark: SparkSession, catalog: str) -> list[str]:
    listing = spark.sql(f"SHOW SCHEMAS IN {quoted(catalog)}")
    name = "namespace" if "namespace" in listing.columns else "databaseName"
    return [r[name] for r in listing.collect()]


def list_schemas(spark: SparkSession, catalog: str) -> DataFrame:
    """``schema_name`` rows, schemas without tables included."""
    return rows_to_df(spark, [(n,) for n in _schema_names(spark, catalog)], SCHEMA_ROWS)


@dataclass(frozen=True)
class Inventory:
    """One metadata pass over a catalog."""

    schemas: DataFrame
    tables: DataFrame
    errors: DataFrame


def inventory(
    spark: SparkSession, catalog: str, skip_errors: bool = True, parallelism: int = 8
) -> Inventory:
    """List every schema and its permanent tables once.

    A schema that cannot be listed is reported in ``errors`` and the rest goes
    on, unless ``skip_errors`` is off. Session views are left out: they show up
    under every schema of the session catalog.
    """
    names = _schema_names(spark, catalog)

    def listed(schema: str) -> tuple[list[tuple], list[tuple]]:
        try:
            rows = (
                spark.sql(f"SHOW TABLES IN {quoted(catalog, schema)}")
                .where(~F.col("isTemporary"))
                .select("tableName")
                .collect()
            )
            return [(schema, r.tableName) for r in rows], []
        except Exception as exc:  # any catalog failure is one reported row
            if not skip_errors:
                raise
            return [], [(schema, str(exc).splitlines()[0])]

    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(listed, names))
    return Inventory(
        rows_to_df(spark, [(n,) for n in names], SCHEMA_ROWS),
        rows_to_df(spark, [t for tables, _ in parts for t in tables], TABLE_ROWS),
        rows_to_df(spark, [e for _, errors in parts for e in errors], ERROR_ROWS),
    )


def list_tables(spark: SparkSession, catalog: str) -> DataFrame:
    """``(schema_name, table_name)`` rows; a schema that cannot be listed is an
    error. ``inventory`` reports such schemas and goes on."""
    return inventory(spark, catalog, skip_errors=False).tables
