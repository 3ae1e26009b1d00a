"""Onboarding status of data partners, derived from a catalog inventory."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.labels import bool_text, override_where, same_type_label, type_code
from ledgerloom.functions.predicates import (
    contains_any,
    contains_ci,
    is_crosswalk,
    is_populated,
)
from ledgerloom.functions.text import base_schema, standard_base, type_message
from ledgerloom.operators.aggregates import any_populated, has_tables, size_by
from ledgerloom.operators.joins import flag_exists
from ledgerloom.operators.windows import keep_false_or_first
from ledgerloom.sources.catalog import inventory, quoted
from ledgerloom.sources.frames import rows_to_df

CODES = ("835", "837")
PROBED_ROWS = "schema_name string, table_name string, populated boolean"

# Result texts of the status table.
NO_STANDARDIZED = "No Standardized schemas exist"
NO_SHARED = "No Shared schemas exist"
MISSING_TYPE = "type does not exist - need to investigate"
TYPES_MATCH = "Std Schema has corresponding Ingested table types"
TYPES_DIFFER = "Std Schema doesn't have any corresponding table types"


def typed_inventory(tables: DataFrame, codes: Sequence[str] = CODES) -> DataFrame:
    """Tables named after a feed type, with type, base schema and layer flags."""
    return tables.where(contains_any(F.col("table_name"), codes)).select(
        "schema_name",
        "table_name",
        type_code(F.col("table_name"), codes).alias("type_code"),
        base_schema(F.col("schema_name")).alias("base_schema"),
        contains_ci(F.col("schema_name"), "ingested").alias("is_ingested"),
        contains_ci(F.col("schema_name"), "standardized").alias("is_standardized"),
        is_crosswalk(F.col("table_name"), codes).alias("is_crosswalk"),
    )


def ingested_types(tables: DataFrame, codes: Sequence[str] = CODES) -> DataFrame:
    """Distinct ``(base_schema, type_ingested)``."""
    return (
        typed_inventory(tables, codes)
        .where("is_ingested")
        .select("base_schema", F.col("type_code").alias("type_ingested"))
        .distinct()
    )


def probe_tables(
    spark: SparkSession,
    names: Sequence[tuple[str, str]],
    catalog: str,
    col: str = "account_number",
    parallelism: int = 16,
) -> DataFrame:
    """``(schema_name, table_name, populated)`` for catalog tables.

    A probe is a plan over one table, whatever their number, and stops early: it looks
    at one partition, then at four times as many, until it meets a populated row. So
    ``parallelism`` probes run at a time. What comes back is one flag a table. A table
    without the column is not populated.
    """

    def probed(pair: tuple[str, str]) -> tuple[str, str, bool]:
        table = spark.table(quoted(catalog, *pair))
        if col not in table.columns:
            return (*pair, False)
        return (*pair, not table.where(is_populated(F.col(col))).select(col).isEmpty())

    with ThreadPoolExecutor(parallelism) as pool:
        found = list(pool.map(probed, dict.fromkeys(map(tuple, names))))
    return rows_to_df(spark, found, PROBED_ROWS)


def account_link(
    tables: DataFrame, populated: DataFrame, codes: Sequence[str] = CODES
) -> DataFrame:
    """Distinct ``(schema_name, type_code, linked)`` over the crosswalk tables of
    standardized schemas; ``linked`` is the text True or False. A crosswalk
    table without a row in ``populated`` is empty, hence False."""
    return (
        typed_inventory(tables, codes)
        .where("is_standardized and is_crosswalk")
        .join(populated, ["schema_name", "table_name"], "left")
        .select(
            "schema_name",
            "type_code",
            bool_text(F.coalesce("populated", F.lit(False))).alias("linked"),
        )
        .distinct()
    )


def account_link_from_rows(
    tables: DataFrame, rows: DataFrame, col: str = "account_number", codes: Sequence[str] = CODES
) -> DataFrame:
    """``account_link`` where the crosswalk rows come as one tagged frame."""
    return account_link(tables, any_populated(rows, col), codes)


def attach_link(
    links: DataFrame, tables: DataFrame, codes: Sequence[str] = CODES
) -> DataFrame:
    """Link flags joined to every standardized table of the same schema and type."""
    standardized = (
        typed_inventory(tables, codes)
        .where("is_standardized")
        .select("schema_name", "type_code", "table_name")
    )
    return links.join(standardized, ["schema_name", "type_code"])


def schema_flags(schemas: DataFrame, tables: DataFrame, layer: str) -> DataFrame:
    """Schemas of a layer with base names and whether they own any table."""
    return has_tables(schemas.where(F.col("schema_name").contains(layer)), tables).withColumns(
        {
            "base_schema": base_schema(F.col("schema_name")),
            "standard_base": standard_base(F.col("schema_name")),
        }
    )


def type_comparison(
    tables: DataFrame, links: DataFrame, codes: Sequence[str] = CODES
) -> DataFrame:
    """Ingested against standardized type of each base schema, as a label."""
    standardized = links.select(
        base_schema(F.col("schema_name")).alias("base_schema"),
        F.col("type_code").alias("type_standardized"),
    ).distinct()
    return (
        ingested_types(tables, codes)
        .join(standardized, "base_schema", "left")
        .withColumn("type_standardized", F.coalesce("type_standardized", F.lit(NO_STANDARDIZED)))
        .withColumn(
            "type_label",
            same_type_label(
                F.col("type_ingested"), F.col("type_standardized"), TYPES_MATCH, TYPES_DIFFER
            ),
        )
    )


def status(
    schemas: DataFrame,
    tables: DataFrame,
    links: DataFrame,
    codes: Sequence[str] = CODES,
    per_type: bool = False,
    prefer: str = "False",
) -> DataFrame:
    """One line per partner and ingested feed type: standardized, shared, linked.

    ``links`` is the result of :func:`account_link`. Standardized types are
    taken from schemas that own a crosswalk table for the type. Link flags apply
    to all types of a partner unless ``per_type`` is set. Where a partner's
    lines differ in linking, those equal to ``prefer`` stay.

    Everything known about a partner is folded into one row per base schema
    before the joins, so that a line fans out only by its own flags: two for
    shared and two for linked at most.
    """
    linked = F.col("_links")
    if per_type:
        linked = F.filter(linked, lambda s: s["type_code"] == F.col("type_ingested"))
    lines = (
        ingested_types(tables, codes)
        .join(_schema_facts(schemas, tables), "base_schema", "left")
        .join(_link_facts(links), "base_schema", "left")
        .select(
            F.col("base_schema").alias("partner"),
            "type_ingested",
            F.when(F.col("_links").isNull() & ~F.coalesce("_standard", F.lit(False)), NO_STANDARDIZED)
            .when(F.exists("_links", lambda s: s["type_code"] == F.col("type_ingested")), "True")
            .otherwise(type_message(F.col("type_ingested"), F.lit(False)))
            .alias("standardized_completed"),
            F.array_distinct(F.transform(linked, lambda s: s["linked"])).alias("_linked"),
            F.explode_outer("_shared").alias("_shared"),
        )
        .select(
            "partner",
            "type_ingested",
            "standardized_completed",
            F.coalesce("_shared.flag", F.lit(NO_SHARED)).alias("shared_completed"),
            F.col("_shared.first_schema").alias("_first_shared"),
            F.explode_outer("_linked").alias("_flag"),
        )
        .withColumn("account_linking_completed", F.coalesce("_flag", F.lit("False")))
        .drop("_flag")
    )
    kept = keep_false_or_first(
        lines,
        ["partner", "type_ingested"],
        "account_linking_completed",
        ["_first_shared", "shared_completed"],
        prefer,
        small_groups=True,
    )
    missing = F.col("standardized_completed")
    return kept.select(
        F.col("partner").alias("trading_partner_id"),
        F.col("type_ingested").alias("table_type_ingested"),
        "standardized_completed",
        override_where(F.col("shared_completed"), missing, MISSING_TYPE, "False").alias(
            "shared_completed"
        ),
        override_where(F.col("account_linking_completed"), missing, MISSING_TYPE, "False").alias(
            "account_linking_completed"
        ),
    )


def catalog_status(
    spark: SparkSession,
    catalog: str,
    codes: Sequence[str] = CODES,
    col: str = "account_number",
    **options: object,
) -> DataFrame:
    """:func:`status` of a live catalog: one metadata listing, a probe of each
    crosswalk table. Only names from the listing reach the driver.

    What a schema that could not be listed holds is unknown, so a partner with
    such a schema has ``Unknown`` wherever its lines would not be ``True``.
    """
    found = inventory(spark, catalog)
    crosswalks = typed_inventory(found.tables, codes).where("is_standardized and is_crosswalk")
    names = [tuple(r) for r in crosswalks.select("schema_name", "table_name").collect()]
    links = account_link(found.tables, probe_tables(spark, names, catalog, col), codes)
    lines = status(found.schemas, found.tables, links, codes, **options)
    return mark_unknown(lines, found.errors)


def mark_unknown(lines: DataFrame, errors: DataFrame) -> DataFrame:
    """Status lines in which nothing is denied of partners with unread schemas."""
    bases = F.array(base_schema(F.col("schema_name")), standard_base(F.col("schema_name")))
    unread = errors.select(F.explode(bases).alias("trading_partner_id")).distinct()
    flagged = flag_exists(lines, unread, ["trading_partner_id"], "_unread")
    return flagged.select(
        *[
            F.when(F.col("_unread") & (F.col(c) != "True"), "Unknown").otherwise(F.col(c)).alias(c)
            if c.endswith("_completed")
            else F.col(c)
            for c in lines.columns
        ]
    )


def _schema_facts(schemas: DataFrame, tables: DataFrame) -> DataFrame:
    """Per base schema: shared flags, each with its first schema name, and
    whether a standardized schema exists.

    The order of schema names settles which shared flag comes first. The two
    layers cut names by different rules, so each adds its own key.
    """
    layers = F.col("schema_name").contains("shared") | F.col("schema_name").contains("standardized")
    named = has_tables(schemas.where(layers), tables)
    shared = F.when(F.col("schema_name").contains("shared"), F.col("schema_name"))
    per_key = named.select(
        F.explode(
            F.array(
                F.struct(
                    base_schema(shared).alias("base_schema"),
                    F.when(F.col("has_tables"), shared).alias("with_tables"),
                    F.when(~F.col("has_tables"), shared).alias("without"),
                    F.lit(False).alias("standard"),
                ),
                F.struct(
                    F.when(
                        F.col("schema_name").contains("standardized"),
                        standard_base(F.col("schema_name")),
                    ).alias("base_schema"),
                    F.lit(None).cast("string").alias("with_tables"),
                    F.lit(None).cast("string").alias("without"),
                    F.lit(True).alias("standard"),
                ),
            )
        ).alias("fact")
    ).select("fact.*")
    firsts = [F.min("with_tables"), F.min("without")]
    return (
        per_key.where(F.col("base_schema").isNotNull())
        .groupBy("base_schema")
        .agg(
            F.filter(
                F.array(
                    *[
                        F.struct(first.alias("first_schema"), F.lit(flag).alias("flag"))
                        for first, flag in zip(firsts, ("True", "False"))
                    ]
                ),
                lambda s: s["first_schema"].isNotNull(),
            ).alias("_shared"),
            F.bool_or("standard").alias("_standard"),
        )
    )


def _link_facts(links: DataFrame) -> DataFrame:
    """Per base schema, its (type, linked) pairs: two flags per known code."""
    return links.groupBy(base_schema(F.col("schema_name")).alias("base_schema")).agg(
        F.collect_set(F.struct("type_code", "linked")).alias("_links")
    )


def funnel(lines: DataFrame) -> DataFrame:
    """Lines per feed type at each stage, from one pass over the status table.

    A partner and type that is linked has a single status line, so "shared but
    not linked" can be decided line by line.
    """
    linked = F.col("account_linking_completed") == "True"
    standardized = F.col("standardized_completed") == "True"
    return lines.groupBy("table_type_ingested").agg(
        F.count("trading_partner_id").alias("ingested"),
        F.count_if(~standardized).alias("ingested_only"),
        F.count_if(standardized).alias("standardized"),
        F.count_if((F.col("shared_completed") == "True") & ~linked).alias("shared_not_linked"),
        F.count_if(linked).alias("fully_linked"),
    )


def shared_not_linked(lines: DataFrame) -> DataFrame:
    """Shared lines whose partner and type have no linked line: a linked partner
    and type has a single line, so this is a test of the line itself."""
    return lines.where(
        (F.col("shared_completed") == "True") & (F.col("account_linking_completed") != "True")
    ).select("trading_partner_id", "table_type_ingested", "shared_completed")


def stage_counts(lines: DataFrame, column: str, value: str, name: str) -> DataFrame:
    """Lines per feed type whose stage column has the value."""
    return size_by(lines.where(F.col(column) == value), "table_type_ingested", name)
