"""Grouped totals, counts and flags.

Every aggregate here has a partial form, so a key that holds a third of the
rows is combined inside each map task and shuffles as a handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.predicates import is_populated, nan_to_null


def total(amount: Column) -> Column:
    """Sum of the values there are, null and NaN aside; 0 without any."""
    summed = F.sum(nan_to_null(amount))
    return F.coalesce(summed, F.lit(0))


def count_and_sum(df: DataFrame, key: str, amount: str) -> DataFrame:
    """Rows and total per key, with null keys counted under ``''``."""
    return (
        df.groupBy(F.coalesce(F.col(key), F.lit("")).alias(key))
        .agg(F.count(F.lit(1)).alias("n_rows"), total(F.col(amount)).alias("total_amount"))
    )


def total_by(
    df: DataFrame, key: Column | str, amount: str, name: str | None = None
) -> DataFrame:
    """Total per key; rows with a null key are left out."""
    col = F.col(key) if isinstance(key, str) else key
    name = name or (key if isinstance(key, str) else "key")
    return (
        df.where(col.isNotNull())
        .groupBy(col.alias(name))
        .agg(total(F.col(amount)).alias("total_amount"))
    )


def total_by_class(totals: DataFrame, label: Column, name: str = "label") -> DataFrame:
    """Second-level total: per-key totals regrouped under a class label."""
    return totals.groupBy(label.alias(name)).agg(
        total(F.col("total_amount")).alias("total_amount")
    )


def bin_summary(totals: DataFrame, label: Column, name: str = "label") -> DataFrame:
    """Number of keys and total per class label."""
    return totals.groupBy(label.alias(name)).agg(
        F.count(F.lit(1)).alias("n_keys"), total(F.col("total_amount")).alias("total_amount")
    )


def count_by(df: DataFrame, keys: Sequence[str] | str, col: str, name: str = "n") -> DataFrame:
    """Non-null values of ``col`` per key."""
    return df.groupBy(*_listed(keys)).agg(F.count(col).alias(name))


def size_by(df: DataFrame, keys: Sequence[str] | str, name: str = "n") -> DataFrame:
    """Rows per key."""
    return df.groupBy(*_listed(keys)).agg(F.count(F.lit(1)).alias(name))


def any_populated(
    rows: DataFrame, col: str, keys: Sequence[str] = ("schema_name", "table_name"),
    name: str = "populated",
) -> DataFrame:
    """Per table, whether any of its tagged rows has a populated ``col``."""
    return rows.groupBy(*keys).agg(F.bool_or(is_populated(F.col(col))).alias(name))


def has_tables(schemas: DataFrame, tables: DataFrame, name: str = "has_tables") -> DataFrame:
    """Every schema with a flag for owning any table."""
    counts = tables.groupBy("schema_name").agg(F.count("table_name").alias("_n"))
    return schemas.join(counts, "schema_name", "left").select(
        "schema_name", (F.coalesce("_n", F.lit(0)) > 0).alias(name)
    )


def percent_where(df: DataFrame, base: Column, hit: Column, name: str = "percent") -> DataFrame:
    """One row: 100 * share of the ``base`` rows that also satisfy ``hit``."""
    rows = df.where(base)
    return rows.agg(
        (F.try_divide(100 * F.count_if(hit), F.count(F.lit(1)))).alias(name)
    )


def mean_sd(df: DataFrame, base: Column, col: str) -> DataFrame:
    """One row: mean and sample standard deviation over the ``base`` rows."""
    return df.where(base).agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"))


def _listed(keys: Sequence[str] | str) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)
