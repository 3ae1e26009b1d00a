"""File counts across pipeline layers.

The acquisition ledger is the only place with file dates. Downstream layers
carry one lineage name per *record*, so both sides are reduced to distinct keys
before they meet; the join then moves files, never records.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.predicates import matches_param
from ledgerloom.functions.text import (
    acquisition_key,
    base_name,
    canonical_key,
    downstream_key,
    period,
)
from ledgerloom.operators.filters import in_years
from ledgerloom.operators.sets import stack_results


def acquired(acq: DataFrame, partner: str = "", feed: str = "") -> DataFrame:
    """Ledger rows whose partner and feed contain the parameters."""
    return acq.where(
        matches_param(F.col("trading_partner"), partner)
        & matches_param(F.col("data_feed"), feed)
    )


def files_by_period(
    acq: DataFrame,
    grain: str,
    years: Sequence[int | str] | None = None,
    partner: str = "",
    feed: str = "",
) -> DataFrame:
    """Distinct acquired files per month or year, in period order."""
    rows = acquired(acq, partner, feed)
    if years is not None:
        rows = rows.where(in_years(rows, "src_last_modified", years))
    return (
        rows.groupBy(period(F.col("src_last_modified"), grain).alias("period"))
        .agg(F.count_distinct("file_path").alias("unique_file_paths"))
        .orderBy("period")
    )


def acquisition_keys(
    acq: DataFrame,
    grain: str,
    partner: str = "",
    feed: str = "",
    canonical: bool = False,
) -> DataFrame:
    """Distinct ``(file_key, period)`` of the ledger."""
    key = canonical_key if canonical else acquisition_key
    return (
        acquired(acq, partner, feed)
        .select(
            key(F.col("file_path")).alias("file_key"),
            period(F.col("src_last_modified"), grain).alias("period"),
        )
        .where(F.col("file_key").isNotNull())
        .distinct()
    )


def layer_keys(layer: DataFrame, name_col: str) -> DataFrame:
    """``(file_key, n_names)``: distinct stored file names behind each key.

    Names are made distinct first and keys derived after, so the shuffle out of
    the records carries one text per file.
    """
    names = layer.where(F.col(name_col).isNotNull()).select(
        base_name(F.col(name_col)).alias("name")
    )
    return (
        names.distinct()
        .groupBy(downstream_key(F.col("name")).alias("file_key"))
        .agg(F.count(F.lit(1)).alias("n_names"))
    )


def match_files(
    acq: DataFrame,
    layer: DataFrame,
    grain: str,
    name_col: str = "meta_lineage_source_name",
    partner: str = "",
    feed: str = "",
    canonical: bool = False,
) -> DataFrame:
    """Acquired files found in a layer: ``(file_key, period, n_names)``."""
    return acquisition_keys(acq, grain, partner, feed, canonical).join(
        layer_keys(layer, name_col), "file_key"
    )


def layer_files_by_period(
    acq: DataFrame,
    layer: DataFrame,
    grain: str,
    name_col: str = "meta_lineage_source_name",
    partner: str = "",
    feed: str = "",
    canonical: bool = False,
) -> DataFrame:
    """Distinct layer file names per acquisition period, in period order.

    Names keep their suffix, so a file stored with and without it counts twice.
    A name has exactly one key, which is why per-key name counts can simply be
    summed over the keys of a period.
    """
    return (
        match_files(acq, layer, grain, name_col, partner, feed, canonical)
        .groupBy("period")
        .agg(F.sum("n_names").alias("unique_file_paths"))
        .orderBy("period")
    )


def layer_files_both(
    acq: DataFrame,
    layer: DataFrame,
    name_col: str = "meta_lineage_source_name",
    partner: str = "",
    feed: str = "",
) -> DataFrame:
    """Month and year counts of a layer from one scan of each side, as
    ``(grain, period, unique_file_paths)``. A year is not the sum of its months,
    so keys are made distinct again per grain; they already sit together by key
    after the join."""
    month = F.col("period")
    grains = F.array(
        F.struct(F.lit("month").alias("grain"), month.alias("period")),
        F.struct(F.lit("year").alias("grain"), F.left(month, F.lit(4)).alias("period")),
    )
    return (
        match_files(acq, layer, "month", name_col, partner, feed)
        .select("file_key", "n_names", F.explode(grains).alias("at"))
        .select("file_key", "n_names", "at.*")
        .distinct()
        .groupBy("grain", "period")
        .agg(F.sum("n_names").alias("unique_file_paths"))
        .orderBy("grain", "period")
    )


def coverage(
    acq: DataFrame,
    layers: Mapping[str, tuple[DataFrame, str]],
    grain: str,
    partner: str = "",
    feed: str = "",
) -> DataFrame:
    """Acquired files per period and how many of them reached each layer.

    ``layers`` maps a label to (table, name column). One key rule is used on
    both sides, so every ratio lies between 0 and 1. All layers are gathered in
    one aggregate per key and meet the ledger in one join.
    """
    labels = list(layers)
    seen = stack_results(
        [
            layers[label][0].select(
                canonical_key(F.col(layers[label][1])).alias("file_key"), F.lit(i).alias("layer")
            )
            for i, label in enumerate(labels)
        ]
    )
    found = (
        seen.where(F.col("file_key").isNotNull())
        .groupBy("file_key")
        .agg(*[F.max((F.col("layer") == i).cast("int")).alias(f"_{i}") for i in range(len(labels))])
    )
    counts = (
        acquisition_keys(acq, grain, partner, feed, canonical=True)
        .join(found, "file_key", "left")
        .groupBy("period")
        .agg(
            F.count(F.lit(1)).alias("acquired_files"),
            *[
                F.coalesce(F.sum(f"_{i}"), F.lit(0)).alias(f"{label}_files")
                for i, label in enumerate(labels)
            ],
        )
    )
    return counts.select(
        "*",
        *[
            (F.col(f"{label}_files") / F.col("acquired_files")).alias(f"{label}_coverage")
            for label in labels
        ],
    ).orderBy("period")
