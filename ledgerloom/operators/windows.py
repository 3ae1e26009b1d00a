"""Shares, group picks and row numbers, without one-task windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.storage import cut_lineage


def share_overall(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows per (group, label) as a share of all rows.

    The grand total is a scalar subquery over the same aggregate, so no window
    pulls the groups into one partition.
    """
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    everything = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / everything)


def share_within(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows per (group, label) as a share of the group's rows.

    The window runs on aggregated rows: one per label inside a group.
    """
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def percent_of_total(df: DataFrame, measure: str = "total_amount", name: str = "pct") -> DataFrame:
    """Each row's percentage of the measure's grand total, one decimal."""
    everything = df.agg(F.sum(measure).cast("double")).scalar()
    return df.withColumn(
        name, F.round(F.try_divide(100 * F.col(measure).cast("double"), everything), 1)
    )


def keep_false_or_first(
    df: DataFrame,
    group: Sequence[str],
    flag: str,
    order: Sequence[str],
    prefer: str = "False",
    small_groups: bool = False,
) -> DataFrame:
    """Per group: every row flagged ``prefer`` if there is one, else the first
    row in ascending ``order`` (null first).

    Two branches instead of a window: the flagged rows pass through untouched,
    and groups without any are reduced to their first row by a partial
    aggregate. A group of any size stays spread over the map tasks. Where the
    caller knows that groups hold a handful of rows, ``small_groups`` reads the
    input once, with a window.
    """
    if small_groups:
        whole = Window.partitionBy(*group)
        return (
            df.withColumn("_any", F.bool_or(F.col(flag) == prefer).over(whole))
            .withColumn("_rank", F.row_number().over(whole.orderBy(*order)))
            .where(F.when(F.col("_any"), F.col(flag) == prefer).otherwise(F.col("_rank") == 1))
            .drop("_any", "_rank")
        )
    flagged = df.where(F.col(flag) == prefer)
    rest = [c for c in df.columns if c not in group]
    firsts = (
        df.groupBy(*group)
        .agg(
            F.coalesce(F.bool_or(F.col(flag) == prefer), F.lit(False)).alias("_any"),
            F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"),
        )
        .where(~F.col("_any"))
        .select(*group, *[F.col(f"_first.{c}").alias(c) for c in rest])
    )
    return flagged.unionByName(firsts.select(*df.columns))


def row_id(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """1-based position of each row under a total order.

    A window over everything would sort the table in one task. Here the rows
    are range-partitioned and sorted, and each partition is shifted by the rows
    before it. The sorted rows are checkpointed between the two uses, because
    range bounds are sampled anew on every run. Only one count per partition is
    ever gathered.

    Rows with equal ``order`` values are ranged by a hash of the whole row and, where
    that is equal as well, by the task they come from: a value that a third of all
    rows share, or all of them, is spread over tasks like any other range.
    """
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    ties = [F.xxhash64(*[F.col(f"`{c}`") for c in hashed]), F.spark_partition_id()]
    tied = df.withColumns({"_tie": ties[0], "_from": ties[1]})
    placed = cut_lineage(
        tied.repartitionByRange(*[F.col(c) for c in order], "_tie", "_from")
        .sortWithinPartitions(*order, "_tie", "_from")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift")
    )
    # one row per partition, so the broadcast is bounded by the partition count
    return placed.join(F.broadcast(shifts), "_part").select(
        *df.columns, (F.col("_shift") + F.col("_pos") + 1).alias(name)
    )
