"""Contribution totals by donor, industry, size, place and cohort.

Column names are arguments with the fixture's names as defaults. Money stays
decimal until a share is taken, so totals do not depend on row order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.labels import keyword_class, place_class, replace_values, size_bin
from ledgerloom.functions.predicates import is_blank
from ledgerloom.operators.aggregates import (
    bin_summary,
    count_and_sum,
    total,
    total_by,
    total_by_class,
)
from ledgerloom.operators.filters import tag_cohort, where_in
from ledgerloom.operators.joins import exclude_keys
from ledgerloom.operators.ordering import top_totals
from ledgerloom.operators.sets import stack
from ledgerloom.operators.windows import percent_of_total
from ledgerloom.sources.frames import rows_to_df

Rules = Sequence[tuple[str, Sequence[str]]]
Cuts = Sequence[tuple[object, str]]


def cohort_rows(df: DataFrame, filers: Sequence[str], key: str = "filer") -> DataFrame:
    return where_in(df, key, filers)


def by_code(df: DataFrame, code: str = "contributor_code", amount: str = "amount") -> DataFrame:
    """Rows and total per contributor code; a missing code is the ``''`` group."""
    return count_and_sum(df, code, amount)


def organizations(df: DataFrame, first: str = "contributor_first") -> DataFrame:
    """Rows without a first name."""
    return df.where(is_blank(F.col(first)))


def org_totals(
    df: DataFrame,
    name: str = "contributor_last",
    first: str = "contributor_first",
    amount: str = "amount",
) -> DataFrame:
    """Total per organization name, largest first."""
    return top_totals(total_by(organizations(df, first), name, amount), "total_amount", name)


def contributor_totals(
    df: DataFrame, name: str = "contributor_last", amount: str = "amount"
) -> DataFrame:
    """Total per contributor name, largest first."""
    return top_totals(total_by(df, name, amount), "total_amount", name)


def individuals(
    all_totals: DataFrame, orgs: DataFrame, name: str = "contributor_last"
) -> DataFrame:
    """Contributor totals whose name is not also an organization's."""
    return exclude_keys(all_totals, orgs, name)


def donors(
    df: DataFrame,
    name: str = "contributor_last",
    first: str = "contributor_first",
    amount: str = "amount",
) -> DataFrame:
    """Both kinds of donor from one scan and one shuffle.

    ``(name, is_org, org_amount, total_amount)``. A name is an organization as
    soon as one of its rows lacks a first name, so the anti-join of
    :func:`individuals` is the filter ``not is_org`` here.
    """
    org = is_blank(F.col(first))
    return (
        df.where(F.col(name).isNotNull())
        .groupBy(name)
        .agg(
            F.bool_or(org).alias("is_org"),
            total(F.when(org, F.col(amount))).alias("org_amount"),
            total(F.col(amount)).alias("total_amount"),
        )
    )


def industry_totals(
    orgs: DataFrame, rules: Rules, name: str = "contributor_last", default: str = "Other"
) -> DataFrame:
    """Organization totals per keyword class with percentages."""
    return percent_of_total(
        total_by_class(orgs, keyword_class(F.col(name), rules, default), "category")
    )


def size_bins(people: DataFrame, cuts: Cuts, lowest: str) -> DataFrame:
    """Number of individuals and their total per size label, with percentages."""
    return percent_of_total(
        bin_summary(people, size_bin(F.col("total_amount"), cuts, lowest), "category")
    )


def combined(
    df: DataFrame,
    rules: Rules,
    cuts: Cuts,
    lowest: str,
    name: str = "contributor_last",
    first: str = "contributor_first",
    amount: str = "amount",
) -> DataFrame:
    """Industry classes and size bins under one label column, with each one's
    percentage of everything.

    Every donor gets its label and the amount that counts for it in place, so
    the two kinds are not scanned apart and concatenated.
    """
    is_org = F.col("is_org")
    labelled = donors(df, name, first, amount).select(
        "is_org",
        F.when(is_org, keyword_class(F.col(name), rules))
        .otherwise(size_bin(F.col("total_amount"), cuts, lowest))
        .alias("label"),
        F.when(is_org, F.col("org_amount")).otherwise(F.col("total_amount")).alias("counted"),
    )
    totals = labelled.groupBy("is_org", "label").agg(total(F.col("counted")).alias("total_amount"))
    return percent_of_total(totals).drop("is_org")


def stacked(industries: DataFrame, bins: DataFrame) -> DataFrame:
    """Two finished breakdowns under one schema, with shares of their joint total."""
    return percent_of_total(
        stack([(industries, "category"), (bins, "category")], "label", ["total_amount"])
    )


def city_totals(
    df: DataFrame,
    city: str = "contributor_city",
    amount: str = "amount",
    normalize: bool = False,
) -> DataFrame:
    """Total per city; ``normalize`` folds case in the same grouping."""
    key = F.lower(F.col(city)) if normalize else F.col(city)
    return total_by(df, key, amount, city)


def city_classes(
    df: DataFrame,
    home: str,
    near: Sequence[str],
    labels: tuple[str, str, str],
    city: str = "contributor_city",
    amount: str = "amount",
    normalize: bool = False,
) -> DataFrame:
    """Totals by distance class with percentages."""
    cities = city_totals(df, city, amount, normalize)
    return percent_of_total(
        total_by_class(
            cities, place_class(F.col(city), home, near, labels, normalize), "category"
        )
    )


def cohort_totals(
    df: DataFrame,
    cohorts: Mapping[str, Sequence[str]],
    titles: Mapping[str, str] | None = None,
    key: str = "filer",
    amount: str = "amount",
) -> DataFrame:
    """Total per cohort with percentages, one pass over all cohorts.

    A cohort without any row still shows, with total 0.
    """
    names = rows_to_df(df.sparkSession, [(c,) for c in cohorts], "cohort string")
    tagged = tag_cohort(df, cohorts, key)
    sums = tagged.groupBy("cohort").agg(F.sum(amount).alias("total_amount"))
    totals = names.join(sums, "cohort", "left").withColumn(
        "total_amount", F.coalesce("total_amount", F.lit(0))
    )
    return percent_of_total(
        totals.withColumn("cohort", replace_values(F.col("cohort"), titles or {}))
    )
