"""CSV sources. Types are declared, so no inference pass reads the data."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources.frames import rows_to_df

RECORD = "_corrupt_record"
CONTRIBUTION_TYPES = {"AmountReceivedThisPeriod": "decimal(18,2)"}
SURVEY_TYPES = {
    "Age": "int",
    "ExperienceYears": "int",
    "RemoteWorkHoursPerWeek": "int",
    "JobSatisfaction": "int",
    "TechToolsUsed": "int",
    "Salary": "double",
}


def read_csv(
    spark: SparkSession,
    path: str,
    types: Mapping[str, str],
    trim_names: bool = False,
    multiline: bool = False,
    strict: bool = False,
) -> DataFrame:
    """CSV with a header; empty fields are null, columns outside ``types`` are text.

    Only the header line is looked at while planning. Columns are typed by name,
    and a value that does not fit its type becomes null; ``rejected_values`` counts
    such values, and ``strict`` makes the first one an error. A decimal with more
    digits than its type is rounded. ``multiline`` allows line breaks inside quotes,
    at the price that a file is then read by one task.

    A row with more fields than the header loses the further ones, one with fewer has
    nulls for the rest; ``corrupt_rows`` returns such rows as they stand in the file,
    and ``strict`` makes the first one an error, too.
    """
    raw = _raw_csv(spark, path, trim_names, multiline)
    if strict:
        whole = _marked_csv(spark, path, raw.columns, multiline)
        # a further column in the message: the reader wants more than the record asked for
        first = F.coalesce(F.col(f"`{raw.columns[0]}`").substr(1, 0), F.lit(""))
        said = F.concat(F.lit("not as many fields as the header: "), F.col(RECORD), first)
        raw = whole.where(F.when(F.col(RECORD).isNotNull(), F.raise_error(said)).otherwise(True))
        raw = raw.drop(RECORD)
    typed = []
    for c in raw.columns:
        text = F.col(f"`{c}`")
        if c in types:
            fits = text.try_cast(types[c])
            if strict:
                said = F.concat(F.lit(f"{c}: not a {types[c]}: "), text)
                fits = F.when(fits.isNull() & text.isNotNull(), F.raise_error(said)).otherwise(fits)
            text = fits.alias(c)
        typed.append(text)
    return raw.select(*typed)


def _raw_csv(spark: SparkSession, path: str, trim_names: bool, multiline: bool) -> DataFrame:
    raw = spark.read.csv(path, header=True, nullValue="", quote='"', escape='"', multiLine=multiline)
    return raw.toDF(*[c.rstrip() for c in raw.columns]) if trim_names else raw


def _marked_csv(spark: SparkSession, path: str, columns: list[str], multiline: bool) -> DataFrame:
    """All columns as text under the names given, and in ``RECORD`` the whole line of a
    row whose fields are not as many as the header's. The reader then has to look at
    every field, so its column pruning is off."""
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))]
    schema = T.StructType([*fields, T.StructField(RECORD, T.StringType())])
    read = spark.read.option("columnPruning", False).csv(
        path, schema=schema, header=True, nullValue="", quote='"', escape='"', multiLine=multiline,
        columnNameOfCorruptRecord=RECORD, mode="PERMISSIVE", enforceSchema=True,
    )
    return read.toDF(*columns, RECORD)


def corrupt_rows(
    spark: SparkSession,
    path: str,
    types: Mapping[str, str] | None = None,
    trim_names: bool = False,
    multiline: bool = False,
) -> DataFrame:
    """``(record, reason)``: lines with another number of fields than the header
    (``fields``), and lines of which a value does not fit its type (the column's
    name); a line has a row for each reason. One pass over the file."""
    types = types or {}
    names = _raw_csv(spark, path, trim_names, multiline).columns
    rows = _marked_csv(spark, path, names, multiline)
    reasons = [F.when(F.col(RECORD).isNotNull(), F.lit("fields"))]
    for c in (c for c in names if c in types):
        text = F.col(f"`{c}`")
        reasons.append(F.when(text.isNotNull() & text.try_cast(types[c]).isNull(), F.lit(c)))
    # a line of the right length is put together again
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in names]))
    return rows.select(
        F.coalesce(RECORD, line).alias("record"),
        F.explode(F.array_compact(F.array(*reasons))).alias("reason"),
    )


def rejected_values(
    spark: SparkSession,
    path: str,
    types: Mapping[str, str],
    trim_names: bool = False,
    multiline: bool = False,
) -> DataFrame:
    """``(column_name, n_rejected, n_rounded)``: values of each typed column that do
    not fit its type, and decimals that lose digits to it; one pass over the file."""
    raw = _raw_csv(spark, path, trim_names, multiline)
    facts = []
    for c in (c for c in raw.columns if c in types):
        text, fits = F.col(f"`{c}`"), F.col(f"`{c}`").try_cast(types[c])
        whole = text.try_cast("decimal(38,18)")
        rounded = fits.isNotNull() & (whole != fits.cast("decimal(38,18)"))
        if not types[c].startswith("decimal"):
            rounded = F.lit(False)
        facts.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count_if(text.isNotNull() & fits.isNull()).alias("n_rejected"),
                F.count_if(rounded).alias("n_rounded"),
            )
        )
    if not facts:
        return rows_to_df(spark, [], "column_name string, n_rejected long, n_rounded long")
    return raw.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


def read_contributions(
    spark: SparkSession, path: str, types: Mapping[str, str] = CONTRIBUTION_TYPES
) -> DataFrame:
    return read_csv(spark, path, types)


def read_survey(
    spark: SparkSession, path: str, types: Mapping[str, str] = SURVEY_TYPES
) -> DataFrame:
    return read_csv(spark, path, types, trim_names=True)
