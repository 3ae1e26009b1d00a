"""Path, period and name keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = {"month": 7, "year": 4}
SUFFIX = ".bz2"


def base_name(path: Column) -> Column:
    """Part after the last ``/``; an all-directory path gives ``''``."""
    return F.substring_index(path, "/", -1)


def acquisition_key(path: Column, suffix: str = SUFFIX) -> Column:
    """Base name cut at the first suffix, but only where the path ends in it."""
    base = base_name(path)
    return F.when(path.endswith(suffix), F.substring_index(base, suffix, 1)).otherwise(base)


def downstream_key(name: Column, suffix: str = SUFFIX) -> Column:
    """Name with every occurrence of the suffix removed."""
    return F.replace(name, F.lit(suffix), F.lit(""))


def canonical_key(path: Column, suffix: str = SUFFIX) -> Column:
    """One key rule for both sides: base name without any suffix."""
    return downstream_key(base_name(path), suffix)


def period(ts: Column, grain: str) -> Column:
    """``yyyy-MM`` or ``yyyy`` prefix of a string, date or timestamp."""
    return F.left(ts.cast("string"), F.lit(GRAINS[grain]))


def base_schema(name: Column) -> Column:
    """Trimmed text before the first ``__``."""
    return F.trim(F.substring_index(name, "__", 1))


def standard_base(name: Column) -> Column:
    """Like ``base_schema`` but a leading ``__`` is dropped first."""
    return F.trim(F.regexp_replace(name, r"^__|__.*$", ""))


# Result texts of the existence check.
TYPE_EXISTS = "Table %s type exists"
TYPE_MISSING = "Table %s type does not exist - need to investigate"


def type_message(code: Column, exists: Column) -> Column:
    return F.when(exists, F.format_string(TYPE_EXISTS, code)).otherwise(
        F.format_string(TYPE_MISSING, code)
    )
