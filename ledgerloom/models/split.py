"""Reproducible train/test splits and folds that are pure row tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.windows import row_id

_STEP = 16  # bits settled by one histogram, 65,536 counts at most


def _rank_key(id_col: str, seed: int) -> Column:
    return F.xxhash64(F.col(id_col), F.lit(seed))


def train_test(
    df: DataFrame, id_col: str, test: float = 0.2, seed: int = 100, exact: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(train, test) without replacement, decided by a hash of a unique id.

    ``exact`` puts exactly ``floor(test * n)`` rows in the test part: those with
    the smallest hashes. The cut-off is found from counts of hash prefixes, so
    nothing is sorted and both parts stay filters over the same scan. Rows that
    share the hash at the cut-off (repeated ids, null ones) are numbered by all
    their columns and parted by that number; only these are sorted. Without
    ``exact`` the test share is only expected, and no pass is needed.
    """
    key = _rank_key(id_col, seed)
    if not exact:
        chosen = F.pmod(key, F.lit(1_000_000)) < int(test * 1_000_000)
        return df.where(~chosen), df.where(chosen)
    below, at, left = _cut_off(df, key, test)
    if at is None:
        return df.where(~below), df.where(below)
    tied = row_id(df.where(at), [id_col, *(c for c in df.columns if c != id_col)], "_tied")
    train = df.where(~below & ~at).unionByName(tied.where(F.col("_tied") > left).drop("_tied"))
    return train, df.where(below).unionByName(tied.where(F.col("_tied") <= left).drop("_tied"))


def _cut_off(df: DataFrame, key: Column, share: float) -> tuple[Column, Column | None, int]:
    """Test for the rows below the cut-off of the ``floor(share * n)`` smallest
    keys and, where only some rows with the key at the cut-off belong to them, a
    test for that key and the number of its rows that do."""
    # the signed hash is walked from its top bits; `left` rows are still to be
    # placed among those sharing the prefix found so far
    left, prefix, rows = None, None, df
    for shift in range(64 - _STEP, -1, -_STEP):
        prefixes = F.shiftright(key, shift)
        histogram = rows.groupBy(prefixes.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        counts = sorted((r.prefix, r.n) for r in histogram.collect())
        if left is None:
            left = int(share * sum(n for _, n in counts))
            if left == 0:
                return F.lit(False), None, 0
        for prefix, n in counts:
            if left <= n:
                break
            left -= n
        rows = rows.where(prefixes == prefix)
        if n == left:  # the whole prefix goes to the test part
            return prefixes <= prefix, None, 0
    return key < prefix, key == prefix, left


def fold_in(id_col: str, folds: int, seed: int, fold_col: str | None) -> Column:
    """Folds given by a column, or else by a hash of the id."""
    if fold_col is None:
        return fold_of(id_col, folds, seed)
    given = F.col(fold_col).cast("int")
    wrong = F.concat(F.lit(f"{fold_col} is no fold below {folds}: "), F.coalesce(given, F.lit(-1)))
    return F.when(given.between(0, folds - 1), given).otherwise(F.raise_error(wrong).cast("int"))


def fold_of(id_col: str, folds: int, seed: int = 100) -> Column:
    """Fold number 0..folds-1 of a row, the same on every evaluation."""
    return F.pmod(_rank_key(id_col, seed + 1), F.lit(folds)).cast("int")
