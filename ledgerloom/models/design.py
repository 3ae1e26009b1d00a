"""Design matrices."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.base import Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.columns import complete_cases
from ledgerloom.operators.filters import where_in


@dataclass(frozen=True)
class Design:
    """A frame with ``features`` and ``label``, and what its slots mean.

    ``names`` are the slot names, ``terms`` maps each term to its slots, so a
    factor can be added or dropped as a whole, and ``levels`` holds the known
    levels of each factor. ``encoder`` codes other rows the same way.
    """

    frame: DataFrame
    names: list[str]
    terms: dict[str, list[int]]
    levels: dict[str, list[str]]
    encoder: Transformer
    label: str
    intercept: bool = True

    def columns(self) -> dict[str, Column]:
        """Each slot as an expression over the uncoded columns."""
        out = {}
        for term, slots in self.terms.items():
            for slot in slots:
                name = self.names[slot]
                col = F.col(f"`{term}`")
                if term in self.levels:
                    col = col == name.removeprefix(f"{term}_")
                out[name] = col.cast("double")
        return out

    def usable(self, df: DataFrame) -> DataFrame:
        """Rows the encoder would keep: no null input, no unknown level."""
        rows = complete_cases(df, list(self.terms))
        for term, levels in self.levels.items():
            rows = where_in(rows, term, levels)
        return rows

    def encode(self, df: DataFrame) -> DataFrame:
        return self.encoder.transform(df)

    @property
    def dense(self) -> list[int]:
        """The slots of terms that are no factors."""
        return [s for t, slots in self.terms.items() if t not in self.levels for s in slots]

    def rows(self, df: DataFrame | None = None, *keep: str | Column) -> DataFrame:
        """``x`` (the numbers, in the order of ``dense``), ``slots`` (of each factor the
        slot that is set, if any), ``y`` and any further columns to keep. A factor
        costs a row one whole number, however many levels it has."""
        coded = self.frame if df is None else self.encode(df)
        numbers = [F.col(f"`{t}`").cast("double") for t in self.terms if t not in self.levels]
        set_slots = []
        for term in self.levels:
            own, index = self.terms[term], F.col(f"`{term}_index`").cast("int")
            if own:
                set_slots.append(F.when(index < len(own), index + own[0]))
        empty = F.array().cast("array<int>")
        return coded.select(
            (F.array(*numbers) if numbers else F.array().cast("array<double>")).alias("x"),
            (F.array_compact(F.array(*set_slots)) if set_slots else empty).alias("slots"),
            F.col(self.label).cast("double").alias("y"),
            *keep,
        )

    def matrix(self, df: DataFrame | None = None, *keep: str) -> DataFrame:
        """``x`` (array of slots), ``y`` and any further columns to keep."""
        rows = self.frame if df is None else self.encode(df)
        return rows.select(
            vector_to_array("features").alias("x"), F.col(self.label).cast("double").alias("y"), *keep
        )


def design(
    df: DataFrame,
    label: str,
    terms: Sequence[str],
    intercept: bool = True,
    max_levels: int = 10_000,
) -> Design:
    """Treatment coding of the terms, in their order.

    Text columns are factors that drop their alphabetically first level. Without
    an intercept the first factor keeps all its levels. Rows with a null in any
    input are left out; so are rows with an unknown level when encoding.

    Only the factor levels have to be learned, and one pass finds those of all
    factors together. They live on the driver, so a factor that has more than
    ``max_levels`` is refused (``wide_design`` takes it): no more levels than that are
    gathered for each.
    """
    inputs = complete_cases(df, [label, *terms])
    kinds = dict(df.dtypes)
    factors = [t for t in terms if kinds[t] == "string"]
    known = _levels(inputs, factors, max_levels)
    whole = [] if intercept else factors[:1]
    stages: list = []
    for f in factors:
        stages.append(StringIndexerModel.from_labels(known[f], f, f"{f}_index", "skip"))
    for group, drop in ((whole, False), ([f for f in factors if f not in whole], True)):
        if group:
            stages.append(
                OneHotEncoder(
                    inputCols=[f"{f}_index" for f in group],
                    outputCols=[f"{f}_slots" for f in group],
                    dropLast=drop,
                )
            )
    stages.append(
        VectorAssembler(
            inputCols=[f"{t}_slots" if t in factors else t for t in terms],
            outputCol="features",
            handleInvalid="skip",
        )
    )
    encoder = Pipeline(stages=stages).fit(inputs)
    levels = known
    names: list[str] = []
    slots: dict[str, list[int]] = {}
    for term in terms:
        own = [term]
        if term in factors:
            kept = levels[term] if term in whole else levels[term][:-1]
            own = [f"{term}_{level}" for level in kept]
        slots[term] = list(range(len(names), len(names) + len(own)))
        names += own
    frame = encoder.transform(inputs).withColumn("label", F.col(label).cast("double"))
    return Design(frame, names, slots, levels, encoder, label, intercept)


def _levels(inputs: DataFrame, factors: Sequence[str], max_levels: int) -> dict[str, list[str]]:
    """The levels of each factor, the alphabetically last first, from one aggregate."""
    if not factors:
        return {}
    pairs = [F.struct(F.lit(k).alias("k"), F.col(f"`{f}`").alias("v")) for k, f in enumerate(factors)]
    distinct = inputs.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").distinct()
    found: dict[str, list[str]] = {f: [] for f in factors}
    for row in distinct.limit(max_levels * len(factors) + 1).collect():
        found[factors[row.k]].append(row.v)
    wide = {f: len(own) for f, own in found.items() if len(own) > max_levels}
    if wide:
        raise ValueError(f"more than {max_levels} levels: {wide}")
    # as the engine compares text
    return {f: sorted(own, key=lambda v: v.encode("utf-8"), reverse=True) for f, own in found.items()}


def assemble(df: DataFrame, label: str, cols: Sequence[str], intercept: bool = True) -> Design:
    """Numeric columns as they are."""
    inputs = complete_cases(df, [label, *cols])
    encoder = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="skip")
    labelled = inputs.withColumn("label", F.col(label).cast("double"))
    return Design(
        encoder.transform(labelled), list(cols), {c: [i] for i, c in enumerate(cols)}, {}, encoder,
        label, intercept,
    )

