"""Probabilities and classes per row and model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.ml.base import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.labels import classify
from ledgerloom.models.design import Design
from ledgerloom.operators.ordering import last_rows


def linear_score(coefs: Mapping[str, float], columns: Mapping[str, Column]) -> Column:
    """Intercept plus coefficient times column, as one expression."""
    parts = [F.lit(float(coefs.get("(Intercept)", 0.0)))]
    parts += [F.lit(float(v)) * columns[t] for t, v in coefs.items() if t != "(Intercept)"]
    return reduce(add, parts)


def probability(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


def score_columns(d: Design, models: Mapping[str, Mapping[str, float]]) -> list[Column]:
    """One probability expression per model given as named coefficients, over
    the uncoded columns: no encoding step, no Python, one projection."""
    cols = d.columns()
    return [probability(linear_score(c, cols)).alias(m) for m, c in models.items()]


def score_coefficients(
    df: DataFrame, d: Design, models: Mapping[str, Mapping[str, float]], *keep: str
) -> DataFrame:
    """``keep`` columns, the outcome ``y`` and one probability per model."""
    return d.usable(df).select(
        *keep, F.col(d.label).cast("double").alias("y"), *score_columns(d, models)
    )


def score_fitted(
    df: DataFrame, d: Design, models: Mapping[str, Transformer], *keep: str
) -> DataFrame:
    """One probability column per fitted model: the prediction of a regression,
    the second class probability of a classifier. One scan scores them all."""
    rows = d.encode(df)
    for name, model in models.items():
        if model.hasParam("probabilityCol"):
            scored = model.transform(rows)
            p = vector_to_array(model.getProbabilityCol())[1]
        else:
            scored = model.transform(rows)
            p = F.col(model.getPredictionCol())
        extra = [c for c in scored.columns if c not in rows.columns]
        rows = scored.withColumn(name, p).drop(*[c for c in extra if c != name])
    return rows.select(*keep, F.col(d.label).cast("double").alias("y"), *models)


def long_scores(scores: DataFrame, models: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Wide probabilities as ``(ids, model, p)`` rows."""
    return scores.unpivot(list(ids), list(models), "model", "p")


def classify_models(
    scores: DataFrame, models: Sequence[str], threshold: float = 0.3
) -> DataFrame:
    """Probability columns replaced by 0/1 classes."""
    return scores.withColumns({m: classify(F.col(m), threshold) for m in models})


def last_classes(
    scores: DataFrame, models: Sequence[str], order: Sequence[str], n: int = 10, threshold: float = 0.3
) -> DataFrame:
    """Classes of the last ``n`` rows, one column per model."""
    return classify_models(last_rows(scores, n, order), models, threshold)
