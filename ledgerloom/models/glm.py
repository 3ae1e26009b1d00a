"""Logistic regression by maximum likelihood, with its tests."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.regression import (
    GeneralizedLinearRegression,
    GeneralizedLinearRegressionModel,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.models.design import Design
from ledgerloom.sources.frames import rows_to_df
from ledgerloom.storage import held

COEFFICIENT_ROWS = (
    "term string, estimate double, std_error double, z_value double, p_value double"
)


@dataclass(frozen=True)
class LogisticFit:
    """A fitted model, its slot names and the figures its tests need."""

    model: GeneralizedLinearRegressionModel
    names: list[str]
    null_deviance: float
    deviance: float
    aic: float
    n: int

    @property
    def rank(self) -> int:
        return self.model.summary.rank

    @property
    def bic(self) -> float:
        return self.deviance + math.log(self.n) * self.rank

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """``(term, estimate, std_error, z_value, p_value)``."""
        s, m = self.model.summary, self.model
        estimates = [float(v) for v in m.coefficients]
        terms = list(self.names)
        if m.getFitIntercept():
            estimates.append(float(m.intercept))
            terms.append("(Intercept)")
        rows = zip(terms, estimates, s.coefficientStandardErrors, s.tValues, s.pValues)
        return rows_to_df(spark, [tuple(r) for r in rows], COEFFICIENT_ROWS)


def fit_logistic(
    d: Design, intercept: bool | None = None, max_iter: int = 50
) -> LogisticFit:
    """Fit on a design; ``intercept`` overrides the design's own choice, for a
    matrix that already holds a constant column.

    A fit that has not settled within ``max_iter`` steps is an error: its
    estimates, errors and p-values would be those of an unfinished fit, as on
    rows that the predictors separate perfectly.
    """
    glr = GeneralizedLinearRegression(
        family="binomial",
        link="logit",
        featuresCol="features",
        labelCol="label",
        fitIntercept=d.intercept if intercept is None else intercept,
        tol=1e-10,
        maxIter=max_iter,
    )
    # every iteration reads the matrix once
    with held(d.frame.select("features", "label")) as matrix:
        model = glr.fit(matrix)
        s = model.summary
        if s.numIterations >= max_iter:
            raise RuntimeError(f"the logistic fit did not settle in {max_iter} steps")
        return LogisticFit(
            model, d.names, s.nullDeviance, s.deviance, s.aic, s.numInstances
        )


def deviance_table(spark: SparkSession, fit: LogisticFit) -> DataFrame:
    """Null and residual deviance with their degrees of freedom."""
    shift = 1 if fit.model.getFitIntercept() else 0
    return rows_to_df(
        spark,
        [
            ("null", fit.null_deviance, fit.n - shift),
            ("residual", fit.deviance, fit.n - fit.rank),
        ],
        "model string, deviance double, df bigint",
    )


def odds_ratios(coefs: DataFrame) -> DataFrame:
    return coefs.select(
        "term", F.exp("estimate").alias("odds_ratio"),
        (100 * (F.exp("estimate") - 1)).alias("percent_change"),
    )


def significant(coefs: DataFrame, alpha: float = 0.01) -> DataFrame:
    return coefs.where(F.col("p_value") < alpha)


def information_criteria(spark: SparkSession, fits: dict[str, LogisticFit]) -> DataFrame:
    """Rank, deviance, AIC and BIC of named fits."""
    return rows_to_df(
        spark,
        [(name, f.rank, f.deviance, f.aic, f.bic) for name, f in fits.items()],
        "model string, n_coefficients int, deviance double, aic double, bic double",
    )


def likelihood_ratio(
    spark: SparkSession,
    small: tuple[float, int],
    full: tuple[float, int],
) -> DataFrame:
    """Nested models given as (deviance, number of coefficients)."""
    statistic, df = max(small[0] - full[0], 0.0), full[1] - small[1]
    return rows_to_df(
        spark,
        [(statistic, df, chi_square_tail(statistic, df))],
        "statistic double, df int, p_value double",
    )


def chi_square_tail(x: float, df: int) -> float:
    """P(chi-square with ``df`` degrees > x), by its finite sum for whole df."""
    if df < 1:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        term = out = math.exp(-half)
        for i in range(1, df // 2):
            term *= half / i
            out += term
        return out
    out = math.erfc(math.sqrt(half))
    term = math.sqrt(2 * x / math.pi) * math.exp(-half)
    for i in range(1, (df - 1) // 2 + 1):
        out += term
        term *= x / (2 * i + 1)
    return out
