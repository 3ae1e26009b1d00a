"""Binary-outcome models: splits, fits, selection, penalties and scores.

Single fits use ``pyspark.ml``. Searches that would need hundreds of fits
(stepwise selection, penalty paths with cross-validation) share one pass over
the data between all their candidates, see ``ledgerloom.models.passes``.
"""
