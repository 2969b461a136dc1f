"""Normalization of flux by target, its fitted parameters, and the way back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import by_target, KEY, guarded, over_finite

METHODS = ("minmax", "zscore", "median", "robust")
TINY = 1e-15
#: Aggregates of finite flux that a method needs, as SQL over a column x.
_FITS = {
    "minmax": {"min": "min(x)", "max": "max(x)"},
    "zscore": {"mean": "avg(x)", "std": "stddev_pop(x)"},
    "median": {"median": "median(x)"},
    "robust": {"median": "median(x)", "q1": "percentile(x, 0.25)", "q3": "percentile(x, 0.75)"},
}


def _check(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; choose one of {', '.join(METHODS)}")


def _fitted(lc: DataFrame, method: str) -> DataFrame:
    d = lc.withColumn("x", over_finite("flux"))
    return d.withColumns({f"_{k}": F.expr(e).over(by_target()) for k, e in _FITS[method].items()}).drop("x")


def normalize(lc: DataFrame, method: str = "median") -> DataFrame:
    """lc with flux normalized. Without spread, minmax and median leave it, zscore and robust only centre it."""
    _check(method)
    d, f = _fitted(lc, method), F.col("flux")
    if method == "minmax":
        new = guarded(f - F.col("_min"), F.col("_max") - F.col("_min"), f)
    elif method == "zscore":
        new = guarded(f - F.col("_mean"), F.col("_std"), f - F.col("_mean"))
    elif method == "median":
        new = F.when(F.abs("_median") < TINY, f).otherwise(f / F.when(F.abs("_median") >= TINY, F.col("_median")) - 1)
    else:
        new = guarded(f - F.col("_median"), F.col("_q3") - F.col("_q1"), f - F.col("_median"))
    return d.withColumn("flux", new).select(*lc.columns)


def normalization_params(lc: DataFrame, method: str = "median") -> DataFrame:
    """(target_id, method, the method's parameters): what an inverse needs."""
    _check(method)
    out = lc.withColumn("x", over_finite("flux")).groupBy(KEY).agg(*(F.expr(e).alias(k) for k, e in _FITS[method].items()))
    if method == "robust":
        out = out.withColumn("iqr", F.col("q3") - F.col("q1"))
    return out.select(KEY, F.lit(method).alias("method"), *out.columns[1:])


def denormalize(lc: DataFrame, params: DataFrame, method: str) -> DataFrame:
    """The inverse of normalize, by the parameters that it was fitted with."""
    _check(method)
    d, f = lc.join(params.drop("method"), KEY), F.col("flux")
    old = {
        "minmax": lambda: F.when(F.col("max") == F.col("min"), f).otherwise(f * (F.col("max") - F.col("min")) + F.col("min")),
        "zscore": lambda: F.when(F.col("std") == 0, f).otherwise(f * F.col("std")) + F.col("mean"),
        "median": lambda: F.when(F.abs("median") < TINY, f).otherwise((f + 1) * F.col("median")),
        "robust": lambda: F.when(F.col("iqr") == 0, f).otherwise(f * F.col("iqr")) + F.col("median"),
    }[method]()
    return d.withColumn("flux", old).select(*lc.columns)
