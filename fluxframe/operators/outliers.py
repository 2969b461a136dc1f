"""Rejection of outliers. Statistics are taken over rows whose time and flux are finite; other rows are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import by_target, KEY, MAD_SCORE, finite

METHODS = ("sigma_clip", "mad", "percentile")


def _check(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; choose one of {', '.join(METHODS)}")


def finite_rows(lc: DataFrame) -> DataFrame:
    return lc.filter(finite("time") & finite("flux"))


def flag_outliers(lc: DataFrame, method: str = "sigma_clip", sigma_threshold: float = 5.0, mad_threshold: float = 3.5, percentile_lower: float = 0.5, percentile_upper: float = 99.5) -> DataFrame:
    """The finite rows of lc with a boolean keep. A curve without spread keeps all of them."""
    _check(method)
    f, over = F.col("flux"), by_target()
    d = finite_rows(lc)
    if method == "percentile":
        d = d.withColumn("_q", F.percentile(f, F.array(F.lit(percentile_lower / 100), F.lit(percentile_upper / 100))).over(over))
        return d.withColumn("keep", f.between(F.col("_q")[0], F.col("_q")[1])).drop("_q")
    d = d.withColumn("_m", F.median(f).over(over))
    if method == "sigma_clip":
        d = d.withColumn("_s", F.stddev_pop(f).over(over))
        test: Column = F.abs(f - F.col("_m")) <= sigma_threshold * F.col("_s")
    else:
        d = d.withColumn("_s", F.median(F.abs(f - F.col("_m"))).over(over))
        test = F.abs(MAD_SCORE * (f - F.col("_m"))) <= mad_threshold * F.col("_s")
    return d.withColumn("keep", (F.col("_s") == 0) | test).drop("_m", "_s")


def remove_outliers(lc: DataFrame, method: str = "sigma_clip", **limits: float) -> DataFrame:
    return flag_outliers(lc, method, **limits).filter("keep").drop("keep")


def outlier_stats(before: DataFrame, after: DataFrame, method: str) -> DataFrame:
    """(target_id, method, n_input, n_removed, pct_removed); rows that were not finite count as removed."""
    count = lambda df, name: df.groupBy(KEY).agg(F.count(F.lit(1)).alias(name))
    both = count(before, "n_input").join(count(after, "_kept"), KEY, "left")
    gone = F.col("n_input") - F.coalesce("_kept", F.lit(0))
    return both.select(KEY, F.lit(method).alias("method"), "n_input", gone.alias("n_removed"), (100.0 * gone / F.col("n_input")).alias("pct_removed"))


def clip_strict(lc: DataFrame, sigma: float = 5.0) -> DataFrame:
    """The older clip: strictly inside sigma deviations of the median, so a curve without spread loses every row."""
    d = finite_rows(lc).withColumns({"_m": F.median("flux").over(by_target()), "_s": F.stddev_pop("flux").over(by_target())})
    return d.filter(F.abs(F.col("flux") - F.col("_m")) < sigma * F.col("_s")).drop("_m", "_s")
