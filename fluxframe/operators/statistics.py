"""Descriptive statistics of light curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import KEY, count_where, finite, over_finite
from .quality import gaps_of, noise_of, stepped

FIELDS = ("mean_flux", "median_flux", "std_flux", "variance_flux", "min_flux", "max_flux", "rms")


def flux_statistics(lc: DataFrame) -> DataFrame:
    """Moments and extremes of finite flux by target; deviations are of the population."""
    return lc.groupBy(KEY).agg(*_moments())


def _moments() -> list[Column]:
    f = over_finite("flux")
    return [
        F.avg(f).alias("mean_flux"), F.median(f).alias("median_flux"), F.stddev_pop(f).alias("std_flux"), F.var_pop(f).alias("variance_flux"),
        F.min(f).alias("min_flux"), F.max(f).alias("max_flux"), F.sqrt(F.avg(f * f)).alias("rms"), F.count(F.lit(1)).alias("n_samples"),
        count_where(~finite("flux")).alias("missing_value_count"), F.max(over_finite("time")).alias("_hi"), F.min(over_finite("time")).alias("_lo"), F.count(f).alias("_n"),
    ]


def light_curve_statistics(lc: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """The twelve statistics of every target; all 0 but the counts where no flux is finite. One exchange serves them all."""
    out = stepped(lc).groupBy(KEY).agg(*_moments(), noise_of().alias("noise"), gaps_of().alias("gap_count"))
    if targets is not None:
        out = targets.select(KEY).join(out, KEY, "left")
    some = F.coalesce(F.col("_n") > 0, F.lit(False))
    value = lambda c: F.when(some, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    return out.select(
        KEY, *(value(c).alias(c) for c in FIELDS), value(F.col("noise")).alias("estimated_noise"), F.coalesce("n_samples", F.lit(0)).alias("n_samples"),
        value(F.col("_hi") - F.col("_lo")).alias("observation_duration"), F.coalesce("missing_value_count", F.lit(0)).alias("missing_value_count"),
        F.when(some, F.col("gap_count")).otherwise(F.lit(0)).alias("gap_count"),
    )
