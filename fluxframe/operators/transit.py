"""Phase folding and the parameters of a transit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import KEY, finite, guarded, where


def phase_of(time: Column, period: Column, t0: Column) -> Column:
    """In (-0.5, 0.5], 0 at t0."""
    p = F.pmod((time - t0) / period, F.lit(1.0))
    return F.when(p > 0.5, p - 1).otherwise(p)


def fold(lc: DataFrame, ephemeris: DataFrame) -> DataFrame:
    """lc with phase, by ephemeris(target_id, period, t0). Sort by target_id, phase, seq for a folded curve."""
    return lc.join(ephemeris.select(KEY, "period", "t0"), KEY).withColumn("phase", phase_of(F.col("time"), F.col("period"), F.col("t0")))


def binned_phase(folded: DataFrame, n_bins: int = 100) -> DataFrame:
    """(target_id, bin, center, median_flux): medians over equal bins of each curve's phases; empty bins and the greatest phase are left out."""
    span = folded.groupBy(KEY).agg(F.min("phase").alias("_lo"), F.max("phase").alias("_hi"))
    d = folded.join(span, KEY).withColumn("_w", (F.col("_hi") - F.col("_lo")) / n_bins).filter("_w > 0")
    d = d.withColumn("bin", F.floor((F.col("phase") - F.col("_lo")) / F.col("_w")).cast("int")).filter(F.col("bin") < n_bins)
    return d.groupBy(KEY, "bin").agg(F.first(F.col("_lo") + (F.col("bin") + 0.5) * F.col("_w")).alias("center"), F.median("flux").alias("median_flux"))


def _sided(wide: Column, wider: Column, least: int) -> Column:
    """wide unless fewer than least rows fit it, then wider; as a median's input chosen after counting."""
    return F.when(F.count_if(wide) < least, F.median(where(wider, "flux"))).otherwise(F.median(where(wide, "flux")))


def transit_parameters(folded: DataFrame) -> DataFrame:
    """(target_id, depth, duration_hours, snr, n_transits, baseline) of folded curves.

    The baseline is the median away from the transit, depth the way from there to the lowest point in it. duration is the
    width in phase of all points below half depth. snr has no factor for the number of points.
    """
    d = folded.filter(finite("flux") & finite("time"))
    a = F.abs("phase")
    inside = F.when(F.count_if(a < 0.05) < 3, F.min(where(a < 0.10, "flux"))).otherwise(F.min(where(a < 0.05, "flux")))
    base = d.groupBy(KEY).agg(
        F.first("period").alias("_p"), _sided(a > 0.15, a > 0.25, 10).alias("baseline"), inside.alias("_low"),
        (F.max("time") - F.min("time")).alias("_span"), F.median("flux").alias("_all"),
        F.median(where(a >= 0.05, "flux")).alias("_out"), F.median(where(a < 0.05, "flux")).alias("_in"), F.stddev_pop(where(a >= 0.05, "flux")).alias("_s"),
        F.count_if(a >= 0.05).alias("_n_out"), F.count_if(a < 0.05).alias("_n_in"),
    )
    base = base.withColumn("baseline", F.coalesce("baseline", "_all")).withColumn("depth", F.coalesce(F.col("baseline") - F.col("_low"), F.lit(0.0)))
    width = d.join(base.select(KEY, "baseline", "depth"), KEY).filter(F.col("flux") < F.col("baseline") - F.col("depth") / 2).groupBy(KEY).agg((F.max("phase") - F.min("phase")).alias("_width"))
    snr = F.when((F.col("_n_out") < 2) | (F.col("_n_in") < 1), 0.0).otherwise(guarded(F.abs(F.col("_out") - F.col("_in")), F.col("_s"), 0.0))
    out = base.join(width, KEY, "left")
    return out.select(
        KEY, "depth", (F.coalesce("_width", F.lit(0.0)) * F.col("_p") * 24).alias("duration_hours"), snr.alias("snr"),
        F.greatest(F.floor(F.col("_span") / F.col("_p")), F.lit(1)).cast("bigint").alias("n_transits"), "baseline",
    )


def compute_snr(folded: DataFrame) -> DataFrame:
    return transit_parameters(folded).select(KEY, "snr")
