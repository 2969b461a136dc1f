"""Data-quality measures of light curves and the report built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import by_seq, by_target, by_time, INFINITY, KEY, MAD_TO_SIGMA, count_where, finite, over_finite, where

GAP_FACTOR = 10.0


def targets_of(lc: DataFrame) -> DataFrame:
    return lc.select(KEY).distinct()


def stepped(lc: DataFrame) -> DataFrame:
    """lc with _d, the step from the finite flux before in array order, _s, that from the finite time before in time order, and their typical sizes _m and _c.

    All windows are of the target alone, so they and any group by target share one exchange; what a caller does not use
    is pruned from the plan.
    """
    flux, time = over_finite("flux"), over_finite("time")
    before = lambda c, by: F.last(c, True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    d = lc.withColumns({"_d": flux - before(flux, by_seq()), "_s": time - before(time, by_time())})
    return d.withColumns({"_m": F.median("_d").over(by_target()), "_c": F.median(where(F.col("_s") > 0, "_s")).over(by_target())})


def noise_of() -> Column:
    """Over a group of stepped rows: the scaled median absolute deviation of steps; 0 for under two finite fluxes."""
    return F.coalesce(F.median(F.abs(F.col("_d") - F.col("_m"))) * (MAD_TO_SIGMA / 2**0.5), F.lit(0.0))


def cadence_of() -> Column:
    return F.coalesce(F.first("_c"), F.lit(0.0))


def gaps_of(factor: float = GAP_FACTOR) -> Column:
    return count_where((F.col("_c") > 0) & (F.col("_s") > factor * F.col("_c")))


def _for(targets: DataFrame | None, found: DataFrame, **default: float | int) -> DataFrame:
    """found, or a row for every target where they are given, with the defaults where it has none."""
    if targets is None:
        return found
    return targets.select(KEY).join(found, KEY, "left").fillna(default)


def noise_estimate(lc: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(target_id, noise): the scaled median absolute deviation of steps between finite fluxes in array order; 0 for under two."""
    return _for(targets, stepped(lc).groupBy(KEY).agg(noise_of().alias("noise")), noise=0.0)


def cadence_and_gaps(lc: DataFrame, targets: DataFrame | None = None, factor: float = GAP_FACTOR) -> DataFrame:
    """(target_id, median_cadence, gap_count, n_finite_times) over finite times in time order.

    The cadence is the median of positive spacings, 0 without one; a gap is a spacing above factor cadences.
    """
    found = stepped(lc).groupBy(KEY).agg(cadence_of().alias("median_cadence"), gaps_of(factor).alias("gap_count"), F.count(over_finite("time")).alias("n_finite_times"))
    return _for(targets, found, median_cadence=0.0, gap_count=0, n_finite_times=0)


def duplicate_timestamps(lc: DataFrame) -> DataFrame:
    """(target_id, n_duplicates): finite times beyond the first of each value."""
    return stepped(lc).groupBy(KEY).agg(count_where(F.col("_s") == 0).alias("n_duplicates"))


def missing_summary(lc: DataFrame) -> DataFrame:
    """(target_id, n_observations, missing_value_pct, n_infinite, n_negative)."""
    return lc.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_observations"), (100.0 * F.count_if(F.col("flux").isNull()) / F.count(F.lit(1))).alias("missing_value_pct"),
        count_where(F.abs("flux") == INFINITY).alias("n_infinite"), count_where(finite("flux") & (F.col("flux") < 0)).alias("n_negative"),
    )


def time_span(lc: DataFrame) -> DataFrame:
    t = over_finite("time")
    return lc.groupBy(KEY).agg(F.min(t).alias("time_start"), F.max(t).alias("time_end"), (F.max(t) - F.min(t)).alias("duration_days"))


def _text(pattern: str, *parts: Column) -> Column:
    return F.format_string(pattern, *parts)


def validation_report(lc: DataFrame, targets: DataFrame | None = None, mismatched: DataFrame | None = None) -> DataFrame:
    """One row per target: counts, time range, cadence, flux statistics, noise, ordered warnings, and is_valid.

    targets, if given, names targets that may have no rows; such a one has n_observations 0, 100 % missing, and is
    invalid. mismatched(target_id, n_time, n_flux) names curves whose vectors differ in length; they are invalid.
    """
    f, t = over_finite("flux"), over_finite("time")
    out = stepped(lc).groupBy(KEY).agg(
        F.first("mission").alias("mission"), F.count("flux").alias("_n_flux"), F.count(f).alias("_n_finite"), F.count(F.lit(1)).alias("n_observations"),
        (100.0 * F.count_if(F.col("flux").isNull()) / F.count(F.lit(1))).alias("missing_value_pct"), count_where(F.abs("flux") == INFINITY).alias("n_infinite"), count_where(f < 0).alias("n_negative"),
        F.min(t).alias("time_start"), F.max(t).alias("time_end"), (F.max(t) - F.min(t)).alias("duration_days"), F.count(t).alias("n_finite_times"), count_where(F.col("_s") == 0).alias("n_duplicates"),
        cadence_of().alias("median_cadence"), gaps_of().alias("gap_count"), noise_of().alias("noise"),
        F.struct(F.avg(f).alias("mean"), F.median(f).alias("median"), F.stddev_pop(f).alias("std"), F.min(f).alias("min"), F.max(f).alias("max")).alias("flux_stats"),
    )
    out = _for(targets, out, n_finite_times=0, median_cadence=0.0, gap_count=0, noise=0.0)
    if mismatched is not None:
        out = out.join(mismatched, KEY, "left")
    else:
        out = out.withColumns({"n_time": F.lit(None).cast("bigint"), "n_flux": F.lit(None).cast("bigint")})
    out = out.fillna(0, ["n_observations", "n_infinite", "n_negative", "n_duplicates", "_n_flux", "_n_finite"]).fillna(100.0, ["missing_value_pct"]).fillna(0.0, ["duration_days"])
    some = F.col("n_observations") > 0
    # fixed values: the texts of the warnings, in their order
    warnings = F.array(
        F.when(F.col("n_time").isNotNull(), _text("time and flux length mismatch: %d vs %d.", F.col("n_time"), F.col("n_flux"))),
        F.when(~some, "Light curve is empty."),
        F.when(some & (F.col("missing_value_pct") > 0), _text("%.2f%% of flux values are missing (NaN).", F.bround("missing_value_pct", 2))),
        F.when(some & (F.col("_n_flux") == 0), "All flux values are missing (NaN)."),
        F.when(F.col("n_infinite") > 0, _text("%d infinite flux value(s) found.", F.col("n_infinite"))),
        F.when(F.col("n_negative") > 0, _text("%d negative flux value(s) found (unexpected for raw, un-normalized flux).", F.col("n_negative"))),
        F.when(F.col("n_duplicates") > 0, _text("%d duplicate timestamp(s) found.", F.col("n_duplicates"))),
        F.when(some & (F.col("n_finite_times") == 0), "No finite timestamps available."),
        F.when(some & (F.col("n_finite_times") < 2), "Insufficient timestamps to estimate cadence."),
        F.when(F.col("gap_count") > 0, _text("%d large observation gap(s) (>10x median cadence) detected.", F.col("gap_count"))),
        F.when(some & (F.col("_n_finite") == 0), "No finite flux values available for statistics."),
    )
    valid = some & F.col("n_time").isNull() & (F.col("n_finite_times") > 0) & (F.col("_n_finite") > 0)
    return out.select(
        KEY, "mission", "n_observations", "time_start", "time_end", "duration_days", F.when(F.col("n_finite_times") > 0, F.col("median_cadence")).alias("median_cadence"), "missing_value_pct",
        "n_infinite", "n_negative", "n_duplicates", "gap_count", F.when(F.col("_n_finite") > 0, F.col("flux_stats")).alias("flux_stats"), "noise",
        F.filter(warnings, lambda x: x.isNotNull()).alias("warnings"), valid.alias("is_valid"),
    )


def summary_line(report: DataFrame) -> DataFrame:
    """(target_id, summary): a line for people."""
    line = _text("[%s] %s (%s): %d pts, %.2f d span, %.2f%% missing, %d warning(s)", F.when(F.col("is_valid"), "OK").otherwise("INVALID"), F.col(KEY), F.coalesce("mission", F.lit("unknown")), F.col("n_observations"), F.bround("duration_days", 2), F.bround("missing_value_pct", 2), F.size("warnings"))
    return report.select(KEY, line.alias("summary"))
