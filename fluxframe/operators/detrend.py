"""Trends of light curves and their removal."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import by_seq, by_target, KEY, finite, over_finite, ratio

METHODS = ("polynomial", "savgol", "running_median")
FLAT = 1e-10


def _polynomial_trend(lc: DataFrame, degree: int) -> DataFrame:
    """trend: a least-squares polynomial over the sample index; a constant where finite samples are too few for it.

    Orthogonal polynomials by Forsythe's recurrence, from window sums of the curve, so every degree stays in the plan and
    nothing is shuffled again.
    """
    own, fin, y = by_target(), finite("flux"), over_finite("flux")
    total = lambda c: F.sum(F.when(fin, c)).over(own)
    d = lc.withColumns({"_x": F.col("seq") / F.greatest(F.max("seq").over(own), F.lit(1)), "_n": F.count(y).over(own), "_m": F.median(y).over(own), "_p0": F.lit(1.0)})
    trend = F.lit(0.0)
    for k in range(degree + 1):
        p = F.col(f"_p{k}")
        d = d.withColumns({f"_q{k}": total(p * p), f"_y{k}": total(y * p), f"_a{k}": total(F.col("_x") * p * p)})
        trend = trend + F.try_divide(f"_y{k}", f"_q{k}") * p
        if k < degree:
            back = F.try_divide(f"_q{k}", f"_q{k - 1}") * F.col(f"_p{k - 1}") if k else F.lit(0.0)
            d = d.withColumn(f"_p{k + 1}", (F.col("_x") - F.try_divide(f"_a{k}", f"_q{k}")) * p - back)
    return d.withColumn("trend", F.when(F.col("_n") > degree, trend).otherwise(F.coalesce("_m", F.lit(1.0)))).select(*lc.columns, "trend")


def savgol_window(n: int, window: int, polyorder: int) -> int:
    """The window length that is used for n samples: odd, at most n, above polyorder. Fixed rules: results depend on them."""
    window += window % 2 == 0
    if window > n:
        window = n if n % 2 else n - 1
    if window <= polyorder:
        window = polyorder + 1 + (polyorder % 2 == 0)
    return window


@functools.lru_cache(16)
def savgol_weights(window: int, polyorder: int) -> np.ndarray:
    """Row i: the weights of a window's samples in the value fitted at place i."""
    x = np.arange(window) - (window - 1) / 2
    basis = np.vander(x / max(window // 2, 1), min(polyorder, window - 1) + 1, increasing=True)
    return basis @ np.linalg.pinv(basis)


def savgol_trend(flux: np.ndarray, window: int, polyorder: int) -> np.ndarray:
    """Smoothing by local least squares; the ends take the polynomials of the first and last window."""
    n = len(flux)
    filled = np.where(np.isfinite(flux), flux, np.median(flux[np.isfinite(flux)]) if np.isfinite(flux).any() else 1.0)
    return smoothed(filled, n, window, polyorder, True, True)


def smoothed(filled: np.ndarray, n: int, window: int, polyorder: int, from_start: bool, to_end: bool) -> np.ndarray:
    """The trend of filled, a run of a curve of n samples. Where the run begins or ends amid the curve, its outermost half window is not to be used."""
    window = savgol_window(n, window, polyorder)
    if window > n or window < 1:
        return np.full(n, np.median(filled) if n else 1.0)
    half, hat = window // 2, savgol_weights(window, polyorder)
    out = np.convolve(filled, hat[half][::-1], "same") if window > 1 else filled.copy()
    if from_start:
        out[:half] = (hat @ filled[:window])[:half]
    if to_end and window - half - 1:
        out[len(filled) - (window - half - 1) :] = (hat @ filled[len(filled) - window :])[half + 1 :]
    return out


def _per_curve(lc: DataFrame, trend) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        return pdf.assign(trend=trend(pdf["flux"].to_numpy(float)))

    return lc.groupBy(KEY).applyInPandas(one, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in lc.schema.fields)}, trend double")


def running_median_trend(lc: DataFrame, window: int) -> DataFrame:
    """trend: the median of window samples about each; beyond the ends the first and last sample repeat, missing ones are the curve's median.

    Copies of the end samples are added as rows and dropped again, so the frame is an ordinary one and stays in the plan.
    """
    d = lc.withColumns({"_n": F.count(F.lit(1)).over(by_target()), "_m": F.median(over_finite("flux")).over(by_target()), "_k": F.row_number().over(by_seq())})
    return median_frames(d, window, KEY).select(*lc.columns, "trend")


def median_frames(d: DataFrame, window: int, *keys: str) -> DataFrame:
    """d with its trend, from frames within keys; d has each row's number _k from 1 on, and its curve's rows _n and median _m."""
    kept = d.columns
    d = d.withColumn("_f", F.when(finite("flux"), F.col("flux")).otherwise(F.coalesce("_m", F.lit(1.0))))
    half = max(window, 1) // 2
    # a window above n is cut to n; an even one grows by one
    size = F.least(F.greatest(F.lit(window), F.lit(1)), F.col("_n").cast("int"))
    d = d.withColumn("_h", ((size + F.when(size % 2 == 0, 1).otherwise(0)) / 2).cast("int"))
    before = F.when(F.col("_k") == 1, F.col("_h")).otherwise(0)
    after = F.when(F.col("_k") == F.col("_n"), F.col("_h")).otherwise(0)
    d = d.withColumn("_r", F.explode(F.sequence(-before, after)))
    by = Window.partitionBy(*keys).orderBy("_k", "_r")
    near = F.collect_list("_f").over(by.rowsBetween(-half - 1, half + 1))
    at = F.row_number().over(by)
    d = d.withColumns({"_at": at, "_near": near})
    first = F.greatest(F.col("_at") - (half + 1), F.lit(1))
    d = d.filter("_r = 0").withColumn("_near", F.slice("_near", F.greatest(F.col("_at") - F.col("_h") - first + 1, F.lit(1)).cast("int"), 2 * F.col("_h") + 1))
    # get, as a filter on the trend may be tried on the copies too, whose frames are cut off
    return d.withColumn("trend", F.get(F.array_sort("_near"), F.col("_h"))).select(*kept, "trend")


def add_trend(lc: DataFrame, method: str = "savgol", polynomial_degree: int = 3, savgol_window: int = 401, savgol_polyorder: int = 3, running_median_window: int = 101) -> DataFrame:
    """lc with a column trend. Rows must be numbered 0, 1, ... in seq."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; choose one of {', '.join(METHODS)}")
    if method == "running_median":
        return running_median_trend(lc, running_median_window)
    if method == "savgol":
        return _per_curve(lc, lambda f: savgol_trend(f, savgol_window, savgol_polyorder))
    return _polynomial_trend(lc, polynomial_degree)


def detrend(lc: DataFrame, method: str = "savgol", mode: str = "divide", **settings: int) -> DataFrame:
    """lc with flux divided by its trend, by 1 where that is nearly 0; mode="subtract" takes the trend away instead.

    Dividing flux that was centred on 0 before blows it up where the trend crosses 0; subtracting is the safe choice then.
    mode="ratio" divides as IEEE 754 does: where the trend is 0, flux is infinite, or NaN if it was 0 too.
    """
    d = add_trend(lc, method, **settings)
    if mode == "ratio":
        return d.withColumn("flux", ratio(F.col("flux"), F.col("trend"))).select(*lc.columns)
    safe = F.when(F.abs("trend") < FLAT, F.lit(1.0)).otherwise(F.col("trend"))
    new = F.col("flux") / safe if mode == "divide" else F.col("flux") - F.col("trend")
    return d.withColumn("flux", F.nanvl(new, F.lit(None).cast("double"))).select(*lc.columns)


def flatten(lc: DataFrame, window: int = 401) -> DataFrame:
    """The older way: division by a smoothed curve of order 3."""
    return detrend(lc, "savgol", savgol_window=window, savgol_polyorder=3)
