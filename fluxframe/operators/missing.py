"""Filling of missing flux. NULL is missing; infinite values are valid here and go in the outlier stage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import backward, by_seq, by_target, by_time, KEY

STRATEGIES = ("linear", "cubic", "nearest", "ffill", "bfill")


def _check(strategy: str) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; choose one of {', '.join(STRATEGIES)}")


def _before(c: Column, by) -> Column:
    return F.last(c, True).over(by.rowsBetween(Window.unboundedPreceding, 0))


def _after(c: Column, *order: str) -> Column:
    return F.last(c, True).over(backward(*order).rowsBetween(Window.unboundedPreceding, 0))


def fill_missing(lc: DataFrame, strategy: str = "linear") -> DataFrame:
    """lc with flux filled. Curves without a valid value stay as they are; with one, every strategy repeats it.

    linear and nearest look in time order at the valid neighbours; before the first and after the last valid sample they
    take the first and last valid flux in array order. ffill and bfill look in array order and fill what is left over from
    the other side. cubic is a spline with not-a-knot ends through four valid samples or more, else linear.
    """
    _check(strategy)
    flux, missing = F.col("flux"), F.col("flux").isNull()
    if strategy == "ffill":
        return lc.withColumn("flux", F.coalesce(_before(flux, by_seq()), _after(flux, "seq")))
    if strategy == "bfill":
        return lc.withColumn("flux", F.coalesce(_after(flux, "seq"), _before(flux, by_seq())))
    if strategy == "cubic":
        return _fill_cubic(lc)
    point = F.when(~missing, F.struct(F.col("time").alias("t"), flux.alias("f")))
    d = lc.withColumns({"_p": _before(point, by_time()), "_n": _after(point, "time", "seq"), "_first": F.first(flux, True).over(by_seq().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_last": F.last(flux, True).over(by_seq().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_v": F.count("flux").over(by_target())})
    return d.withColumn("flux", between(strategy, F.col("_p"), F.col("_n"))).drop("_p", "_n", "_first", "_last", "_v")


def between(strategy: str, p: Column, n: Column) -> Column:
    """flux filled by linear or nearest from the valid points p before and n after, of a curve with _v valid values, _first and _last in array order."""
    flux, t = F.col("flux"), F.col("time")
    span = n["t"] - p["t"]
    if strategy == "linear":
        inside = F.when(span == 0, p["f"]).otherwise(p["f"] + (n["f"] - p["f"]) * (t - p["t"]) / F.when(span != 0, span))
    else:
        inside = F.when(t - p["t"] <= n["t"] - t, p["f"]).otherwise(n["f"])
    value = F.when(F.col("_v") == 0, F.lit(None)).when(p.isNull(), F.col("_first")).when(n.isNull(), F.col("_last")).otherwise(inside)
    return F.when(flux.isNull() & t.isNotNull(), value).otherwise(flux)


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A cubic spline with not-a-knot ends through (x, y), x strictly increasing with four points or more.

    The second derivatives solve a tridiagonal system: the third derivative goes on through the second and the last but one
    knot, which gives the outermost two from the others, so memory and time grow with the points.
    """
    n = len(x)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    low, mid, up, rhs = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(slope)
    # m[0] = (1 + a) m[1] - a m[2] with a = h[0] / h[1], and alike at the other end
    a, z = h[0] / h[1], h[-1] / h[-2]
    mid[0] += h[0] * (1 + a)
    up[0] -= h[0] * a
    mid[-1] += h[-1] * (1 + z)
    low[-1] -= h[-1] * z
    inner = _tridiagonal(low, mid, up, rhs)
    m = np.concatenate(([(1 + a) * inner[0] - a * inner[1]], inner, [(1 + z) * inner[-1] - z * inner[-2]]))
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    left, right = at - x[k], x[k + 1] - at
    return (m[k] * right**3 + m[k + 1] * left**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * right + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * left


def _tridiagonal(low: np.ndarray, mid: np.ndarray, up: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """The solution of low[i] u[i-1] + mid[i] u[i] + up[i] u[i+1] = rhs[i], by cyclic reduction: every round halves the unknowns with whole-array steps."""
    n = len(mid)
    if n == 1:
        return rhs / mid
    low, up = low.copy(), up.copy()
    low[0] = up[-1] = 0
    odd = np.arange(1, n, 2)
    last = odd + 1 < n  # an odd place that has a right-hand neighbour
    f = low[odd] / mid[odd - 1]
    g = np.zeros(len(odd))
    g[last] = up[odd[last]] / mid[odd[last] + 1]
    right = np.minimum(odd + 1, n - 1)
    u = _tridiagonal(-f * low[odd - 1], mid[odd] - f * up[odd - 1] - g * low[right] * last, -g * up[right] * last, rhs[odd] - f * rhs[odd - 1] - g * rhs[right] * last)
    out = np.empty(n)
    out[odd] = u
    even = np.arange(0, n, 2)
    before, after = np.where(even > 0, out[np.maximum(even - 1, 0)], 0) if n > 1 else 0, np.zeros(len(even))
    has = even + 1 < n
    after[has] = out[even[has] + 1]
    out[even] = (rhs[even] - low[even] * before - up[even] * after) / mid[even]
    return out


def _fill_cubic(lc: DataFrame) -> DataFrame:
    """Curves that miss a value and have four valid ones go to NumPy, the others stay in the plan."""
    t = F.when(F.col("flux").isNotNull(), F.col("time"))
    d = lc.withColumn("_c", (F.count("flux").over(by_target()) >= 4) & (F.count(F.lit(1)).over(by_target()) > F.count("flux").over(by_target())) & (F.size(F.collect_set(t).over(by_target())) == F.count("flux").over(by_target())))
    schema = lc.schema

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        flux, time = pdf["flux"].to_numpy(float), pdf["time"].to_numpy(float)
        have = ~np.isnan(flux)
        gap = ~have & ~np.isnan(time)
        order = np.argsort(time[have], kind="stable")
        x, y = time[have][order], flux[have][order]
        value = cubic_spline(x, y, time[gap])
        ends = np.flatnonzero(have)
        value = np.where(time[gap] < x[0], flux[ends[0]], np.where(time[gap] > x[-1], flux[ends[-1]], value))
        flux = flux.copy()
        flux[gap] = value
        return pdf.assign(flux=flux)

    plain = fill_missing(d.filter(~F.col("_c")).drop("_c"), "linear")
    spline = d.filter("_c").drop("_c").groupBy(KEY).applyInPandas(one, schema).withColumn("flux", F.nanvl("flux", F.lit(None).cast("double")))
    return plain.unionByName(spline)


def fill_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(target_id, n_missing, n_filled)."""
    count = lambda df, name: df.groupBy(KEY).agg(F.count_if(F.col("flux").isNull()).alias(name))
    both = count(before, "n_missing").join(count(after, "_left"), KEY)
    return both.select(KEY, "n_missing", (F.col("n_missing") - F.col("_left")).alias("n_filled"))
