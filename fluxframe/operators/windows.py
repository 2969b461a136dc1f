"""Overlapping windows of fixed length. A sample goes to its few windows as a row, so no task needs a whole curve in memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import by_target, KEY

PADDING = ("edge", "constant", "reflect", "symmetric", "wrap", "mean", "median", "minimum", "maximum")


def stride_of(window_size: int, overlap: float) -> int:
    """The step between windows; halves are rounded to even."""
    if window_size <= 0:
        raise ValueError("window_size must be positive")
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be at least 0 and below 1")
    return max(int(round(window_size * (1 - overlap))), 1)


def pad_array(a: Column, pad: Column, mode: str) -> Column:
    """The array a with pad more elements at its end."""
    n = F.size(a)
    if mode in ("mean", "median", "minimum", "maximum"):
        total = F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
        s = F.array_sort(a)
        half = {"mean": total / n, "minimum": F.array_min(a), "maximum": F.array_max(a), "median": (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2}[mode]
        return F.concat(a, F.array_repeat(half, pad))
    if mode == "edge":
        return F.concat(a, F.array_repeat(F.element_at(a, -1), pad))
    if mode == "constant":
        return F.concat(a, F.array_repeat(F.lit(0.0), pad))
    i = lambda k: n + k
    if mode == "wrap":
        at = lambda k: F.pmod(i(k), n)
    elif mode == "symmetric":
        at = lambda k: F.least(F.pmod(i(k), 2 * n), 2 * n - 1 - F.pmod(i(k), 2 * n))
    else:
        turn = F.greatest(2 * n - 2, F.lit(1))
        at = lambda k: F.least(F.pmod(i(k), turn), turn - F.pmod(i(k), turn))
    more = F.when(pad > 0, F.transform(F.sequence(F.lit(0), F.greatest(pad, F.lit(1)) - 1), lambda k: F.get(a, F.when(n == 1, F.lit(0)).otherwise(at(k)).cast("int")))).otherwise(F.array().cast("array<double>"))
    return F.concat(a, more)


def _meta(idx: Column, start: Column, n: Column, size: int, first_pad: Column) -> dict[str, Column]:
    end = start + size
    longer = F.greatest(n, F.lit(size))
    own = F.greatest(end - longer, F.lit(0))
    return {
        "window_id": F.format_string("window_%04d", idx), "start_index": start.cast("bigint"), "end_index": F.least(end, n).cast("bigint"),
        "n_padded": (own + F.when(start == 0, first_pad).otherwise(0)).cast("bigint"),
    }


def window_index(lc: DataFrame, window_size: int = 2001, overlap: float = 0.75, stride: int | None = None, to_padded: bool = False) -> DataFrame:
    """(target_id, idx, window_id, start_index, end_index, n_padded): the windows of every curve, from its length alone.

    Windows begin at 0, stride, ... below the curve's length; with to_padded, below window_size for a shorter curve.
    n_padded counts the first padding of a short curve only in its first window.
    """
    step = stride or stride_of(window_size, overlap)
    n = lc.groupBy(KEY).agg(F.count(F.lit(1)).cast("int").alias("n"))
    limit = F.greatest(F.col("n"), F.lit(window_size)) if to_padded else F.col("n")
    w = n.select(KEY, "n", F.explode(F.sequence(F.lit(0), limit - 1, F.lit(step))).alias("_s")).withColumn("idx", (F.col("_s") / step).cast("int"))
    return w.withColumns(_meta(F.col("idx"), F.col("_s"), F.col("n"), window_size, F.greatest(F.lit(window_size) - F.col("n"), F.lit(0)))).select(KEY, "idx", "window_id", "start_index", "end_index", "n_padded")


def window_rows(lc: DataFrame, window_size: int = 2001, overlap: float = 0.75, stride: int | None = None) -> DataFrame:
    """lc with idx and pos: a row for each window that a sample lies in, unpadded."""
    step = stride or stride_of(window_size, overlap)
    i = F.col("seq")
    low = F.greatest(F.ceil((i - window_size + 1) / step), F.lit(0)).cast("int")
    idx = F.explode(F.sequence(low, F.floor(i / step).cast("int")))
    return lc.withColumn("idx", idx).withColumn("pos", (F.col("seq") - F.col("idx") * step).cast("int"))


def generate_windows(lc: DataFrame, window_size: int = 2001, overlap: float = 0.75, padding_mode: str = "edge", stride: int | None = None, to_padded: bool = False) -> DataFrame:
    """One row per window: its index columns, and time and flux as arrays of window_size.

    Rows must be numbered 0, 1, ... in seq. A curve shorter than a window is padded once to that length, and its windows
    are cut from the padded curve. Missing values are NaN in the arrays. A curve without rows has no windows.
    """
    d = lc.select(KEY, "seq", "time", "flux", F.count(F.lit(1)).over(by_target()).cast("int").alias("n"))
    return windows_of(d, window_size, overlap, padding_mode, stride, to_padded)


def windows_of(d: DataFrame, window_size: int, overlap: float, padding_mode: str, stride: int | None, to_padded: bool) -> DataFrame:
    """generate_windows of rows that know n, their curve's length."""
    if padding_mode not in PADDING:
        raise ValueError(f"unknown padding mode {padding_mode!r}")
    step = stride or stride_of(window_size, overlap)
    nan = F.lit(float("nan"))
    point = F.struct("seq", F.coalesce("time", nan).alias("t"), F.coalesce("flux", nan).alias("f"))
    long = window_rows(d.filter(F.col("n") >= window_size), window_size, stride=step)
    long = long.groupBy(KEY, "n", "idx").agg(F.array_sort(F.collect_list(point)).alias("p")).withColumn("_s", F.col("idx") * step)
    short = d.filter(F.col("n") < window_size).groupBy(KEY, "n").agg(F.array_sort(F.collect_list(point)).alias("p"))
    limit = F.lit(window_size) if to_padded else F.col("n")
    short = short.withColumn("_s", F.explode(F.sequence(F.lit(0), limit - 1, F.lit(step)))).withColumn("idx", (F.col("_s") / step).cast("int"))

    def values(name: str, whole: bool) -> Column:
        a = F.transform("p", lambda x: x[name])
        if whole:
            a = F.slice(pad_array(a, F.lit(window_size) - F.col("n"), padding_mode), F.col("_s") + 1, window_size)
        return a

    parts = []
    for df, whole in ((long, False), (short, True)):
        df = df.withColumns({"_t": values("t", whole), "_f": values("f", whole)})
        missing = F.lit(window_size) - F.size("_t")
        df = df.withColumns({"time": pad_array(F.col("_t"), missing, padding_mode), "flux": pad_array(F.col("_f"), missing, padding_mode)})
        df = df.withColumns(_meta(F.col("idx"), F.col("_s"), F.col("n"), window_size, F.greatest(F.lit(window_size) - F.col("n"), F.lit(0))))
        parts.append(df.select(KEY, "idx", "window_id", "start_index", "end_index", "n_padded", "time", "flux"))
    return parts[0].unionByName(parts[1])


def create_windows(lc: DataFrame, window_size: int = 2001, stride: int = 500, padding_mode: str = "edge") -> DataFrame:
    """The older way: an explicit stride, and windows up to the padded length of a short curve."""
    return generate_windows(lc, window_size, padding_mode=padding_mode, stride=stride, to_padded=True)


def windows_to_arrays(windows: DataFrame):
    """(flux, time, ids) stacked in NumPy on the driver; for windows of few targets."""
    import numpy as np

    rows = windows.orderBy(KEY, "idx").select("flux", "time", "window_id").toPandas()
    if rows.empty:
        return np.empty((0, 0)), np.empty((0, 0)), []
    return np.stack(rows["flux"].to_list()), np.stack(rows["time"].to_list()), rows["window_id"].to_list()
