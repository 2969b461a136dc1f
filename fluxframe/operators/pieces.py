"""Operators on curves that are longer than a task.

A curve is cut into pieces of about size rows, in array order by seq or in time order by sampled bounds, and a piece, not a
curve, is what a task holds. What a row needs from other pieces comes in two ways: as a halo, the rows around a piece that go
to it as well, or as carried state, the last valid point before and the first one after, found from one row for each piece. The
results are those of the operators on whole curves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import KEY, MAD_TO_SIGMA, broadcast_if_small, finite, over_finite, where
from ..functions.state import settled
from . import detrend, missing, windows
from .quality import GAP_FACTOR
from .selection import FEW, medians

#: Rows of a piece.
SIZE = 1_000_000
PIECE = "_piece"
#: Bounds in time that are sampled at most; more pieces than these are not needed at 1e9 rows a curve.
MOST_BOUNDS = 1_000


def _in(*order: str):
    return Window.partitionBy(KEY, PIECE).orderBy(*order)


def _of_target(lc: DataFrame, found: DataFrame) -> DataFrame:
    """lc with what is found for its targets; a hot target's rows are not gathered, as either found is broadcast or Spark splits the join."""
    return lc.join(broadcast_if_small(found.withColumnRenamed(KEY, "_t")), F.col(KEY).eqNullSafe(F.col("_t")), "left").drop("_t")


def by_seq(lc: DataFrame, size: int = SIZE) -> DataFrame:
    """lc with its piece in array order."""
    return lc.withColumn(PIECE, F.expr(f"seq div {size}"))


def by_time(lc: DataFrame, size: int = SIZE) -> DataFrame:
    """lc with its piece in time order; rows without a time come first. Rows of one time stay together.

    Only curves of more than size rows are sampled for bounds, so of short ones nothing is held.
    """
    n = settled(lc.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > size))
    most = n.agg(F.max("n")).first()[0]
    if most is None:
        return lc.withColumn(PIECE, F.lit(0).cast("bigint"))
    parts = min(MOST_BOUNDS, -(-most // size))
    long = lc.join(broadcast_if_small(n.select(F.col(KEY).alias("_t"))), F.col(KEY).eqNullSafe(F.col("_t")), "left_semi")
    bounds = settled(long.groupBy(KEY).agg(F.percentile_approx("time", F.array(*(F.lit(i / parts) for i in range(1, parts))), 20 * parts).alias("_bounds"))) if parts > 1 else None
    d = _of_target(lc, bounds)
    return d.withColumn(PIECE, F.when(F.col("_bounds").isNull(), 0).otherwise(F.size(F.filter("_bounds", lambda b: b <= F.col("time")))).cast("bigint")).drop("_bounds")


def _ends(d: DataFrame, values: dict[str, Column], order: Column) -> DataFrame:
    """(target, piece, and for each value its last one before the piece, <name>_before, and its first one after it, <name>_after)."""
    at = lambda v: F.when(v.isNotNull(), order)
    own = d.groupBy(KEY, PIECE).agg(*(f(v, at(v)).alias(f"_{side}_{name}") for name, v in values.items() for side, f in (("last", F.max_by), ("first", F.min_by))))
    w, back = Window.partitionBy(KEY).orderBy(PIECE), Window.partitionBy(KEY).orderBy(F.desc(PIECE))
    for name in values:
        own = own.withColumns({f"{name}_before": F.last(f"_last_{name}", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), f"{name}_after": F.last(f"_first_{name}", True).over(back.rowsBetween(Window.unboundedPreceding, -1))})
    return own.select(KEY, PIECE, *(f"{name}_{side}" for name in values for side in ("before", "after")))


def _with_ends(d: DataFrame, values: dict[str, Column], order: Column, *by: str) -> DataFrame:
    """d with, for each value, the last one up to a row, <name>_before, and the first one from it on, <name>_after, over the whole curve."""
    ends = broadcast_if_small(settled(_ends(d, values, order)).withColumnsRenamed({KEY: "_t", PIECE: "_p"}))
    j = d.join(ends, F.col(KEY).eqNullSafe(F.col("_t")) & (F.col(PIECE) == F.col("_p")), "left").drop("_t", "_p")
    # what follows is looked for in the reverse order: a frame that reaches forward would be computed anew for every row
    orders = {"before": _in(*by), "after": _in(*map(F.desc, by))}
    near = lambda v, side: F.last(v, True).over(orders[side].rowsBetween(Window.unboundedPreceding, 0))
    return j.withColumns({f"{name}_{side}": F.coalesce(near(v, side), F.col(f"{name}_{side}")) for name, v in values.items() for side in orders})


def fill_missing(lc: DataFrame, strategy: str = "linear", size: int = SIZE) -> DataFrame:
    """missing.fill_missing by pieces; cubic, whose spline is one system of equations for the whole curve, is not among the strategies."""
    if strategy not in missing.STRATEGIES or strategy == "cubic":
        raise ValueError(f"strategy {strategy!r} does not work by pieces")
    flux = F.col("flux")
    if strategy in ("ffill", "bfill"):
        d = _with_ends(by_seq(lc, size), {"_f": flux}, F.col("seq"), "seq")
        order = ("_f_before", "_f_after") if strategy == "ffill" else ("_f_after", "_f_before")
        return d.withColumn("flux", F.coalesce(*order)).select(*lc.columns)
    valid = F.when(flux.isNotNull(), F.col("seq"))
    ends = settled(lc.groupBy(KEY).agg(F.min_by("flux", valid).alias("_first"), F.max_by("flux", valid).alias("_last"), F.count("flux").alias("_v")))
    point = F.when(flux.isNotNull(), F.struct(F.col("time").alias("t"), flux.alias("f")))
    d = _with_ends(_of_target(by_time(lc, size), ends), {"_x": point}, F.struct("time", "seq"), "time", "seq")
    return d.withColumn("flux", missing.between(strategy, F.col("_x_before"), F.col("_x_after"))).select(*lc.columns)


def _with_halo(lc: DataFrame, halo: int, size: int) -> DataFrame:
    """lc, which knows _n, with its piece, and each row once more for a piece that it is within halo rows of; _own tells which row is which."""
    if halo > size:
        raise ValueError(f"a piece of {size} rows is shorter than the {halo} rows that a row needs around it")
    at = lambda shift: F.expr(f"(seq + {shift}) div {size}")
    d = lc.withColumn(PIECE, F.explode(F.array_distinct(F.array(F.greatest(at(-halo), F.lit(0).cast("bigint")), at(0), F.least(at(halo), F.expr(f"(_n - 1) div {size}"))))))
    return d.withColumn("_own", F.col(PIECE) == at(0))


def _sizes(lc: DataFrame, few: int) -> DataFrame:
    """(target, _n, _m): rows, and the median of finite flux."""
    n = lc.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(KEY, "_k")
    m = medians(lc.filter(finite("flux")), KEY, "flux", few).withColumnRenamed("median", "_m")
    return settled(n.join(m, F.col(KEY).eqNullSafe(F.col("_k")), "left").select(F.col("_k").alias(KEY), "_n", "_m"))


def running_median_trend(lc: DataFrame, window: int, size: int = SIZE, few: int = FEW) -> DataFrame:
    """detrend.running_median_trend by pieces. Rows must be numbered 0, 1, ... in seq."""
    d = _with_halo(_of_target(lc, _sizes(lc, few)), max(window, 1) // 2 + 1, size).withColumn("_k", F.col("seq") + 1)
    return detrend.median_frames(d, window, KEY, PIECE).filter("_own").select(*lc.columns, "trend")


def savgol_trend(lc: DataFrame, window: int = 401, polyorder: int = 3, size: int = SIZE, few: int = FEW) -> DataFrame:
    """detrend.savgol_trend by pieces: fixed weights inside, the polynomials of the first and last window at the ends. Rows must be numbered 0, 1, ... in seq."""
    d = _with_halo(_of_target(lc, _sizes(lc, few)), window + polyorder + 2, size)

    def trend(rows: pa.Table, cuts: list[int]) -> np.ndarray:
        n, seq, middle = (rows.column(c).to_numpy() for c in ("_n", "seq", "_m"))
        flux = rows.column("flux").to_numpy()
        filled = np.where(np.isfinite(flux), flux, np.where(np.isnan(middle), 1.0, middle))
        return np.concatenate([detrend.smoothed(filled[a:b], int(n[a]), window, polyorder, seq[a] == 0, seq[b - 1] == n[a] - 1) for a, b in zip(cuts, cuts[1:], strict=False)])

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in lc.schema.fields)}, trend double"
    return d.repartition(KEY, PIECE).sortWithinPartitions(KEY, PIECE, "seq").mapInArrow(_by_piece(trend, lc.columns), schema)


def _by_piece(trend: Callable[[pa.Table, list[int]], np.ndarray], names: list[str]) -> Callable:
    """Own rows with their trend. Rows come sorted by piece; those of a piece are held until the next one begins, and many short pieces go at once."""

    def own(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        found = rows.append_column("trend", pa.array(trend(rows, [0, *_begins(rows), rows.num_rows])))
        yield from found.filter(found.column("_own")).select([*names, "trend"]).to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            # the row before the batch tells whether its first row begins a piece
            with_last = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), b]) if held else pa.Table.from_batches([b])
            begins = [i - bool(held) for i in _begins(with_last)]
            if begins:
                held.append(b.slice(0, begins[-1]))
                yield from own(pa.Table.from_batches([x for x in held if x.num_rows]))
                held = []
            held.append(b.slice(begins[-1] if begins else 0))
        if held:
            yield from own(pa.Table.from_batches(held))

    return run


def _begins(rows: pa.Table) -> list[int]:
    """Where another piece begins than that of the row before."""
    key, piece = (rows.column(c).to_numpy() for c in (KEY, PIECE))
    return (np.flatnonzero((key[1:] != key[:-1]) | (piece[1:] != piece[:-1])) + 1).tolist()


def generate_windows(lc: DataFrame, window_size: int = 2001, overlap: float = 0.75, padding_mode: str = "edge", stride: int | None = None, to_padded: bool = False) -> DataFrame:
    """windows.generate_windows where a curve's length comes from a count, not from a window over the curve: a task holds one window's rows at a time."""
    n = settled(lc.groupBy(KEY).agg(F.count(F.lit(1)).cast("int").alias("n")))
    return windows.windows_of(_of_target(lc.select(KEY, "seq", "time", "flux"), n), window_size, overlap, padding_mode, stride, to_padded)


def noise_and_gaps(lc: DataFrame, factor: float = GAP_FACTOR, size: int = SIZE, few: int = FEW) -> DataFrame:
    """(target_id, noise, median_cadence, gap_count, n_finite_times): those of quality.noise_estimate and cadence_and_gaps, by pieces and with selected medians."""
    flux, time = over_finite("flux"), over_finite("time")

    def steps(d: DataFrame, value: Column, order: Column, *by: str) -> DataFrame:
        ends = broadcast_if_small(settled(_ends(d, {"_x": value}, order)).select(F.col(KEY).alias("_t"), F.col(PIECE).alias("_p"), "_x_before"))
        j = d.join(ends, F.col(KEY).eqNullSafe(F.col("_t")) & (F.col(PIECE) == F.col("_p")), "left")
        before = F.coalesce(F.last(value, True).over(_in(*by).rowsBetween(Window.unboundedPreceding, -1)), F.col("_x_before"))
        return settled(j.select(KEY, (value - before).alias("_s")).filter("_s is not null"))

    middle = lambda df, c, name: medians(df, KEY, c, few).withColumnRenamed("median", name)
    d = steps(by_seq(lc, size), flux, F.col("seq"), "seq")
    off = _of_target(d, settled(middle(d, "_s", "_m"))).withColumn("_s", F.abs(F.col("_s") - F.col("_m")))
    noise = middle(off, "_s", "noise").withColumn("noise", F.col("noise") * (MAD_TO_SIGMA / 2**0.5))
    s = steps(by_time(lc, size), time, F.struct("time", "seq"), "time", "seq")
    cadence = settled(middle(s.filter("_s > 0"), "_s", "median_cadence"))
    gaps = _of_target(s, cadence).groupBy(KEY).agg(F.count(where(F.col("_s") > factor * F.col("median_cadence"), "_s")).alias("gap_count"))
    out = lc.groupBy(KEY).agg(F.count(time).alias("n_finite_times"))
    for found in (noise, cadence, gaps):
        out = _of_target(out, settled(found))
    return out.select(KEY, F.coalesce("noise", F.lit(0.0)).alias("noise"), F.coalesce("median_cadence", F.lit(0.0)).alias("median_cadence"), F.coalesce("gap_count", F.lit(0)).alias("gap_count"), "n_finite_times")
