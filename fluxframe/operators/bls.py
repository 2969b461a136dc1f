"""Box least squares (Kovács, Zucker, Mazeh 2002): the search for periodic dips.

Boxes begin at every bin of the folded curve, empty ones too, as a box that begins in a gap can end sooner. The relational
form sums flux per bin and adds every bin to the boxes that it is part of; its rows are curves times periods times bins
times lengths, so it is the form that SQL can check, for grids of some hundred periods. The fast form deals curves and chunks of periods out
to tasks and lets NumPy try a block of periods at once. Both try the same boxes. For the best period alone the bounded
search gives the same result from a small part of the work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import by_target, KEY, finite
from ..functions.state import settled
from .transit import fold, transit_parameters

PERIODS = (0.5, 400.0, 50_000)
DURATIONS = (0.05, 0.10, 0.15, 0.20, 0.25, 0.33)
OVERSAMPLE = 2
#: Powers, in units of the curve's variance, are compared to so many digits, so that sums in another order rank alike.
DIGITS = 8
#: Boxes of a block of periods that NumPy holds at once, or curve points times blocks of periods: a core's cache holds some arrays of them.
CELLS = 50_000
#: How far from its period's best power, in units of the curve's variance and as a share, a box is still ranked exactly: far above DIGITS and the rounding of sums.
NEAR = 1e-6
#: Periods that the relational form takes at most: it is the checked form, and rows times periods do not scale.
MOST_PERIODS = 1_000
#: Parts of boxes that a task of the relational form adds up: some 250 MB of groups, so none is spilled.
PARTS = 1_000_000


def period_grid(spark: SparkSession, low: float, high: float, n: int) -> DataFrame:
    """(period_id, period): n periods spaced evenly from low to high."""
    step = (high - low) / max(n - 1, 1)
    return spark.range(n).select(F.col("id").cast("int").alias("period_id"), (F.lit(low) + F.col("id") * step).alias("period"))


def _centred(lc: DataFrame) -> DataFrame:
    d = lc.filter(finite("flux") & finite("time"))
    own = by_target()
    return d.select(KEY, (F.col("time") - F.min("time").over(own)).alias("t"), (F.col("flux") - F.median("flux").over(own)).alias("y"), F.min("time").over(own).alias("t_min"), F.var_pop("flux").over(own).alias("v")).withColumns({"_S": F.sum("y").over(own), "_N": F.count(F.lit(1)).over(own)})


def _boxes(durations: tuple, oversample: int) -> tuple[float, list[int]]:
    width = min(durations) / oversample
    return width, [max(1, round(d / width)) for d in durations]


def periodogram(lc: DataFrame, grid: DataFrame, durations: tuple = DURATIONS, oversample: int = OVERSAMPLE, tasks: int | None = None) -> DataFrame:
    """(target_id, period_id, period, power, duration, t0, depth): the best box of every curve and period.

    power is half the gain in squared error, over dips alone; ties go to the earlier bin, then the shorter box. A period
    without a dip has power 0. grid(period_id, period) is counted, and more than MOST_PERIODS are refused: fast_periodogram
    takes those. So its broadcast is bounded. Every row becomes a part of a box for each period, length and place in the box;
    rows are counted, and tasks are by default so many that one adds up PARTS of them, and at least twice the cluster's cores.
    The one exchange keeps that number and is not coalesced by its own small size.
    """
    n = grid.count()
    if n > MOST_PERIODS:
        raise ValueError(f"{n} periods; the relational form takes {MOST_PERIODS} at most, fast_periodogram any number")
    width, lengths = _boxes(durations, oversample)
    grid = F.broadcast(grid.withColumn("_B", F.ceil(F.col("period") / width).cast("int")))
    tasks = tasks or max(2 * lc.sparkSession.sparkContext.defaultParallelism, -(-lc.count() * n * sum(lengths) // PARTS))
    d = _centred(lc.repartition(tasks, KEY)).join(grid).select(KEY, "period_id", "period", "_B", F.floor(F.pmod("t", F.col("period")) / width).cast("int").alias("bin"), "y", "t_min", "v", "_S", "_N")
    held = ("period", "_B", "t_min", "v", "_S", "_N")
    # the same in all rows of a group; a maximum is one number of a group's state, a first value is two
    first = [F.max(c).alias(c) for c in held]
    bins = d.groupBy(KEY, "period_id", "bin").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"), *first)
    # a bin is part of the k boxes of k bins that begin at it or up to k - 1 bins before it
    steps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(q)).alias("duration"), F.lit(j).alias("j")) for k, q in zip(lengths, durations, strict=True) for j in range(k)))
    parts = bins.select(KEY, "period_id", *held, "bin", "s", "n", F.explode(steps).alias("_x")).select(KEY, "period_id", *held, "s", "n", F.col("_x.k").alias("k"), F.col("_x.duration").alias("duration"), F.pmod(F.col("bin") - F.col("_x.j"), F.col("_B")).alias("start"))
    boxes = parts.groupBy(KEY, "period_id", "k", "start").agg(F.sum("s").alias("s_in"), F.sum("n").alias("n_in"), F.max("duration").alias("duration"), *first).filter("n_in < _N")
    gap = (F.col("_S") - F.col("s_in")) / (F.col("_N") - F.col("n_in")) - F.col("s_in") / F.col("n_in")
    power = F.when(gap > 0, 0.5 * F.col("n_in") * gap * gap).otherwise(0.0)
    scored = boxes.select(KEY, "period_id", "period", F.col("start").alias("bin"), "k", "duration", power.alias("power"), "v", F.greatest(gap, F.lit(0.0)).alias("depth"), (F.col("t_min") + (F.col("start") + F.col("k") / 2.0) * width).alias("t0"))
    # one minimum that combines on the map side: the greatest power, then the earliest bin, then the shortest box
    rank = F.struct((-F.round(F.try_divide("power", "v"), DIGITS)).alias("less"), "bin", "k", "period", "power", "duration", "t0", "depth")
    return scored.groupBy(KEY, "period_id").agg(F.min(rank).alias("x")).select(KEY, "period_id", *(f"x.{c}" for c in ("period", "power", "duration", "t0", "depth")))


def _gaps(s_in: np.ndarray, n_in: np.ndarray, total: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Depth of the dip and power of boxes by their sums; power 0 without a dip."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = (total - s_in) / (n - n_in) - s_in / n_in
    power = np.where((n_in > 0) & (n_in < n) & (gap > 0), 0.5 * n_in * gap**2, 0.0)
    return gap, power


def _box_sums(folded: np.ndarray, weights: np.ndarray | None, bins: np.ndarray, lengths: list[int]) -> np.ndarray:
    """The weights, or without them the points, of boxes by period, length and start: all bins of the folded curve as starts."""
    rows, most = len(folded), max(lengths)
    size = int(max(bins.max(), folded.max() + 1)) + most
    flat = (folded + np.arange(rows)[:, None] * size).ravel()
    h = np.bincount(flat, None if weights is None else np.tile(weights, rows), rows * size).reshape(rows, size)
    index = np.arange(most)
    h[np.arange(rows)[:, None], bins[:, None] + index] += np.where(index < bins[:, None], h[:, :most], 0)  # boxes run on over the end of the period
    c = np.zeros((rows, size + 1), h.dtype)
    np.cumsum(h, axis=1, out=c[:, 1:])
    starts = int(bins.max())
    out = np.empty((rows, len(lengths), starts), h.dtype)
    for q, k in enumerate(lengths):
        np.subtract(c[:, k : k + starts], c[:, :starts], out=out[:, q])
    return out


def _over_bins(at: np.ndarray, y: np.ndarray, bins: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, sum, points) of boxes by period, length and start. What is no box has no points."""
    s_in, n_in = _box_sums(at, y, bins, lengths), _box_sums(at, None, bins, lengths)
    starts = np.arange(n_in.shape[2])
    n_in *= (starts < bins[:, None])[:, None]
    return np.broadcast_to(starts, n_in.shape), s_in, n_in


def _over_points(at: np.ndarray, y: np.ndarray, bins: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for curves with fewer points than bins: what a box holds changes only where it has just left a point or just reached one, so two starts a point are all."""
    rows, n = at.shape
    order = np.argsort(at, axis=1, kind="stable")
    at = np.take_along_axis(at, order, axis=1)
    twice = np.concatenate([at, at + bins[:, None]], axis=1)
    sums = np.zeros((rows, 2 * n + 1))
    np.cumsum(np.tile(y[order], 2), axis=1, out=sums[:, 1:])
    step = int(twice.max()) + max(lengths) + 2
    lift, base = np.arange(rows)[:, None] * step, np.arange(rows)[:, None] * 2 * n
    flat = (twice + lift).ravel()
    first = lambda x: np.searchsorted(flat, (x + lift).ravel()).reshape(x.shape) - base
    after = first(twice + 1)  # places after the points of each point's own bin
    left = at + 1
    wrapped = left >= bins[:, None]
    left = np.where(wrapped, 0, left)
    left_from = np.where(wrapped, 0, after[:, :n])
    starts, s_in, n_in = (np.empty((rows, len(lengths), 2 * n), kind) for kind in (int, float, int))
    for q, k in enumerate(lengths):
        reach = at - k + 1
        before = reach < 0
        reach = np.where(before, reach + bins[:, None], reach)
        ok = reach >= 0  # a box longer than the period twice over has no such start
        lo = np.concatenate([left_from, first(np.maximum(reach, 0))], axis=1)
        hi = np.concatenate([first(left + k), np.where(before, after[:, n:], after[:, :n])], axis=1)
        starts[:, q] = np.concatenate([left, reach], axis=1)
        s_in[:, q] = np.take_along_axis(sums, hi, axis=1) - np.take_along_axis(sums, lo, axis=1)
        n_in[:, q] = hi - lo
        n_in[:, q, n:] *= ok
    return starts, s_in, n_in


def search_arrays(t: np.ndarray, y: np.ndarray, periods: np.ndarray, durations: tuple = DURATIONS, oversample: int = OVERSAMPLE) -> tuple[np.ndarray, ...]:
    """(power, duration, t0 after the first time, depth), each for every period, of one curve centred on its median, t from 0.

    The power of a box of m of n points is its squared sum of deviations from the mean by a factor of m alone, which a table
    holds. So all boxes are compared without a division, and only those that come near their period's best are ranked by _gaps.
    """
    width, lengths = _boxes(durations, oversample)
    bins = np.ceil(periods / width).astype(int)
    power, depth, start, chosen = np.zeros(len(periods)), np.zeros(len(periods)), np.zeros(len(periods), int), np.zeros(len(periods), int)
    scale, total, n = y.var() or 1.0, y.sum(), len(y)
    m = np.arange(1, n)
    factor, expected = np.zeros(n + 1), np.arange(n + 1) * (total / n)
    factor[1:n] = (n / (n - m)) ** 2 / (2 * m * scale)
    at = 0
    while at < len(periods):
        dense = bins[at] <= 4 * n
        per_row = len(lengths) * (int(bins[at]) + max(lengths) + n if dense else 4 * n)
        to = min(len(periods), at + max(1, CELLS // per_row))
        if dense:
            to = max(at + 1, min(to, int(np.searchsorted(bins[at:to], max(4 * n, bins[at]), "right")) + at))
        folded = np.floor(np.mod(t, periods[at:to, None]) / width).astype(int)
        starts, s_in, n_in = (_over_bins if dense else _over_points)(folded, y, bins[at:to], lengths)
        near = expected.take(n_in, mode="clip")
        np.subtract(s_in, near, out=near)
        np.minimum(near, 0, out=near)
        near *= near
        near *= factor.take(n_in, mode="clip")
        top = near.max(axis=(1, 2))
        row, q, i = np.nonzero(near >= (top - NEAR * (1 + top))[:, None, None])
        gap, found = _gaps(s_in[row, q, i], n_in[row, q, i], total, n)
        dips = found > 0
        row, q, begin, gap, found = row[dips], q[dips], starts[row, q, i][dips], gap[dips], found[dips]
        # the greatest power of each period, then the earliest start, then the first length
        order = np.lexsort((q, begin, -np.round(found / scale, DIGITS), row))
        first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        own = at + row[first]
        power[own], depth[own], start[own], chosen[own] = found[first], gap[first], begin[first], q[first]
        at = to
    return power, np.array(durations)[chosen], (start + np.array(lengths)[chosen] / 2) * width, depth


def _found(key: str, ids: np.ndarray, periods: np.ndarray, found: tuple[np.ndarray, ...], first: float) -> pa.RecordBatch:
    power, duration, t0, depth = found
    names = [KEY, "period_id", "period", "power", "duration", "t0", "depth"]
    return pa.RecordBatch.from_arrays([pa.array([key] * len(ids), pa.string()), pa.array(ids, pa.int32()), *map(pa.array, (periods, power, duration, t0 + first, depth))], names)


def _search(grid: np.ndarray, chunk: int, durations: tuple, oversample: int) -> Callable:
    def one(key: str, c: int, time: np.ndarray, flux: np.ndarray) -> pa.RecordBatch:
        own = grid[c * chunk : (c + 1) * chunk]
        found = search_arrays(time - time.min(), flux - np.median(flux), own, durations, oversample)
        return _found(key, np.arange(c * chunk, c * chunk + len(own)), own, found, time.min())

    return _by_curve(one)


def _bounded(grid: np.ndarray, chunk: int, durations: tuple, oversample: int) -> Callable:
    def one(key: str, c: int, time: np.ndarray, flux: np.ndarray) -> pa.RecordBatch:
        own = grid[c * chunk : (c + 1) * chunk]
        at, found = best_of_arrays(time - time.min(), flux - np.median(flux), own, durations, oversample)
        return _found(key, c * chunk + at, own[at], found, time.min())

    return _by_curve(one)


def _by_curve(one: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by curve and chunk; a curve is held until the next one begins."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, out, size = None, [], 0
        whole = lambda: one(*now, *(np.concatenate(x) for x in zip(*held, strict=True)))
        for b in batches:
            keys, chunks, time, flux = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cuts = (np.flatnonzero((keys[1:] != keys[:-1]) | (chunks[1:] != chunks[:-1])) + 1).tolist()
            for x, y in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if now != (keys[x], chunks[x]):
                    if held:
                        out.append(whole())
                        size += out[-1].num_rows
                    now, held = (keys[x], chunks[x]), []
                held.append((time[x:y], flux[x:y]))
            if size > 20_000:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out, size = [], 0
        if held:
            out.append(whole())
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return run


def block_bounds(t: np.ndarray, y: np.ndarray, first: np.ndarray, last: np.ndarray, coarse: int, durations: tuple = DURATIONS, oversample: int = OVERSAMPLE) -> np.ndarray:
    """For every block of periods, from first to last, a number that no box at any of them exceeds in power.

    A box of m points with the sum s of deviations from the mean has power n^2 s^2 / (2 m (n - m)^2), and by Cauchy s^2 / m
    is at most the sum of the squares of its negative deviations. Over a block a point's place in the folded curve moves by
    the number of its cycle times the block's extent; blocks are so short that this is at most a coarse bin (see _blocks).
    A point is counted in the bin of its least place, so a box's points lie in the bins that it covers and the one before them.
    """
    width, lengths = _boxes(durations, oversample)
    size = coarse * width
    n, reach = len(t), max(lengths) * width
    z = y - y.mean()
    q = np.minimum(z, 0) ** 2
    window = int(np.ceil(max(lengths) / coarse)) + 2
    out = np.empty(len(first))
    at = 0
    while at < len(first):
        rows = max(1, CELLS // (n + int(last[at:].max() / size) + window + 3))
        a, b = first[at : at + rows, None], last[at : at + rows, None]
        place = t - np.floor(t / a) * b
        # boxes run on over the end of the period: what lies in their reach is met there once more
        again = np.floor(np.where(place < reach, place + a, -size) / size).astype(int) + 1
        bins = max(int(np.floor(place.max() / size)) + 1, int(again.max())) + window + 1
        lift = np.arange(len(a))[:, None] * bins
        index = np.concatenate([np.floor(place / size).astype(int) + 1 + lift, again + lift], axis=1).ravel()
        twice = again > 0
        sums = []
        for w in (q, np.ones(n)):
            h = np.bincount(index, np.concatenate([np.broadcast_to(w, place.shape), np.where(twice, w, 0)], axis=1).ravel(), len(a) * bins).reshape(len(a), bins)
            c = np.pad(h.cumsum(axis=1), ((0, 0), (1, 0)))
            sums.append(c[:, window:] - c[:, :-window])
        with np.errstate(divide="ignore", invalid="ignore"):
            bound = np.where(sums[1] < n - 0.5, 0.5 * sums[0] * (n / (n - sums[1])) ** 2, np.inf)
        out[at : at + rows] = bound.max(axis=1) * (1 + 1e-9)
        at += rows
    return out


def period_bounds(t: np.ndarray, y: np.ndarray, periods: np.ndarray, durations: tuple = DURATIONS, oversample: int = OVERSAMPLE) -> np.ndarray:
    """The same bound for every period by itself, from its longest boxes alone, as shorter ones lie in them: a sixth of the boxes that a search tries."""
    width, lengths = _boxes(durations, oversample)
    bins = np.ceil(periods / width).astype(int)
    n, longest = len(t), [max(lengths)]
    q = np.minimum(y - y.mean(), 0) ** 2
    factor = 0.5 * (n / (n - np.minimum(np.arange(n + 1), max(n - 1, 0)))) ** 2  # no box holds all points
    out = np.empty(len(periods))
    at = 0
    while at < len(periods):
        to = at + max(1, CELLS // (int(bins[at:].max()) + longest[0] + n))
        folded = np.floor(np.mod(t, periods[at:to, None]) / width).astype(int)
        bound = _box_sums(folded, q, bins[at:to], longest) * factor.take(_box_sums(folded, None, bins[at:to], longest), mode="clip")
        out[at:to] = bound.max(axis=(1, 2)) * (1 + 1e-9)
        at = to
    return out


def _blocks(periods: np.ndarray, span: float, room: float) -> np.ndarray:
    """Where blocks begin: within a block cycles and the period itself move a point by room at most."""
    following = np.searchsorted(periods, periods + room / (span // periods + 1), "right").tolist()
    starts, i = [], 0
    while i < len(following):
        starts.append(i)
        i = following[i]
    return np.array(starts, int)


#: Coarse bins of the bounds, in bins, from the first pass to the last; periods of the best bounds that each pass tries; periods that are tried at once after that.
COARSE, TRIED, AT_ONCE = (26, 13, 6), 16, 64


def best_of_arrays(t: np.ndarray, y: np.ndarray, periods: np.ndarray, durations: tuple = DURATIONS, oversample: int = OVERSAMPLE) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(places of periods, their power, duration, t0 and depth): the greatest power and all that equal it but for DIGITS, as search_arrays finds them.

    Branch and bound. Periods beyond the curve's length and the longest box fold it alike, so the first stands for all.
    The others are bounded in blocks that get shorter from pass to pass, and what is left of them each by itself; what is
    bounded below the best so far is dropped, and the rest is searched, the most promising first. Of a curve without a dip the
    first period is given.
    """
    width, lengths = _boxes(durations, oversample)
    alike = int(np.searchsorted(periods, t.max() + (max(lengths) + 1) * width, "right"))
    alive = np.arange(min(len(periods), alike + 1))
    found: dict[int, tuple] = {}
    best = 0.0

    def attempt(places: np.ndarray) -> None:
        nonlocal best
        places = np.sort(np.array([i for i in places.tolist() if i not in found], int))
        if len(places):
            found.update(zip(places.tolist(), zip(*search_arrays(t, y, periods[places], durations, oversample), strict=True), strict=True))
            best = max(best, *(found[i][0] for i in places.tolist()))

    attempt(alive[:1])
    bounds = np.full(len(alive), np.inf)
    near = 1 - 10.0**-DIGITS
    # each by itself: a search of the others costs less by their points
    left = np.ceil(periods[alive] / width) <= 4 * len(t)
    for coarse in (*COARSE, None):
        if coarse:
            starts = _blocks(periods[alive], t.max(), (coarse - 1) * width)
            ends = np.append(starts[1:], len(alive))
            long = np.flatnonzero(ends - starts > 2)  # shorter ones cost more to bound as blocks
            bound = np.full(len(starts), np.inf)
            if len(long):
                bound[long] = block_bounds(t, y, periods[alive[starts[long]]], periods[alive[ends[long] - 1]], coarse, durations, oversample)
            bound = np.repeat(bound, ends - starts)
            bounds = np.minimum(bounds, bound)
            now = left & np.isinf(bound)
        else:
            now = left
        left = left & ~now
        bounds[now] = np.minimum(bounds[now], period_bounds(t, y, periods[alive[now]], durations, oversample))
        known = np.flatnonzero(np.isfinite(bounds))
        if coarse:
            attempt(alive[known[np.argsort(-bounds[known], kind="stable")[:TRIED]]])
        keep = (bounds >= best * near) & (bounds > 0)
        alive, bounds, left = alive[keep], bounds[keep], left[keep]
    order = np.argsort(-bounds, kind="stable")
    for i in range(0, len(order), AT_ONCE):
        some = order[i : i + AT_ONCE]
        attempt(alive[some[bounds[some] >= best * near]])
    places = [i for i in sorted(found) if found[i][0] >= best * near] if best > 0 else [0]
    return np.array(places, int), tuple(np.array(c) for c in zip(*(found[i] for i in places), strict=True))


def fast_periodogram(lc: DataFrame, low: float = PERIODS[0], high: float = PERIODS[1], n: int = PERIODS[2], durations: tuple = DURATIONS, oversample: int = OVERSAMPLE, chunk: int = 5_000, tasks: int | None = None) -> DataFrame:
    """periodogram over an even grid, by NumPy: curves and chunks of periods are dealt out to tasks, so one long curve spreads too.

    tasks is twice the cluster's cores by default. A task holds one curve at a time.
    """
    grid = np.linspace(low, high, n)
    parts = -(-n // chunk)
    d = lc.filter(finite("flux") & finite("time")).select(F.col(KEY).cast("string").alias(KEY), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_chunk"), "time", "flux", "seq")
    dealt = d.repartition(tasks or 2 * lc.sparkSession.sparkContext.defaultParallelism, KEY, "_chunk").sortWithinPartitions(KEY, "_chunk", "seq").drop("seq")
    return dealt.mapInArrow(_search(grid, chunk, durations, oversample), f"{KEY} string, period_id int, period double, power double, duration double, t0 double, depth double")


def bounded_search(lc: DataFrame, low: float = PERIODS[0], high: float = PERIODS[1], n: int = PERIODS[2], durations: tuple = DURATIONS, oversample: int = OVERSAMPLE, chunks: int = 1, tasks: int | None = None) -> DataFrame:
    """The rows of fast_periodogram that best_period chooses among: of every curve those of the greatest power. Their best_period is the same.

    The other periods are bounded, not searched. A curve goes to one task, or to as many as chunks, each of which bounds its own share of the periods.
    """
    grid = np.linspace(low, high, n)
    d = lc.filter(finite("flux") & finite("time")).select(F.col(KEY).cast("string").alias(KEY), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_chunk") if chunks > 1 else F.lit(0).alias("_chunk"), "time", "flux", "seq")
    dealt = d.repartition(tasks or 2 * lc.sparkSession.sparkContext.defaultParallelism, KEY, "_chunk").sortWithinPartitions(KEY, "_chunk", "seq").drop("seq")
    return dealt.mapInArrow(_bounded(grid, -(-n // chunks), durations, oversample), f"{KEY} string, period_id int, period double, power double, duration double, t0 double, depth double")


def best_period(power: DataFrame) -> DataFrame:
    """The row of the greatest power for each target; the first of those that equal it but for the rounding of sums."""
    own = Window.partitionBy(KEY)
    ranked = power.withColumn("_p", F.round(F.coalesce(F.try_divide("power", F.max("power").over(own)), F.lit(0.0)), DIGITS))
    return ranked.withColumn("_r", F.row_number().over(own.orderBy(F.desc("_p"), "period_id"))).filter("_r = 1").drop("_r", "_p")


def transit_features(lc: DataFrame, power: DataFrame) -> DataFrame:
    """Detections: the best period with the parameters of the curve folded at it. Both period and best_period are given.

    The best periods are settled when this is called, as they are joined several times and a search runs once for each.
    """
    best = settled(best_period(power)).withColumnsRenamed({"power": "bls_power", "duration": "bls_duration", "depth": "bls_depth"})
    found = transit_parameters(fold(lc, best))
    return best.join(found, KEY).withColumn("best_period", F.col("period"))
