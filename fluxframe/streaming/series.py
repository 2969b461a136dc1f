"""Gaps and noise of light curves as a stream delivers them, with state for each target.

Rows wait in their target's state until the watermark has passed them and then are taken in time order, so whatever order
they arrive in, spacings and steps are those of the ordered curve. The state is what waits and one row of sums, kept by the
state store over restarts. It travels with its target's rows, many targets in a batch, as a call for each variable of each
target would cost more than the rows. Rows that arrive behind the watermark change nothing and are counted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.expr import KEY, over_finite

DAY_US = 86_400_000_000
#: The state store that holds more state than memory.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Sums, and the times and then the fluxes of the rows that wait, NaN where missing.
_STATE = "settled_us bigint, last_us bigint, last_flux double, n bigint, n_gaps bigint, longest_us bigint, n_steps bigint, mean double, m2 double, n_late bigint, waiting binary"
_OUT = f"{KEY} string, settled_to timestamp, n bigint, n_gaps bigint, longest_gap_days double, noise double, n_late bigint"


def _series(gap_us: int) -> Callable:
    def settle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *known, held = state.getOption or (-(1 << 62), None, None, 0, 0, 0, 0, 0.0, 0.0, 0, b"")
        settled, last_us, last_flux, n, n_gaps, longest, steps, mean, m2, late = known
        mark = max(settled, state.getCurrentWatermarkMs() * 1000)
        new = [(pdf["us"].to_numpy(np.int64), pdf["flux"].to_numpy(float)) for pdf in batches if len(pdf)]
        in_time = [(us[us > settled], flux[us > settled]) for us, flux in new]
        n_late = sum(len(us) for us, _ in new) - sum(len(us) for us, _ in in_time)
        late += n_late
        half = len(held) // 2
        us, flux = (np.concatenate(x) for x in zip((np.frombuffer(held[:half], np.int64), np.frombuffer(held[half:], float)), *in_time, strict=True))
        ready = us <= mark
        order = np.lexsort((np.nan_to_num(flux[ready], posinf=np.inf, neginf=-np.inf), np.isnan(flux[ready]), us[ready]))
        left, left_flux = us[~ready], flux[~ready]
        us, flux = us[ready][order].tolist(), flux[ready][order].tolist()
        for at, value in zip(us, flux, strict=True):
            n += 1
            if last_us is not None:
                longest = max(longest, at - last_us)
                n_gaps += at - last_us > gap_us
            last_us = at
            if math.isfinite(value):
                if last_flux is not None:
                    steps += 1
                    off = value - last_flux - mean
                    mean += off / steps
                    m2 += off * (value - last_flux - mean)
                last_flux = value
        state.update((mark, last_us, last_flux, n, n_gaps, longest, steps, mean, m2, late, left.tobytes() + left_flux.tobytes()))
        if len(left):
            # when the watermark, in whole milliseconds, has passed the first row that waits now: it must be above this number
            state.setTimeoutTimestamp(max(-(-int(left.min()) // 1000) - 1, 1))
        if us or n_late:
            noise = (m2 / steps / 2) ** 0.5 if steps else 0.0
            yield pd.DataFrame({KEY: [key[0]], "settled_to": [pd.Timestamp(max(mark, 0), unit="us")], "n": [n], "n_gaps": [n_gaps], "longest_gap_days": [longest / DAY_US], "noise": [noise], "n_late": [late]})

    return settle


def gaps_and_noise(stream: DataFrame, gap_days: float, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """(target_id, settled_to, n, n_gaps, longest_gap_days, noise, n_late): a target's newest row replaces those before it.

    Of stream(target_id, ts, flux), whose rows may come in any order within late: rows so far that the watermark has passed,
    their spacings above gap_days, the longest of them, and the standard deviation of the steps between finite fluxes over
    the root of two. Rows without a time are left out. The query's output mode is update, and its session should have the
    setting PROVIDER when it is started.
    """
    rows = stream.filter(F.col(ts).isNotNull()).withWatermark(ts, late).select(F.col(KEY).cast("string").alias(KEY), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col("flux").cast("double").alias("flux"), ts)
    return rows.groupBy(KEY).applyInPandasWithState(_series(round(gap_days * DAY_US)), _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def settle_now(stream: DataFrame, folder: str, gap_days: float, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """(target_id, n, n_gaps, longest_gap_days, noise, n_late) after all that stream has now; called again with its folder, it goes on with what is new."""
    spark = stream.sparkSession
    name, provider = PROVIDER
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        keep = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")  # noqa: E731  a batch that is repeated replaces itself
        query = gaps_and_noise(stream, gap_days, late, ts).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    newest = spark.read.schema(_OUT + ", epoch bigint").parquet(f"{folder}/rows").groupBy(KEY).agg(F.max_by(F.struct("n", "n_gaps", "longest_gap_days", "noise", "n_late"), F.struct("epoch", "n")).alias("x"))
    return newest.select(KEY, "x.*")


def window_sketches(stream: DataFrame, window: str = "1 day", late: str = "1 hour", ts: str = "ts", k: int = 400) -> DataFrame:
    """(window, target_id, n, sketch): a mergeable quantile sketch of finite flux for every window of event time; for a stream or a table."""
    f = over_finite("flux")
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("window"), KEY).agg(F.count(f).alias("n"), F.kll_sketch_agg_double(f, k).alias("sketch"))


def approximate_quantiles(sketches: DataFrame, wanted: tuple[float, ...] = (0.25, 0.5, 0.75), *keys: str) -> DataFrame:
    """(keys, n, approx_quantiles): sketches of windows merged over keys, by default over each target. Ranks are off by about 1 % at the default k."""
    merged = sketches.filter("n > 0").groupBy(*(keys or (KEY,))).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_s"))
    return merged.withColumn("approx_quantiles", F.array(*(F.kll_sketch_get_quantile_double("_s", F.lit(float(q))) for q in wanted))).drop("_s")
