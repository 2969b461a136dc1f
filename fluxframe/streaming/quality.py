"""Quality of light curves as they arrive.

Exact medians do not add up over batches, so what a stream reports is either exact and additive, per window of event time
and target with late rows bounded by a watermark, or the batch report of each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.expr import INFINITY, KEY, count_where, over_finite
from ..operators.quality import validation_report


def windowed_quality(stream: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """(window, target_id, n, n_missing, n_infinite, mean_flux, std_flux, min_flux, max_flux, approx_median) of stream(target_id, ts, flux)."""
    f = over_finite("flux")
    over = F.window(ts, window, slide) if slide else F.window(ts, window)
    return stream.withWatermark(ts, late).groupBy(over.alias("window"), KEY).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("flux").isNull()).alias("n_missing"), count_where(F.abs("flux") == INFINITY).alias("n_infinite"),
        F.avg(f).alias("mean_flux"), F.stddev_pop(f).alias("std_flux"), F.min(f).alias("min_flux"), F.max(f).alias("max_flux"), F.percentile_approx(f, 0.5).alias("approx_median"),
    )


def sessions(stream: DataFrame, gap: str = "2 days", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """(session, target_id, n): runs of samples without a gap in event time, the streaming form of observation gaps."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("session"), KEY).agg(F.count(F.lit(1)).alias("n"))


def report_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A query that hands sink the exact report of every micro-batch of stream(target_id, mission, seq, time, flux)."""
    return stream.writeStream.foreachBatch(lambda batch, epoch: sink(validation_report(batch), epoch)).option("checkpointLocation", checkpoint).start()
