"""Downloads: the connector is the caller's; retries, stitching and isolation of failures are here."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import canonical
from ..functions.state import settled
from ..operators.outliers import clip_strict
from ..operators.synth import stitch
from ..schema import LIGHT_CURVE

log = logging.getLogger(__name__)
ATTEMPTS = 15


def download(fetch: Callable[[str], DataFrame], target: str, repair: Callable[[Exception], None] | None = None, attempts: int = ATTEMPTS) -> DataFrame:
    """Segments of a target by fetch, tried again after repair (say, of a spoilt cache); the last error is raised."""
    for k in range(attempts):
        try:
            return fetch(target)
        except Exception as e:
            if repair is None or k + 1 == attempts:
                raise
            repair(e)
    raise ValueError("attempts must be positive")


def download_all(spark: SparkSession, fetch: Callable[[str], DataFrame], targets: Iterable[str], repair: Callable[[Exception], None] | None = None, sigma: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(curves, failures): all targets stitched and clipped in one table; a target that fails is a row of failures."""
    segments, failed = None, []
    for target in targets:
        try:
            got = download(fetch, target, repair)
            segments = got if segments is None else segments.unionByName(got)
        except Exception as e:
            log.warning("%s could not be downloaded: %s", target, e)
            failed.append((target, str(e)))
    curves = clip_strict(stitch(segments), sigma).select("target_id", "mission", "seq", "time", "flux") if segments is not None else spark.createDataFrame([], LIGHT_CURVE)
    return curves, spark.createDataFrame(failed, "target_id string, error string")


#: A segment that a connector gives: mission, times and fluxes of equal length.
Segment = tuple[str, np.ndarray, np.ndarray]


def fetch_in_tasks(targets: DataFrame, fetch: Callable[[str], Iterable[Segment]], target_col: str = "target_id", repair: Callable[[str, Exception], None] | None = None, attempts: int = ATTEMPTS, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments(target_id, mission, segment, seq, time, flux), failures(target_id, attempts, error)) of any number of targets, fetched where Spark's tasks run.

    One job over one plan, whatever the number of targets: targets are dealt out, a task fetches one after the other and holds
    one at a time. A target that fails is tried again after repair where it runs; when no attempt is left it is a row of
    failures and ends nothing. What was fetched is kept in the shared folder, so reading both tables fetches once. A task that
    is lost fetches its targets again. Repeated targets are fetched once, a null one is left out.
    """
    schema = "target_id string, mission string, segment int, seq bigint, time double, flux double, attempts int, error string"
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]

    def batch(n: int, *columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c] * n if not isinstance(c, np.ndarray) else c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def one(target: str) -> Iterator[pa.RecordBatch]:
        for k in range(1, attempts + 1):
            try:
                got = []
                for i, (mission, time, flux) in enumerate(fetch(target)):
                    time, flux = np.asarray(time, float), np.asarray(flux, float)
                    if len(time) != len(flux):
                        raise ValueError(f"time and flux length mismatch: {len(time)} vs {len(flux)}")
                    got.append(batch(len(time), target, mission, i, np.arange(len(time)), time, flux, k, None))
                yield from got
                return
            except Exception as e:
                if repair is None or k == attempts:
                    yield batch(1, target, None, None, None, None, None, k, f"{type(e).__name__}: {e}")
                    return
                repair(target, e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for target in b.column(0).to_pylist():
                yield from one(target)

    wanted = targets.select(F.col(target_col).cast("string").alias("target_id")).filter("target_id is not null").distinct()
    rows = settled(wanted.repartition(tasks or 4 * targets.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema))
    segments = rows.filter("error is null").drop("attempts", "error").withColumns({"time": canonical("time"), "flux": canonical("flux")})
    return segments, rows.filter("error is not null").select("target_id", "attempts", "error")


def curves_of(segments: DataFrame, sigma: float = 5.0) -> DataFrame:
    """Segments as download_all gives them: stitched, clipped, a table of light curves."""
    return clip_strict(stitch(segments), sigma).select("target_id", "mission", "seq", "time", "flux")
