"""Writers of curves, windows and reports."""

from __future__ import annotations

import json
from itertools import groupby
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import windows_to_arrays


def write_curves(lc: DataFrame, path: str, mode: str = "overwrite", buckets: int = 256) -> None:
    """Parquet in folders by a hash of the target: one shuffle on the key, so a target is in one file, sorted, and a reader of some targets prunes folders by target_bucket and row groups by target_id.

    A folder a target would be as many folders as targets; raise buckets with the data so that a folder holds a GB or so.
    """
    _bucketed(lc, buckets).sortWithinPartitions("target_bucket", "target_id", "seq").write.mode(mode).partitionBy("target_bucket").parquet(path)


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("target_bucket", target_bucket(F.col("target_id"), buckets)).repartition("target_bucket")


def target_bucket(target: Column, buckets: int = 256) -> Column:
    """The folder that write_curves and write_windows put a target in."""
    return F.pmod(F.xxhash64(target), F.lit(buckets)).cast("int")


def write_windows(windows: DataFrame, path: str, mode: str = "overwrite", buckets: int = 256) -> None:
    """As write_curves."""
    _bucketed(windows, buckets).sortWithinPartitions("target_bucket", "target_id", "idx").write.mode(mode).partitionBy("target_bucket").parquet(path)


def write_json_lines(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A line per target; for any number of targets."""
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).write.mode(mode).text(path)


def export_npy(lc: DataFrame, folder: str) -> None:
    """A two-column .npy file per target in a folder of the driver: one job sorts the curves, and the driver holds one at a time."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    ordered = lc.select("target_id", "seq", "time", "flux").orderBy("target_id", "seq").toLocalIterator()
    for target, rows in groupby(ordered, key=lambda r: r["target_id"]):
        np.save(f"{folder}/{target}.npy", np.array([(r["time"], r["flux"]) for r in rows], np.float64))


def _plain(x):
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return None if isinstance(x, float) and not np.isfinite(x) else x


def write_json(content: dict, path: str) -> None:
    """Indented JSON; numbers that are not finite become null."""
    Path(path).write_text(json.dumps(_plain(content), indent=2, default=str))


def write_target_files(folder: str, lc: DataFrame, statistics: dict, metadata: dict, report: dict, windows: DataFrame | None = None) -> list[str]:
    """The five files of one target, on the driver: processed.csv, statistics.json, metadata.json, preprocessing_report.json, windows.npz."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    lc.orderBy("seq").select("time", "flux").toPandas().to_csv(f"{folder}/processed.csv", index=False)
    for name, content in (("statistics", statistics), ("metadata", metadata), ("preprocessing_report", report)):
        write_json(content, f"{folder}/{name}.json")
    names = ["processed.csv", "statistics.json", "metadata.json", "preprocessing_report.json"]
    if windows is not None:
        flux, time, ids = windows_to_arrays(windows)
        if len(ids):
            np.savez_compressed(f"{folder}/windows.npz", flux=flux, time=time, window_ids=np.array(ids))
            names.append("windows.npz")
    return names
