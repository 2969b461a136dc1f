"""The preprocessing plan: ten stages over all curves at once.

Stages are lazy and share one exchange on target_id; what the stage log records as time is the time to plan, but for
save_output, whose writes run. Rows of stages come from observations, which the jobs that run anyway fill in, or, if asked
for, from counts, a job each. Windows and statistics see the flux before augmentation.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import KEY, resequence
from ..operators.augment import augment
from ..operators.detrend import detrend
from ..operators.missing import fill_counts, fill_missing
from ..operators.normalize import normalization_params, normalize
from ..operators.outliers import outlier_stats, remove_outliers
from ..operators.quality import validation_report
from ..operators.statistics import light_curve_statistics
from ..operators.windows import generate_windows
from ..sources import target_files
from ..sources.adapters import load_input
from ..sources.sinks import write_curves, write_json_lines, write_target_files, write_windows
from .config import Config

log = logging.getLogger(__name__)
STAGES = ("load_data", "validate", "handle_missing_values", "remove_outliers", "normalize", "detrend", "window_generation", "statistics", "augmentation", "save_output")


# The names of a log entry's fields, which are written to reports.
@dataclass
class StageLog:
    stage_name: str
    execution_time_sec: float = 0.0
    n_samples: int | None = None
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    config_used: dict = field(default_factory=dict)
    observed: dict = field(default_factory=dict)


@dataclass
class Result:
    """Lazy tables of all curves, and the log."""

    raw: DataFrame
    validation: DataFrame
    filled: DataFrame
    fill_counts: DataFrame
    cleaned: DataFrame
    outlier_stats: DataFrame
    normalization_params: DataFrame
    processed: DataFrame
    windows: DataFrame
    statistics: DataFrame
    final: DataFrame
    stages: list[StageLog]
    metadata: dict = field(default_factory=dict)

    def report(self) -> DataFrame:
        """A row per target: validation, statistics, outliers, parameters and the number of windows."""
        structs = [df.select(KEY, F.struct(*[c for c in df.columns if c != KEY]).alias(n)) for df, n in ((self.validation, "validation"), (self.statistics, "statistics"), (self.outlier_stats, "outliers"), (self.normalization_params, "normalization"))]
        out = structs[0]
        for s in structs[1:]:
            out = out.join(s, KEY, "left")
        return out.join(self.windows.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_windows")), KEY, "left").fillna(0, ["n_windows"])


class Preprocessing:
    def __init__(self, config: Config | None = None, count: bool = False, persist: bool = False, observe: bool = False):
        """count takes each stage's number of samples by a job. observe takes it, and the missing ones, in the jobs that run anyway; see observed. persist keeps the filled and the processed curves, on memory or disk,
        for callers that read several tables of a result; without it every table runs the plan from its source."""
        self.config, self.count, self.persist, self.observe = config or Config(), count, persist, observe
        self._seen: dict[str, Observation] = {}
        self.stages: list[StageLog] = []

    @contextmanager
    def _stage(self, name: str, used=None) -> Iterator[StageLog]:
        entry = StageLog(name, config_used=asdict(used) if used is not None else {})
        began = time.perf_counter()
        try:
            yield entry
        except Exception as e:
            entry.errors.append(str(e))
            raise
        finally:
            entry.execution_time_sec = time.perf_counter() - began
            self.stages.append(entry)
            log.info("%s: %.3f s", name, entry.execution_time_sec)

    def _counted(self, entry: StageLog, df: DataFrame) -> DataFrame:
        if self.observe:
            self._seen[entry.stage_name] = seen = Observation()
            missing = [F.count_if(F.col("flux").isNull()).alias("n_missing")] if dict(df.dtypes)["flux"] == "double" else []
            df = df.observe(seen, F.count(F.lit(1)).alias("n_samples"), *missing)
        if self.count:
            entry.n_samples = df.count()
        return df

    def observed(self, *stages: str) -> list[StageLog]:
        """The log with what the first job over each stage has seen of it, without a job of its own.

        Call it when such a job has ended: for a stage that none has read, it waits. By default it asks all stages but
        the windows, which the processed curves do not go through.
        """
        for entry in self.stages:
            name = entry.stage_name
            if name in self._seen and name in (stages or set(STAGES) - {"window_generation"}):
                entry.observed = self._seen[name].get
                entry.n_samples = entry.observed["n_samples"]
        return self.stages

    def _kept(self, df: DataFrame) -> DataFrame:
        return df.persist() if self.persist else df

    def run(self, lc: DataFrame, training: bool = True, save_to: str | None = None, metadata: dict | None = None) -> Result:
        """All stages in order. Curves that validation finds invalid go on; rows that are not finite go with the outliers."""
        c = self.config
        self.stages, self._seen = [], {}
        with self._stage("load_data") as s:
            raw = self._counted(s, lc.select("target_id", "mission", "seq", "time", "flux"))
        with self._stage("validate"):
            validation = validation_report(raw)
        with self._stage("handle_missing_values", c.missing_values) as s:
            filled = self._counted(s, self._kept(fill_missing(raw, c.missing_values.strategy)))
            counts = fill_counts(raw, filled)
        with self._stage("remove_outliers", c.outliers) as s:
            o = asdict(c.outliers)
            method = o.pop("method")
            cleaned = self._counted(s, resequence(remove_outliers(filled, method, **o)))
            removed = outlier_stats(filled, cleaned, method)
        with self._stage("normalize", c.normalization) as s:
            normalized = self._counted(s, normalize(cleaned, c.normalization.method))
            params = normalization_params(cleaned, c.normalization.method)
        with self._stage("detrend", c.detrending) as s:
            processed = normalized
            if c.detrending.enabled:
                d = asdict(c.detrending)
                d.pop("enabled")
                processed = detrend(normalized, d.pop("method"), d.pop("mode"), **d)
            processed = self._counted(s, self._kept(processed))
        with self._stage("window_generation", c.windowing) as s:
            windows = self._counted(s, generate_windows(processed, c.windowing.window_size, c.windowing.overlap, c.windowing.padding_mode))
        with self._stage("statistics"):
            statistics = light_curve_statistics(processed)
        with self._stage("augmentation") as s:
            final = self._counted(s, augment(processed, c.augmentation.steps, training, c.augmentation.enabled, c.random_seed))
        result = Result(raw, validation, filled, counts, cleaned, removed, params, processed, windows, statistics, final, self.stages, metadata or {})
        with self._stage("save_output", c.output) as s:
            if save_to:
                writes = {"processed": lambda: write_curves(final, f"{save_to}/processed"), "report": lambda: write_json_lines(result.report(), f"{save_to}/report")}
                if c.output.save_windows:
                    writes["windows"] = lambda: write_windows(windows, f"{save_to}/windows")
                for name, write in writes.items():
                    began = time.perf_counter()
                    write()
                    s.observed[f"{name}_sec"] = time.perf_counter() - began
        if save_to and self.observe:
            self.observed(*(set(STAGES) if c.output.save_windows else ()))
        return result

    def run_from_source(self, spark: SparkSession, data, training: bool = True, save_to: str | None = None, target_id: str | None = None, mission: str | None = None, **columns: str) -> Result:
        """run on any supported input. Names given here go before those in the input; else they are unknown."""
        lc, meta = load_input(spark, data, target_id=target_id, mission=mission, **columns)
        return self.run(lc, training, save_to, meta)

    def save_targets(self, result: Result, folder: str) -> None:
        """Files of all targets, written by the tasks that hold their rows: a CSV file each, an npz file each if windows are saved, and reports as JSON lines."""
        target_files.write_csv(result.final, f"{folder}/curves")
        if self.config.output.save_windows:
            target_files.write_windows(result.windows, f"{folder}/windows")
        write_json_lines(result.report(), f"{folder}/report")

    def save_target(self, result: Result, target_id: str, folder: str | None = None) -> list[str]:
        """The files of one target, as people exchange them."""
        own = lambda df: df.filter(F.col(KEY) == target_id)
        first = lambda df: (lambda r: r.asDict(recursive=True) if r else {})(own(df).first())
        params, removed, stats = first(result.normalization_params), first(result.outlier_stats), first(result.statistics)
        metadata = {"target_id": target_id, **result.metadata, "n_final_samples": own(result.final).count(), "normalization_params": params, "outlier_stats": removed}
        windows = own(result.windows) if self.config.output.save_windows else None
        report = {**metadata, "validation": first(result.validation), "statistics": stats, "stages": [asdict(s) for s in result.stages], "n_windows": own(result.windows).count()}
        return write_target_files(folder or f"{self.config.output.processed_dir}/{target_id}", own(result.final), stats, metadata, report, windows)
