"""Training and detection from end to end: synthetic samples, denoiser, classifier, search, comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import KEY
from ..functions.state import settled
from ..operators.bls import DURATIONS, PERIODS, bounded_search, transit_features
from ..operators.catalog import benchmark_table
from ..operators.catalog import catalog as local_catalog
from ..operators.metrics import all_metrics
from ..operators.models import Denoiser, predict, train_classifier, window_features
from ..operators.synth import stratified_split, synthetic_dataset
from ..sources.archive import curves_of, download_all, fetch_in_tasks
from .config import Config
from .preprocess import Preprocessing, Result


@dataclass
class Trained:
    denoiser: Denoiser
    classifier: PipelineModel
    metrics: DataFrame


def train(spark: SparkSession, n_samples: int = 5000, window_size: int = 2001, seed: int = 42, kind: str = "logistic", samples: DataFrame | None = None) -> Trained:
    """Samples are made, or given as samples(sample_id, noisy, clean, label), split by label, denoised and classified; metrics are of the test part.

    Samples and features are computed once each and kept in the shared folder, as split, fits and metrics read them many
    times. Their number of tasks is given, since a few bytes of samples are much work.
    """
    samples = samples if samples is not None else synthetic_dataset(spark, n_samples, window_size, seed=seed)
    samples = settled(stratified_split(settled(samples.repartition(2 * spark.sparkContext.defaultParallelism, "sample_id")), seed=seed))
    denoiser = Denoiser().fit(samples.filter("not is_test"))
    ready = settled(window_features(denoiser.transform(samples), "denoised").select("sample_id", "label", "is_test", "features"))
    classifier = train_classifier(ready.filter("not is_test"), kind, seed=seed)
    scored = predict(classifier, ready.filter("is_test")).withColumnRenamed("label", "y_true")
    return Trained(denoiser, classifier, all_metrics(scored))


def score_windows(trained: Trained, windows: DataFrame) -> DataFrame:
    """windows(flux, ...) of the training length with y_prob and y_pred."""
    return predict(trained.classifier, window_features(trained.denoiser.transform(windows, "flux"), "denoised"))


def detect(lc: DataFrame, low: float, high: float, n: int, durations: tuple) -> DataFrame:
    """Detections of many curves over an even grid of periods."""
    return transit_features(lc, bounded_search(lc, low, high, n, durations))


@dataclass
class Run:
    """What run makes: lazy tables, of one row a window, a detection, a catalog target and a failed download."""

    prepared: Result
    windows: DataFrame
    detections: DataFrame
    benchmark: DataFrame
    failures: DataFrame


def run(spark: SparkSession, trained: Trained, curves: DataFrame | None = None, fetch: Callable | None = None, targets: Iterable[str] | DataFrame = (), config: Config | None = None, known: DataFrame | None = None, periods: tuple[float, float, int] = PERIODS, durations: tuple = DURATIONS) -> Run:
    """From curves, or downloads of targets by fetch, to the benchmark: preprocessing, denoised and scored windows, period search, comparison with the catalog.

    A few targets are given by name, with a fetch that returns a table of segments; any number as a table with target_id, with
    a fetch that runs in tasks (archive.fetch_in_tasks). Scored windows and preprocessed curves are computed once and kept in
    the shared folder, as search, confidence and benchmark all read them.

    Windows have to be of the length that trained was trained on. A curve's confidence is the greatest chance of a transit
    among its windows. The search reads the preprocessed curves, so a detection's depth is relative to the median.
    """
    failures = spark.createDataFrame([], "target_id string, error string")
    if curves is None:
        if fetch is None:
            raise ValueError("give curves, or fetch and targets")
        if isinstance(targets, DataFrame):
            segments, failures = fetch_in_tasks(targets, fetch)
            curves, failures = curves_of(segments), failures.select(KEY, "error")
        else:
            curves, failures = download_all(spark, fetch, targets)
    known = local_catalog(spark) if known is None else known
    prepared = Preprocessing(config).run(curves, training=False)
    windows, final = settled(score_windows(trained, prepared.windows)), settled(prepared.final)
    confidence = windows.groupBy(KEY).agg(F.max("y_prob").alias("confidence"))
    detections = detect(final, *periods, durations).join(confidence, KEY, "left")
    table = benchmark_table(curves, known, lambda lc: detections.join(lc.select(KEY).distinct(), KEY, "left_semi").select(KEY, "period", "depth", "duration_hours", "confidence"))
    return Run(prepared, windows, detections, table, failures)
