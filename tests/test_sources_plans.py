import gzip
import json
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from curves import clean, flux, frame, messy
from pyspark.sql import functions as F

from fluxframe.operators import catalog, metrics, models
from fluxframe.operators.augment import DEFAULTS
from fluxframe.plans import config as cfg
from fluxframe.plans.detect import detect, run, score_windows, train
from fluxframe.plans.preprocess import STAGES, Preprocessing
from fluxframe.sources import adapters, archive, sinks
from fluxframe.streaming import quality as stream_quality

T, X = np.arange(100.0), 1 + 0.001 * np.sin(np.arange(100.0))


@pytest.mark.parametrize("names", [("time", "flux"), ("BJD", "PDCSAP_FLUX"), ("x", "y")])
def test_tables(spark, tmp_path, names):
    pdf = pd.DataFrame({names[0]: T, names[1]: X})
    given = {"time_col": "x", "flux_col": "y"} if names[0] == "x" else {}
    if given:
        with pytest.raises(ValueError):
            adapters.load_input(spark, pdf)
    pdf.to_csv(tmp_path / "star.csv", index=False)
    spark.createDataFrame(pdf).coalesce(1).write.parquet(f"{tmp_path}/star.parquet")
    for data, kind in ((pdf, "dataframe"), (str(tmp_path / "star.csv"), "csv"), (spark.createDataFrame(pdf), "spark"), (f"{tmp_path}/star.parquet", "parquet")):
        lc, meta = adapters.load_input(spark, data, **given)
        assert meta["source_type"] == kind and np.allclose(flux(lc), X)
    assert adapters.read_csv(spark, str(tmp_path / "star.csv"), **given).first().target_id == "star"


def test_arrays_and_objects(spark):
    for data in ((T, X), np.stack([T, X], axis=1), SimpleNamespace(time=SimpleNamespace(value=T), flux=SimpleNamespace(value=X), targetid=7, mission="M")):
        lc, meta = adapters.load_input(spark, data)
        assert np.allclose(flux(lc), X)
    assert (meta["target_id"], meta["mission"]) == ("7", "M")
    assert adapters.load_input(spark, (T, X), target_id="mine")[0].first().target_id == "mine"
    for bad in ("a.txt", 5, np.ones((3, 3))):
        with pytest.raises(ValueError):
            adapters.detect_input_type(bad)
    with pytest.raises(ValueError):
        adapters.load_input(spark, (T, X[:5]))


def test_text_numbers_and_binary_files(spark, tmp_path):
    (tmp_path / "odd.csv").write_text("time,flux\n0,1\n1,\n2,nan\n3,inf\n4,-inf\n5,x\n")
    assert [r.flux for r in adapters.read_csv(spark, str(tmp_path / "odd.csv")).orderBy("seq").collect()] == [1.0, None, None, float("inf"), float("-inf"), None]
    np.save(tmp_path / "b.npy", np.stack([T, X], axis=1))
    assert np.allclose(flux(adapters.load_input(spark, str(tmp_path / "b.npy"))[0]), X)
    content = adapters.write_fits(T, X, "KIC 1", "Kepler")
    (tmp_path / "c.fits").write_bytes(content)
    (tmp_path / "d.fits.gz").write_bytes(gzip.compress(content))
    for name in ("c.fits", "d.fits.gz"):
        lc, meta = adapters.load_input(spark, str(tmp_path / name))
        assert np.allclose(flux(lc), X, atol=1e-6) and lc.first().target_id == "KIC 1" and lc.first().mission == "Kepler"
    with pytest.raises(ValueError):
        adapters.parse_npy((lambda b: (np.save(b, np.ones(3)), b.getvalue())[1])(__import__("io").BytesIO()))


def test_sinks(spark, tmp_path):
    lc = frame(spark, a=(T, X), b=(T[:9], X[:9]))
    sinks.write_curves(lc, f"{tmp_path}/lc")
    assert np.allclose(flux(spark.read.parquet(f"{tmp_path}/lc"), "b"), X[:9])
    sinks.export_npy(lc, f"{tmp_path}/npy")
    assert np.load(f"{tmp_path}/npy/a.npy").shape == (100, 2)


def test_download():
    calls = []

    def fetch(name):
        calls.append(name)
        if len(calls) < 3:
            raise OSError("spoilt")
        return name

    assert archive.download(fetch, "x", repair=lambda e: None) == "x" and len(calls) == 3
    with pytest.raises(OSError):
        archive.download(lambda n: (_ for _ in ()).throw(OSError("gone")), "x")


def test_download_all_isolates_failures(spark):
    def fetch(name):
        if name == "bad":
            raise OSError("gone")
        return frame(spark, **{name: (T, X * 50)}).withColumn("segment", (F.col("seq") > 40).cast("int"))

    lc, failed = archive.download_all(spark, fetch, ["a", "bad", "b"])
    assert {r.target_id for r in lc.select("target_id").distinct().collect()} == {"a", "b"} and [tuple(r) for r in failed.collect()] == [("bad", "gone")]
    assert abs(np.median(flux(lc, "a")) - 1) < 1e-3


def test_config(tmp_path):
    assert cfg.load_config(None) == cfg.load_config(tmp_path / "absent.yaml") == cfg.Config()
    assert cfg.Config().windowing.stride == 500
    p = tmp_path / "c.yaml"
    p.write_text("")
    assert cfg.load_config(p) == cfg.Config()
    p.write_text("outliers:\nmissing_values: {strategy: cubic, other: 1}\naugmentation: {enabled: true, gaussian_noise: {sigma_range: [1, 2]}, time_shift: 3}\nwindowing: {window_size: '64'}\n")
    c = cfg.load_config(p)
    assert c.missing_values.strategy == "cubic" and c.windowing.window_size == 64 and c.outliers == cfg.Outliers()
    assert c.augmentation.steps["gaussian_noise"].params == {"sigma_range": (1, 2)} and c.augmentation.steps["time_shift"] == DEFAULTS["time_shift"]
    p.write_text("a: [")
    with pytest.raises(ValueError):
        cfg.load_config(p)


def test_preprocessing(spark, tmp_path):
    c = cfg.Config(windowing=cfg.Windowing(500, 0.5), augmentation=cfg.Augmentation(True), detrending=cfg.Detrending(True, "running_median", running_median_window=11, mode="subtract"))
    plan = Preprocessing(c, count=True, persist=True)
    result = plan.run(frame(spark, a=messy(), b=clean()), save_to=f"{tmp_path}/out")
    assert tuple(s.stage_name for s in plan.stages) == STAGES and plan.stages[0].n_samples == 7000
    assert result.final.count() == result.processed.count() <= 7000 and np.isfinite(flux(result.final, "a")).all()
    report = {r.target_id: r for r in result.report().collect()}
    assert report["a"].n_windows >= 7 and report["a"].validation.missing_value_pct == 0.5
    assert spark.read.parquet(f"{tmp_path}/out/windows").count() == result.windows.count()
    assert sorted(json.loads(r.value)["target_id"] for r in spark.read.text(f"{tmp_path}/out/report").collect()) == ["a", "b"]
    plan.save_targets(result, f"{tmp_path}/all")
    assert sorted(p.name for p in (tmp_path / "all").rglob("[ab].*")) == ["a.csv", "a.npz", "b.csv", "b.npz"]
    names = plan.save_target(result, "a", f"{tmp_path}/a")
    assert all((Path(tmp_path) / "a" / n).exists() for n in names) and len(names) == 5
    assert len(pd.read_csv(f"{tmp_path}/a/processed.csv")) == json.loads((tmp_path / "a/metadata.json").read_text())["n_final_samples"]
    same = Preprocessing(c).run(frame(spark, a=messy())).final
    assert np.allclose(flux(same, "a"), flux(result.final, "a"))
    bad = Preprocessing(cfg.Config(outliers=cfg.Outliers("magic")))
    with pytest.raises(ValueError):
        bad.run(frame(spark, a=messy()))
    assert bad.stages[-1].stage_name == "remove_outliers" and bad.stages[-1].errors
    got = Preprocessing().run_from_source(spark, clean(), target_id="mine")
    assert got.metadata["target_id"] == "mine" and got.windows.first().target_id == "mine"


def test_training_scoring_and_models(spark, tmp_path):
    trained = train(spark, 200, 101)
    m = trained.metrics.first()
    assert m.accuracy >= 0.5 and 0 <= m.auc_roc <= 1 and m.true_positives + m.false_negatives == 20
    w = spark.createDataFrame([("a", [0.0] * 101)], "target_id string, flux array<double>")
    assert 0 <= score_windows(trained, w).first().y_prob <= 1
    trained.denoiser.save(f"{tmp_path}/pca")
    again = models.Denoiser.load(f"{tmp_path}/pca")
    a, b = (np.array(d.transform(w.withColumn("noisy", F.transform("flux", lambda x: x + 1))).first().denoised) for d in (trained.denoiser, again))
    assert np.allclose(a, b) and len(a) == 101
    assert models.padded_length(2001) == 2004 and len(w.select(models.pad_right(F.col("flux"), 101).alias("x")).first().x) == 104
    with pytest.raises(RuntimeError):
        models.Denoiser().transform(w, "flux")
    x = np.random.default_rng(3).normal(size=(2, 101))
    two = trained.denoiser.denoise(spark, x)
    assert two.shape == (2, 101) and np.allclose(trained.denoiser.denoise(spark, x[0]), two[0]) and np.allclose(trained.denoiser.denoise(spark, x[:, :, None])[:, :, 0], two)
    with pytest.raises(ValueError):
        trained.denoiser.denoise(spark, np.zeros((1, 2, 3)))
    d = spark.createDataFrame([([float(i % 7)], int(i % 10 == 0)) for i in range(100)], "features array<double>, label int")
    light, heavy = (models.predict(models.train_classifier(d, "perceptron", {0: 1.0, 1: k}), d).agg(F.avg("y_prob")).first()[0] for k in (1.0, 9.0))
    assert light < 0.25 < heavy  # weights move the perceptron as they do the regression

    t = np.linspace(0, 30, 3000)
    f = np.ones(3000) + np.random.default_rng(2).normal(0, 1e-4, 3000)
    f[np.abs(t / 2.204737 - np.round(t / 2.204737)) * 2.204737 < 0.075] -= 0.00618

    def fetch(name):
        if name == "gone":
            raise OSError("gone")
        return frame(spark, **{name: (t, f)}).withColumn("segment", F.lit(0))

    out = run(spark, trained, fetch=fetch, targets=["HAT-P-7b", "gone"], config=cfg.Config(windowing=cfg.Windowing(101, 0.5), outliers=cfg.Outliers(sigma_threshold=50.0)), periods=(2.0, 2.4, 201), durations=(0.1, 0.15))
    rows = {r.target: r for r in out.benchmark.collect()}
    assert rows["HAT-P-7b"].overall_pass and 0 <= rows["HAT-P-7b"].confidence <= 1 and rows["Kepler-22b"].error == "Data not found"
    assert [r.target_id for r in out.failures.collect()] == ["gone"] and out.windows.count() == 60

    def segments(name):
        if name == "gone":
            raise OSError("gone")
        return [("m", t, f)]

    names = spark.createDataFrame([("HAT-P-7b",), ("gone",)], "target_id string")
    same = run(spark, trained, fetch=segments, targets=names, config=cfg.Config(windowing=cfg.Windowing(101, 0.5), outliers=cfg.Outliers(sigma_threshold=50.0)), periods=(2.0, 2.4, 201), durations=(0.1, 0.15))
    (a,), (b,) = (x.detections.drop("target_id").collect() for x in (same, out))
    assert np.allclose([float(v) for v in a], [float(v) for v in b]) and [r.error for r in same.failures.collect()] == ["OSError: gone"]
    with pytest.raises(ValueError):
        run(spark, trained)


def test_metrics_on_edges(spark):
    one = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.1)], "y_true int, y_pred int, y_prob double")
    m = metrics.all_metrics(one).first()
    assert (m.accuracy, m.precision, m.recall) == (0.5, 1.0, 0.5) and m.auc_roc is None and m.average_precision == 1.0
    same = metrics.all_metrics(one.filter("y_pred = 1")).first()
    assert same.specificity is None and same.true_positives is None
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 500), np.round(rng.random(500), 2)
    d = spark.createDataFrame(pd.DataFrame({"y_true": y, "y_pred": (p >= 0.5).astype(int), "y_prob": p}))
    pairs = [(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]]
    assert metrics.roc_auc(d).first()[0] == pytest.approx(np.mean(pairs))
    assert "Transit" in metrics.metrics_report(d)


def test_benchmark(spark):
    t = np.linspace(0, 30, 3000)
    f = np.ones(3000) + np.random.default_rng(2).normal(0, 1e-4, 3000)
    f[np.abs(t / 2.204737 - np.round(t / 2.204737)) * 2.204737 < 0.075] -= 0.00618
    lc = frame(spark, **{"HAT-P-7b": (t, f)})
    table = catalog.benchmark_table(lc, catalog.catalog(spark), lambda d: detect(d, 2.0, 2.4, 201, (0.1, 0.15)))
    rows = {r.target: r for r in table.collect()}
    assert rows["HAT-P-7b"].overall_pass and rows["HAT-P-7b"].depth_pass and rows["Kepler-22b"].error == "Data not found"
    text = catalog.benchmark_report(table)
    assert "1 of 5 targets pass" in text and any(x.startswith("HAT-P-7b") and "pass" in x for x in text.splitlines())
    assert "0 of 0" in catalog.benchmark_report(table.limit(0))


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").cast("string").alias("target_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("flux"))
    events.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = stream_quality.windowed_quality(stream, "10 days").writeStream.outputMode("complete").format("memory").queryName("quality").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("quality").groupBy("target_id").agg(F.sum("n").alias("n")).collect()
    assert {r.target_id: r.n for r in got} == {r.target_id: r["count"] for r in events.groupBy("target_id").count().collect()}
    lc = frame(spark, a=(T, X))
    lc.write.parquet(f"{tmp_path}/lc")
    seen = []
    q = stream_quality.report_batches(spark.readStream.schema(lc.schema).parquet(f"{tmp_path}/lc"), lambda df, epoch: seen.extend(df.collect()), f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert [(r.target_id, r.n_observations) for r in seen] == [("a", 100)]
    s = stream_quality.sessions(stream, "3 days").writeStream.outputMode("complete").format("memory").queryName("sessions").start()
    s.processAllAvailable()
    s.stop()
    assert spark.table("sessions").agg(F.sum("n")).first()[0] == events.count()


def test_known_parameters(spark):
    def ask(query):
        if "HAT" in query:
            raise OSError("gone")
        return [{"pl_name": "Kepler-22 b", "pl_orbper": 289.9, "pl_trandep": None, "pl_rade": 2.4}] if "'Kepler-22 b'" in query else []

    names = spark.createDataFrame([("Kepler-22b",), ("HAT-P-7b",), ("kepler-4",), ("nothing",), (None,)], "planet string")
    got = {r.planet: r for r in catalog.known_parameters(names, catalog.catalog(spark), ask).collect()}
    assert (got["Kepler-22b"].origin, got["Kepler-22b"].period_days, got["Kepler-22b"].depth_ppm, got["Kepler-22b"].planet_radius_earth) == ("archive", 289.9, None, 2.4)
    assert (got["HAT-P-7b"].origin, got["HAT-P-7b"].period_days) == ("catalog", 2.204737) and got["kepler-4"].planet_name == "Kepler-452b"
    assert got["nothing"].origin is None and got[None].origin is None and len(got) == 5
    assert catalog.known_parameters(names, catalog.catalog(spark)).filter("origin = 'archive'").count() == 0


def test_fits_scaling():
    content = adapters.write_fits(np.arange(3.0), np.ones(3), "a", "m")
    card = lambda k, v: f"{k:<8}= {v:>20}".ljust(80).encode()
    end = content.rindex(b"END" + b" " * 77)
    scaled = content[:end] + card("TZERO1", "2454833.0") + card("TSCAL3", "0.5") + card("TZERO3", "1.D1") + content[end : len(content) - 240]
    at = scaled.rindex(b"END" + b" " * 77)
    body = content[end:][(2880 - end % 2880) :]
    scaled = scaled[: at + 80].ljust(-(-(at + 80) // 2880) * 2880) + body
    table, _ = adapters.parse_fits(scaled)
    assert table[:, 0].tolist() == [2454833.0, 2454834.0, 2454835.0] and table[:, 1].tolist() == [10.5] * 3


def test_fetch_in_tasks(spark, tmp_path):
    folder = str(tmp_path)

    def fetch(target):
        i = int(target)
        if i % 100 == 7:
            raise OSError("gone")
        if i % 100 == 8:  # fails until it was repaired
            if not Path(f"{folder}/{target}").exists():
                raise ValueError("spoilt")
        if i % 100 == 9:
            yield "m", np.arange(3.0), np.arange(2.0)
        yield "m", np.arange(3.0), np.full(3, 2.0)
        yield "m", 10 + np.arange(2.0), np.array([4.0, np.nan])

    def repair(target, error):
        if "spoilt" in str(error):
            Path(f"{folder}/{target}").touch()

    targets = spark.range(1000).select(F.col("id").cast("string").alias("target_id"))
    segments, failures = archive.fetch_in_tasks(targets.union(targets.limit(5)), fetch, repair=repair, attempts=3, tasks=8)
    bad = {r.target_id: (r.attempts, r.error) for r in failures.collect()}
    assert len(bad) == 20 and bad["107"] == (3, "OSError: gone") and bad["109"][1].startswith("ValueError: time and flux length mismatch")
    assert segments.count() == 980 * 5 and segments.select("target_id").distinct().count() == 980
    sizes = [len(archive.fetch_in_tasks(targets.limit(n), fetch, attempts=1)[0]._jdf.queryExecution().logical().toString()) for n in (2, 900)]
    assert abs(sizes[0] - sizes[1]) < 100  # the plan does not grow with the targets
    own = archive.curves_of(segments.filter("target_id = '1'")).orderBy("seq").collect()
    assert [(r.seq, r.time, r.flux) for r in own] == [] or all(r.flux == 1.0 for r in own)


def test_stages_are_observed_by_the_jobs_that_run(spark, tmp_path):
    lc = frame(spark, a=messy(), b=(T, X))
    plain = Preprocessing(count=True)
    plain.run(lc)
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("observing"))
    plan = Preprocessing(observe=True)
    spark.sparkContext.setJobGroup("observing", "")
    try:
        result = plan.run(lc, save_to=str(tmp_path))
        saved = jobs()
        log = {s.stage_name: s for s in plan.observed("load_data", "handle_missing_values", "remove_outliers")}
        assert jobs() == saved
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {n: s.n_samples for n, s in log.items()} == {s.stage_name: s.n_samples for s in plain.stages}
    assert log["load_data"].observed["n_missing"] > 0 == log["handle_missing_values"].observed["n_missing"]
    assert set(log["save_output"].observed) == {"processed_sec", "report_sec", "windows_sec"} and result.final.count() == log["augmentation"].n_samples


def test_tasks_of_curves_follow_the_rows(spark, monkeypatch):
    from fluxframe import queries
    from fluxframe.sources import adapters

    few = queries.curves(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(adapters, "ROWS_A_TASK", 100)
    many = queries.curves(spark, "/root/testdata/sf0.001")
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and ", 10), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, many.collect()), key=str) == sorted(map(tuple, few.collect()), key=str)
