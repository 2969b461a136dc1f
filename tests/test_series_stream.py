"""State of a target over batches, late rows and a restart; sketches of windows."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from fluxframe.streaming import series

START = dt.datetime(2024, 1, 1)


def rows_of(rng, target, n):
    hours = np.cumsum(rng.choice([0.5, 1, 1, 1, 9], n))
    flux = rng.normal(10, 1, n)
    return [(target, START + dt.timedelta(hours=float(h)), None if rng.random() < 0.05 else float(f)) for h, f in zip(hours, flux, strict=True)]


def ordered(rows, mark, gap_hours):
    out = {}
    for target in {r[0] for r in rows}:
        own = sorted(((t, f) for k, t, f in rows if k == target and t <= mark), key=lambda x: x[0])
        spaces = [(b[0] - a[0]).total_seconds() / 3600 for a, b in zip(own, own[1:], strict=False)]
        fluxes = [f for _, f in own if f is not None]
        out[target] = (len(own), sum(s > gap_hours for s in spaces), round(max(spaces) / 24, 9), round(float(np.std(np.diff(fluxes))) / 2**0.5, 9))
    return out


def test_gaps_and_noise_over_late_rows_and_a_restart(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = rows_of(rng, "a", 120) + rows_of(rng, "b", 150)
    rows.sort(key=lambda r: r[1])
    # within blocks of two hundred minutes rows arrive in any order
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1] - START).total_seconds() / 12000 + rng.random())
    schema = "target_id string, ts timestamp, flux double"
    files = np.array_split(np.array(order), 6)
    far = [("a", START, 1.0)]  # far behind the watermark

    def put(i, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/f{i}")

    def run():
        spark.conf.set(*series.PROVIDER)
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        seen = lambda batch, epoch: found.update({r["target_id"]: r for r in batch.collect()})
        q = series.gaps_and_noise(stream, 5 / 24, "8 hours").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(seen).start()
        q.processAllAvailable()
        q.stop()

    found = {}
    for i in range(3):
        put(i, [rows[j] for j in files[i]])
    run()
    assert set(found) == {"a", "b"} and all(r["n"] > 10 for r in found.values())
    for i in range(3, 6):
        put(i, [rows[j] for j in files[i]])
    put(6, far + [("b", rows[-1][1] + dt.timedelta(days=9), 5.0)])  # moves the watermark past everything before
    run()
    put(7, [("c", rows[-1][1] + dt.timedelta(days=9), 5.0)])
    run()
    want = ordered(rows, rows[-1][1], 5)
    got = {k: (r["n"], r["n_gaps"], round(r["longest_gap_days"], 9), round(r["noise"], 9)) for k, r in found.items() if k != "c"}
    assert got == want
    assert found["a"]["n_late"] + found["b"]["n_late"] <= 1


def test_sketches_of_windows_merge(spark):
    rng = np.random.default_rng(6)
    rows = [("t" + str(i % 2), START + dt.timedelta(minutes=i), float(f)) for i, f in enumerate(rng.exponential(3, 20_000))] + [("t0", START, None), ("t1", START, float("inf"))]
    df = spark.createDataFrame(rows, "target_id string, ts timestamp, flux double")
    sketches = series.window_sketches(df)
    assert sketches.count() == 2 * 14
    for r in series.approximate_quantiles(sketches, (0.1, 0.5, 0.9)).collect():
        own = np.sort([f for t, _, f in rows if t == r["target_id"] and f is not None and np.isfinite(f)])
        assert r["n"] == len(own)
        assert all(abs(np.searchsorted(own, v) / len(own) - q) < 0.012 for v, q in zip(r["approx_quantiles"], (0.1, 0.5, 0.9), strict=True))
    assert {r["n"] for r in series.approximate_quantiles(sketches, (0.5,), "window").agg(F.sum("n").alias("n")).collect()} == {20_000}


def test_state_travels_with_rows_and_a_row_at_the_watermark_is_passed(spark, tmp_path):
    rows = [("a", START, 1.0), ("b", START + dt.timedelta(hours=-2), 3.0), ("b", START + dt.timedelta(milliseconds=1), None), ("c", START + dt.timedelta(hours=1), 5.0)]
    schema = "target_id string, ts timestamp, flux double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    plan = series.gaps_and_noise(stream, 1.0)._jdf.queryExecution().analyzed().toString()
    found = series.settle_now(stream, f"{tmp_path}/out", 1.0)
    assert sorted((r.target_id, r.n) for r in found.collect()) == [("a", 1), ("b", 1)]
    assert "FlatMapGroupsInPandasWithState" in plan
