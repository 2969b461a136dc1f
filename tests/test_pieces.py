"""Curves cut into pieces, and medians found by counts, against the operators on whole curves."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxframe.operators import detrend, missing, pieces, quality, selection, windows

LC = "target_id string, mission string, seq bigint, time double, flux double"


def curve(rng, name, n):
    t = np.sort(rng.uniform(0, 50, n)).round(2)  # with equal times
    t[rng.random(n) < 0.03] = np.nan
    f = rng.normal(1, 0.1, n)
    f[rng.random(n) < 0.3] = np.nan
    f[rng.random(n) < 0.02] = np.inf
    return [(name, "m", i, None if np.isnan(a) else float(a), None if np.isnan(b) else float(b)) for i, (a, b) in enumerate(zip(t, f, strict=True))]


@pytest.fixture(scope="module")
def lc(spark):
    rng = np.random.default_rng(8)
    rows = curve(rng, "long", 700) + curve(rng, "b", 41) + curve(rng, "c", 1) + [("void", "m", i, float(i), None) for i in range(60)] + [("gap", "m", i, float(i), 1.0 if i in (3, 190) else None) for i in range(200)]
    return spark.createDataFrame(rows, LC).repartition(3).cache()


def same(a, b):
    key = lambda df: sorted(str(tuple(round(x, 9) + 0.0 if isinstance(x, float) else x for x in r)) for r in df.collect())
    assert key(a) == key(b)


@pytest.mark.parametrize("strategy", ["linear", "nearest", "ffill", "bfill"])
def test_fill(lc, strategy):
    same(pieces.fill_missing(lc, strategy, size=40), missing.fill_missing(lc, strategy))


@pytest.mark.parametrize("window", [1, 4, 15])
def test_running_median(lc, window):
    same(pieces.running_median_trend(lc, window, size=40, few=5), detrend.running_median_trend(lc, window))


@pytest.mark.parametrize("window,order", [(5, 2), (21, 3), (2, 3)])
def test_savgol(lc, window, order):
    same(pieces.savgol_trend(lc, window, order, size=50, few=5), detrend.add_trend(lc, "savgol", savgol_window=window, savgol_polyorder=order))


def test_savgol_takes_many_pieces_at_once(spark, lc):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # pieces begin and end amid batches
    try:
        found = pieces.savgol_trend(lc, 5, 2, size=12, few=5)
        assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
        same(found, detrend.add_trend(lc, "savgol", savgol_window=5, savgol_polyorder=2))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_windows_noise_and_gaps(lc):
    same(pieces.generate_windows(lc.filter("target_id <> 'void'"), 64, 0.5), windows.generate_windows(lc.filter("target_id <> 'void'"), 64, 0.5))
    both = quality.noise_estimate(lc).join(quality.cadence_and_gaps(lc, factor=3.0), "target_id")
    same(pieces.noise_and_gaps(lc, 3.0, size=40, few=5), both)


def test_pieces_spread_and_nothing_gathers_a_curve(spark, lc):
    long = spark.range(200_000).select(F.concat(F.lit("hot"), F.col("id") % 1).alias("target_id"), F.lit("m").alias("mission"), F.col("id").alias("seq"), (F.col("id") * 0.01).alias("time"), F.when(F.col("id") % 7 != 0, F.sin("id")).alias("flux"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for op in (lambda d: pieces.fill_missing(d, size=20_000), lambda d: pieces.running_median_trend(d, 7, size=20_000)):
            held = op(long).withColumn("at", F.spark_partition_id()).groupBy("at").count().collect()
            assert len(held) > 2 and max(r["count"] for r in held) < 120_000
            plan = op(long)._jdf.queryExecution().executedPlan().toString()
            assert "percentile(" not in plan.lower() and re.search(r"hashpartitioning\(target_id#\d+, _piece#", plan) and not re.search(r"hashpartitioning\(target_id#\d+, \d", plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    with pytest.raises(ValueError, match="around it"):
        pieces.running_median_trend(lc, 999, size=40)
    with pytest.raises(ValueError, match="by pieces"):
        pieces.fill_missing(lc, "cubic")


def test_bits_order_as_doubles(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63 - 1, 3000).view(np.float64)
    x = np.concatenate([x, -x, [0.0, -0.0, np.inf, -np.inf, np.finfo(float).max, np.nextafter(1, 0), np.nextafter(1, 2)], 2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1020, 1024), 0)])
    x = x[~np.isnan(x)]
    bits = x.view(np.int64)
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "v double").select(selection.order_bits(F.col("v"))).collect()]
    assert got == np.where(bits < 0, -(bits & (2**63 - 1)), bits).tolist()


@pytest.mark.parametrize("few", [1, 30, 10**6])
def test_percentiles_equal_the_built_in_ones(spark, few):
    rng = np.random.default_rng(2)
    groups = {
        "ties": rng.integers(-2, 3, 301).astype(float), "spread": rng.integers(0, 2**63 - 1, 400).view(np.float64), "near": 1 + rng.integers(0, 50, 300) * 2.0**-52, "one": np.array([3.5]), "equal": np.full(500, -7.25),
        "infinite": np.array([np.inf, -np.inf, -np.inf, 0.0, -0.0, np.inf, 1.0]), "void": np.array([np.nan, np.nan]), None: rng.normal(size=200),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("ties", None), ("void", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    wanted = (0.0, 0.005, 0.25, 0.5, 0.75, 0.995, 1.0)
    own = df.filter("v is not null and not isnan(v)").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, wanted))).alias("q"))
    found = selection.percentiles(df, "k", "v", wanted, few)
    rows_of = lambda d: sorted((str(r["k"]), str([x + 0.0 for x in r["q"]])) for r in d.collect())
    assert rows_of(found) == rows_of(own)
    if few == 1:
        hot = selection._selected(df.filter("k = 'ties' and v is not null").select(F.col("k").alias("_key"), F.col("v").alias("_v")), spark.createDataFrame([("ties", 301)], "_key string, n bigint"), (0.5,), 1)
        plan = hot._jdf.queryExecution().executedPlan().toString().lower()
        assert "percentile" not in plan and "median" not in plan


def test_values_of_large_groups_are_settled_once_for_all_passes(lc, monkeypatch):
    kept, settled = [], selection.settled
    monkeypatch.setattr(selection, "settled", lambda df: kept.append(df.columns) or settled(df))
    same(selection.medians(lc.filter("flux < 10"), "target_id", "flux", 5), lc.filter("flux < 10").groupBy("target_id").agg(F.median("flux")))
    assert sum("_bits" in c for c in kept) == 1
