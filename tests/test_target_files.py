"""Files of many targets from executors, and text files of many splits in their order."""

import csv
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxframe.operators.windows import generate_windows
from fluxframe.sources import adapters, target_files

NAMES = ["a", "b/c", "d e+f", "g.h", "50%", "é"]


def curves(spark):
    rows = [(n, "m", i, float(i), None if i == 3 else float("inf") if i == 5 else 0.1 * i + k) for k, n in enumerate(NAMES) for i in range(40 + k)]
    return spark.createDataFrame(rows, "target_id string, mission string, seq bigint, time double, flux double").repartition(5)


def test_csv_round_trip_and_failed_jobs(spark, tmp_path):
    lc = curves(spark)
    target_files.write_csv(lc, f"{tmp_path}/out")
    target_files.write_csv(lc, f"{tmp_path}/out")  # replaces the first
    files = [p for p in tmp_path.rglob("*.csv")]
    assert len(files) == len(NAMES) and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    rows = lambda d: sorted(map(tuple, d.select("target_id", "seq", "time", "flux").collect()), key=str)
    assert rows(target_files.read_csv(spark, f"{tmp_path}/out")) == rows(lc)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150b")  # each file has several splits
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        again = target_files.read_csv(spark, f"{tmp_path}/out")
        assert rows(again) == rows(lc)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    bad = lc.withColumn("time", F.when((F.col("target_id") == "g.h") & (F.col("seq") == 30), F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("time")))
    with pytest.raises(Exception, match="broken"):
        target_files.write_csv(bad, f"{tmp_path}/bad")
    assert not [p for p in (tmp_path / "bad").rglob("*") if p.is_file()] if (tmp_path / "bad").exists() else True


def test_windows_as_npz(spark, tmp_path):
    w = generate_windows(curves(spark), 16, 0.5)
    target_files.write_windows(w, f"{tmp_path}/w")
    found = {p.name: np.load(p) for p in Path(f"{tmp_path}/w").rglob("*.npz")}
    assert set(found) == {"a.npz", "b%2Fc.npz", "d%20e%2Bf.npz", "g.h.npz", "50%25.npz", "%C3%A9.npz"}
    own = w.filter("target_id = 'a'").orderBy("idx").collect()
    assert found["a.npz"]["window_ids"].tolist() == [r.window_id for r in own]
    assert np.array_equal(found["a.npz"]["flux"], np.array([r.flux for r in own]), equal_nan=True) and found["a.npz"]["time"].shape == (len(own), 16)


def test_a_csv_of_many_splits_comes_in_file_order(spark, tmp_path):
    with open(tmp_path / "star.csv", "w") as f:
        w = csv.writer(f)
        w.writerow(["time", "flux"])
        w.writerows([(i * 7 % 1000, i) for i in range(3000)])
    size = (tmp_path / "star.csv").stat().st_size
    spark.conf.set("spark.sql.files.maxPartitionBytes", f"{size // 3 + 1}b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lc = adapters.read_csv(spark, str(tmp_path / "star.csv"))
        assert spark.read.csv(str(tmp_path / "star.csv")).rdd.getNumPartitions() >= 3
        assert [r.flux for r in lc.orderBy("seq").collect()] == [float(i) for i in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
