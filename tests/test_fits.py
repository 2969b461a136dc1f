"""FITS tables as a data source, against the whole-file reader and round trips."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxframe.sources import adapters, fits

T, X = np.arange(5000.0), 1 + 0.001 * np.sin(np.arange(5000.0))


def test_one_file_is_read_by_many_tasks_and_two_columns(spark, tmp_path):
    content = adapters.write_fits(T, X, "KIC 1", "Kepler")
    (tmp_path / "c.fits").write_bytes(content)
    lc = fits.read_curves(spark, f"{tmp_path}/c.fits", 700)
    assert lc.rdd.getNumPartitions() == 8
    rows = lambda d: sorted(map(tuple, d.select("target_id", "mission", "seq", "time", "flux").collect()))
    assert rows(lc) == rows(adapters.read_fits(spark, f"{tmp_path}/c.fits")) and lc.first().target_id == "KIC 1"
    (tmp_path / "d.fits.gz").write_bytes(gzip.compress(content))
    assert fits.read_curves(spark, f"file://{tmp_path}", 700).count() == 10_000
    full = spark.read.format("fits").load(f"{tmp_path}/c.fits")
    assert dict(full.dtypes) == {"TIME": "double", "CADENCENO": "int", "PDCSAP_FLUX": "float", "_file": "string", "_row": "bigint", "_object": "string", "_telescope": "string"}
    assert full.agg(F.sum("CADENCENO")).first()[0] == sum(range(5000))
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "e.fits").write_bytes(content[:-4000])
    with pytest.raises(Exception, match="ends before row"):
        fits.read_curves(spark, f"{tmp_path}/cut").count()


def test_round_trip(spark, tmp_path):
    fits.register(spark)
    rows = [("a", True, 1, 2, 3, 1.5, 2.5), (None, None, None, None, None, None, None), ("é" * 5, False, -32767, 2**31 - 1, -(2**62), float("inf"), -0.0)]
    df = spark.createDataFrame(rows, "s string, b boolean, h smallint, i int, l bigint, f float, d double").repartition(2)
    df.write.format("fits").mode("append").save(f"{tmp_path}/t")
    again = spark.read.format("fits").load(f"{tmp_path}/t").drop("_file", "_row", "_object", "_telescope")
    assert again.dtypes == df.dtypes
    plain = lambda d: sorted(str(tuple("" if k == "s" and v is None else "nan" if k in "fd" and (v is None or v != v) else v for k, v in zip(d.columns, r, strict=True))) for r in d.collect())
    assert plain(again) == plain(df)
    df.write.format("fits").mode("overwrite").save(f"{tmp_path}/t")
    assert plain(spark.read.format("fits").schema("s string, absent int, l bigint").load(f"{tmp_path}/t")) == plain(df.select("s", F.lit(None).cast("int").alias("absent"), "l"))


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    fits.register(spark)
    df = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.lit("x" * 99)).otherwise("ok").alias("s"))
    with pytest.raises(Exception, match="longer than stringWidth"):
        df.write.format("fits").mode("append").save(f"{tmp_path}/bad")
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
    with pytest.raises(Exception, match="no type"):
        spark.createDataFrame([([1],)], "a array<int>").write.format("fits").mode("append").save(f"{tmp_path}/bad")


def test_many_ranges_and_files_make_few_tasks(spark, tmp_path, monkeypatch):
    """Ranges in order, each row once; a task starts for a share of the bytes, not for every range or file."""
    for i in range(30):
        (tmp_path / f"c{i:02d}.fits").write_bytes(adapters.write_fits(T[: 40 + i], X[: 40 + i], f"KIC {i}", "Kepler"))
    (tmp_path / "long.fits").write_bytes(adapters.write_fits(T, X, "KIC 99", "Kepler"))
    lc = fits.read_curves(spark, f"file://{tmp_path}", 10)
    assert 100 < lc.rdd.getNumPartitions() <= fits.TASKS
    rows = [tuple(r) for r in lc.select("target_id", "seq", "time").collect()]
    assert sorted(rows) == sorted([(f"KIC {i}", j, T[j]) for i in range(30) for j in range(40 + i)] + [("KIC 99", j, T[j]) for j in range(5000)])
    parts = fits._Reader(None, {"path": f"{tmp_path}", "rowsPerPartition": "10"}).partitions()
    assert len(parts) == lc.rdd.getNumPartitions() and any(len({r.uri for r in p.ranges}) > 1 for p in parts)
    monkeypatch.setattr(fits, "TASK_BYTES", 140)
    assert len(fits._Reader(None, {"path": f"{tmp_path}", "rowsPerPartition": "10"}).partitions()) > fits.TASKS
