"""Integer vectors and the tables in which iterative vector operators keep their state between rounds.

A round reads the state that the round before wrote to the shared folder and writes its own, so a lost executor costs
one round's tasks and lineage never grows; the older state is removed once the newer one is written. A state holds two
kinds of rows: vectors (slot is null) and, as the last rows of every task, what the task's moves add to the sums of the
groups (slot and by). The latter are read back through two columns that are null elsewhere, so a round reads its
vectors once.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

#: Components stay below this, so that a squared distance of a thousand components fits in a long.
LIMIT = 1 << 25


def integer_vectors(df: DataFrame, vector_col: str, scale: int, dim: int, **keep: str) -> DataFrame:
    """(keep..., x): the rows of df whose vector has dim components, none null or non-finite; x is floor(scale * component).

    keep names the columns that go along, by their new names. A component that is too large for exact distances in a long
    is an error.
    """
    v = F.col(f"`{vector_col}`")
    grown = lambda c: F.lit(float(scale)) * c.cast("double")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    whole = lambda c: F.when(F.abs(grown(c)) < LIMIT, F.floor(grown(c)).cast("int")).otherwise(F.raise_error(F.lit(f"a component times {scale} is not below {LIMIT}")).cast("int"))
    rows = df.filter(F.coalesce((F.size(v) == dim) & ~F.exists(v, bad), F.lit(False)))
    return rows.select(*(F.col(f"`{old}`").alias(new) for new, old in keep.items()), F.transform(v, whole).alias("x"))


def matrix(column: pa.ListArray, kind: type) -> np.ndarray:
    """The lists of a column, which are of equal length, as the rows of a matrix that may be written to."""
    return np.array(column.flatten().to_numpy(zero_copy_only=False), dtype=kind).reshape(len(column), -1)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a column of lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


class States:
    """The states of one run, each in a folder of its own under the shared folder; only the newest stays."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.last = spark, None
        self.base = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}_{uuid.uuid4().hex}"

    def keep(self, state: DataFrame, name: str) -> DataFrame:
        """state, written and read again; the one before it is removed."""
        path = f"{self.base}/{name}"
        state.write.parquet(path)
        if self.last:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(self.last)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.last = path
        return self.spark.read.parquet(path)


def added(state: DataFrame, size: int) -> np.ndarray:
    """What all tasks' moves add to the sums: size numbers, whatever the number of vectors."""
    out = np.zeros(size, np.int64)
    for r in state.filter("slot is not null").groupBy("slot").agg(F.sum("by").alias("by")).collect():
        out[r["slot"]] = r["by"]
    return out


def floors(sums: np.ndarray, counts: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """sums // counts along the last axis; otherwise's rows where nothing was counted."""
    return np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], otherwise)


def lower(v: np.ndarray) -> np.ndarray:
    """Below v by more than the rounding of a root and a few sums."""
    return v - np.abs(v) * 1e-14


def upper(v: np.ndarray) -> np.ndarray:
    return v + np.abs(v) * 1e-14
