"""k-means of integer vectors with Elkan's bounds: exact results, with most distances never taken.

Every vector keeps an upper bound of the distance to its own centroid and a lower bound for each of the k centroids. When
centroids move, bounds move by as much. A centroid is tried only where a vector's upper bound reaches both its lower
bound and half the way between the two centroids. Bounds are kept as 32-bit floats, rounded away from what they bound, and
prune only where they are strictly apart, so equal distances are always taken and compared: as integers, ties to the
smaller number. Driver and tasks hold k centroids, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_small_batches
from .vectors import States, added, floors, integer_vectors, lists, lower, matrix, upper

K, ROUNDS, SCALE, DIM, SEED = 40, 5, 256, 64, "2:"


def _down(v: np.ndarray) -> np.ndarray:
    return np.nextafter(v.astype(np.float32), np.float32(-np.inf))


def _up(v: np.ndarray) -> np.ndarray:
    return np.nextafter(v.astype(np.float32), np.float32(np.inf))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis of integers."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


class Bounds:
    """Rows of vectors with their assignment and bounds; taken counts the distances that were needed."""

    def __init__(self, x: np.ndarray, near: np.ndarray, high: np.ndarray, low: np.ndarray) -> None:
        self.x, self.near, self.high, self.low, self.taken = x, near, high, low, 0

    @classmethod
    def fresh(cls, x: np.ndarray, k: int) -> Bounds:
        n = len(x)
        return cls(x, np.zeros(n, np.int32), np.full(n, np.inf, np.float32), np.zeros((n, k), np.float32))

    def drift(self, moved: np.ndarray) -> None:
        """The centroids have moved by no more than moved."""
        self.high = _up(self.high + moved[self.near])
        self.low = _down(self.low - moved)

    def own(self, centres: np.ndarray, rows: np.ndarray) -> np.ndarray:
        self.taken += len(rows)
        return squared(self.x[rows], centres[self.near[rows]])

    def assign(self, centres: np.ndarray) -> None:
        half = lower(np.sqrt(squared(centres[:, None], centres[None]).astype(float)) / 2)
        alone = np.where(np.eye(len(centres), dtype=bool), np.inf, half).min(axis=1)
        work = np.flatnonzero(self.high >= alone[self.near])
        exact = np.full(len(self.x), -1, np.int64)
        for j in range(len(centres)):
            near = self.near[work]
            rows = work[(near != j) & (self.high[work] >= self.low[work, j]) & (self.high[work] >= half[near, j])]
            loose = rows[exact[rows] < 0]
            exact[loose] = self.own(centres, loose)
            self.high[loose] = _up(np.sqrt(exact[loose].astype(float)))
            rows = rows[(self.high[rows] >= self.low[rows, j]) & (self.high[rows] >= half[self.near[rows], j])]
            d = squared(self.x[rows], centres[j])
            self.taken += len(rows)
            self.low[rows, j] = _down(np.sqrt(d.astype(float)))
            better = (d < exact[rows]) | ((d == exact[rows]) & (j < self.near[rows]))
            moved = rows[better]
            self.low[moved, self.near[moved]] = _down(np.sqrt(exact[moved].astype(float)))
            self.near[moved], exact[moved] = j, d[better]
            self.high[moved] = _up(np.sqrt(d[better].astype(float)))


def _round(centres: np.ndarray, before: np.ndarray | None, last: bool) -> Callable:
    """One assignment of a task's vectors; centres were before in the last round, None in the first."""
    k, dim = centres.shape
    moved = None if before is None else upper(np.sqrt(squared(centres, before).astype(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = np.zeros((k, dim + 1), np.int64), None
        for b in batches:
            ids, x = b.column(0), matrix(b.column(1), np.int64)
            kind = ids.type
            if moved is None:
                s, was = Bounds.fresh(x, k), np.full(len(x), -1)
            else:
                s = Bounds(x, *(np.array(b.column(i).to_numpy(zero_copy_only=False)) for i in (2, 3)), matrix(b.column(4), np.float32))
                was = s.near.copy()
                s.drift(moved)
            s.assign(centres)
            change = np.flatnonzero(was != s.near)
            with_one = np.concatenate([x[change], np.ones((len(change), 1), np.int64)], axis=1)
            np.add.at(total, s.near[change], with_one)
            left = was[change] >= 0
            np.subtract.at(total, was[change][left], with_one[left])
            distance = pa.array(s.own(centres, np.arange(len(x))), pa.int64()) if last else pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, b.column(1), pa.array(s.near, pa.int32()), pa.array(s.high, pa.float32()), lists(s.low, pa.float32()), distance, pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.int64())], NAMES)
        slots = np.flatnonzero(total)
        if len(slots):
            none = lambda t: pa.nulls(len(slots), t)
            yield pa.RecordBatch.from_arrays([none(kind), none(pa.list_(pa.int32())), none(pa.int32()), none(pa.float32()), none(pa.list_(pa.float32())), none(pa.int64()), pa.array(slots, pa.int32()), pa.array(total.ravel()[slots], pa.int64())], NAMES)

    return run


NAMES = ["id", "x", "near", "high", "low", "distance", "slot", "by"]


def clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, seed: str = SEED) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of dim finite components.

    Components are taken as floor(scale * component). Centroids start as the k vectors of smallest sha256 of seed and id;
    each of rounds assigns all vectors and replaces every centroid by its vectors' floored mean, an empty one stays; then
    all are assigned once more. A null vector, one of another length, and one with null or non-finite components is left
    out; a null id starts no centroid before others and is passed on. Rows that repeat an id or a vector count each; of
    equal ids the smaller vector comes first. Equal distances go to the smaller number. Fewer than k vectors make as many
    centroids, an empty table an empty result. Columns other than the two are not looked at, whatever their names.
    """
    spark = df.sparkSession
    rows = in_small_batches(integer_vectors(df, vector_col, scale, dim, id=id_col))
    kind = dict(rows.dtypes)["id"]
    hashed = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = rows.select(hashed.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    out = f"{id_col} {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not first:
        return rows.select(F.col("id").alias(id_col), *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in out.split(", ")[1:])).limit(0)
    centres = np.array([r["x"] for r in first], np.int64)
    before, sums = None, np.zeros((len(centres), dim + 1), np.int64)
    states = States(spark, "centroids")
    state = rows
    schema = f"id {kind}, x array<int>, near int, high float, low array<float>, distance bigint, slot int, by bigint"
    for i in range(rounds + 1):
        vectors = state if before is None else state.filter("slot is null").select(*NAMES[:5])
        state = states.keep(vectors.mapInArrow(_round(centres, before, i == rounds), schema), f"round_{i}")
        if i < rounds:
            sums += added(state, sums.size).reshape(sums.shape)
            before, centres = centres, floors(sums[:, :dim], sums[:, dim], centres)
    found = state.filter("slot is null").select(F.col("id").alias(id_col), F.col("near").alias("cluster"), "distance")
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    table = spark.createDataFrame([(c, s, sum(inertia.values()), digest(centres[c])) for c, s in inertia.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(*(x.split()[0] for x in out.split(", ")))  # at most k rows


def centroid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """The rounds written out, every distance taken."""
    gap = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"d{r} as materialized (select v.vec_id, v.x, c.n, cast({gap} as bigint) as d from v, c{r} c)")
        steps.append(f"a{r} as materialized (select vec_id, x, arg_min(n, (d, n)) as n, min(d) as d from d{r} group by vec_id, x)")
        if r < ROUNDS:
            steps.append(f"s{r} as (select n, i, sum(x[i]) as s, count(*) as m from a{r}, (select unnest(range(1, 65)) as i) group by n, i)")
            steps.append(f"m{r} as (select n, list(cast((s - ((s % m) + m) % m) // m as bigint) order by i) as x from s{r} group by n)")
            steps.append(f"c{r + 1} as materialized (select c.n, coalesce(m.x, c.x) as x from c{r} c left join m{r} m on c.n = m.n)")
    return f"""
with v as materialized (select vec_id, list_transform(embedding, lambda e: cast(floor({SCALE} * cast(e as double)) as bigint)) as x from embeddings
  where len(embedding) = {DIM} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {DIM}),
c0 as materialized (select n, x from (select row_number() over (order by sha256('{SEED}' || vec_id)) - 1 as n, x from v) where n < {K}),
{', '.join(steps)}
select vec_id, cast(a.n as integer) as cluster, d as distance, cast(sum(d) over (partition by a.n) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
  sha256(array_to_string(c.x, ',')) as centroid_sha256 from a{ROUNDS} a join c{ROUNDS} c on a.n = c.n"""


ORACLE = _oracle()
