"""Product codes by Heap Lloyd: parts of vectors are assigned to the entries of small codebooks, and only those parts are looked at again whose bounds the entries' drift has used up.

When a part is assigned, the lower bound of the distance to any other entry less the upper bound of that to its own is its
slack. Every round an entry's drift, and the greatest drift of the others, are added to what its parts have lost so far.
Parts of an entry lie in a heap keyed by slack plus what the entry had lost when they were assigned, so those whose bounds
may be violated are at its top: they are popped and compared exactly with all entries, the rest is left alone. Heaps are
local to a block of a partition's rows, so that a task's memory does not grow with its partition; the keys are kept with the
vectors between rounds. Keys are rounded down and popped when they have just run out, so that ties are always compared.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import squared
from .common import cut, in_small_batches, maybe_broadcast
from .vectors import States, added, floors, integer_vectors, lists, lower, matrix, upper

PARTS, ENTRIES, ROUNDS, SCALE, DIM = 8, 16, 6, 4096, 64
NAMES = ["id", "label", "x", "code", "key", "error", "slot", "by"]


def popped(code: np.ndarray, key: np.ndarray, lost: np.ndarray) -> list[int]:
    """The rows of one part position whose bounds may be violated, off the heaps of the entries."""
    out = []
    order = np.argsort(code, kind="stable")
    ends = np.searchsorted(code[order], np.arange(len(lost) + 1))
    for c in np.flatnonzero(ends[1:] > ends[:-1]):
        own = order[ends[c] : ends[c + 1]]
        heap = list(zip(key[own].tolist(), own.tolist(), strict=True))
        heapq.heapify(heap)
        while heap and heap[0][0] <= lost[c]:
            out.append(heapq.heappop(heap)[1])
    return out


def rescan(x: np.ndarray, entries: np.ndarray, lost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, key) of parts that are compared with all entries."""
    d = squared(x[:, None], entries[None])
    code = d.argmin(axis=1)
    own = d[np.arange(len(d)), code].astype(float)
    d[np.arange(len(d)), code] = np.iinfo(np.int64).max
    other = d.min(axis=1).astype(float)
    slack = lower(np.sqrt(other)) - upper(np.sqrt(own)) if len(entries) > 1 else np.full(len(d), np.inf)
    # the sum is rounded relative to its own terms, which may be larger than it
    return code, slack + lost[code] - 1e-14 * (np.sqrt(other) + np.sqrt(own) + lost[code])


def lose(lost: np.ndarray, books: np.ndarray, new: np.ndarray) -> np.ndarray:
    """lost with what the move from books to new takes off the slack of each entry's parts."""
    drift = upper(np.sqrt(squared(new, books).astype(float)))
    entries = drift.shape[1]
    others = np.stack([np.delete(drift, c, axis=1).max(axis=1) if entries > 1 else np.zeros(len(drift)) for c in range(entries)], axis=1)
    return upper(lost + drift + others)


def _round(books: np.ndarray, lost: np.ndarray, first: bool, last: bool) -> Callable:
    """One assignment of a task's vectors. books: part, entry, place in the part; lost: part, entry."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kinds = np.zeros((parts, entries, width + 1), np.int64), None
        for b in batches:
            kinds = [b.column(i).type for i in (0, 1)]
            x = matrix(b.column(2), np.int64).reshape(-1, parts, width)
            n = len(x)
            code, key = (np.zeros((n, parts), np.int32), np.zeros((n, parts))) if first else (matrix(b.column(3), np.int32), matrix(b.column(4), np.float64))
            was = np.full((n, parts), -1) if first else code.copy()
            for p in range(parts):
                rows = np.arange(n) if first else np.array(popped(code[:, p], key[:, p], lost[p]), int)
                code[rows, p], key[rows, p] = rescan(x[rows, p], books[p], lost[p])
                change = np.flatnonzero(was[:, p] != code[:, p])
                with_one = np.concatenate([x[change, p], np.ones((len(change), 1), np.int64)], axis=1)
                np.add.at(total[p], code[change, p], with_one)
                left = was[change, p] >= 0
                np.subtract.at(total[p], was[change, p][left], with_one[left])
            error = pa.array(sum(squared(x[:, p], books[p][code[:, p]]) for p in range(parts)), pa.int64()) if last else pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lists(code, pa.int32()), lists(key, pa.float64()), error, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], NAMES)
        slots = np.flatnonzero(total)
        if len(slots):
            none = lambda t: pa.nulls(len(slots), t)
            yield pa.RecordBatch.from_arrays([*map(none, kinds), none(pa.list_(pa.int32())), none(pa.list_(pa.int32())), none(pa.list_(pa.float64())), none(pa.int64()), pa.array(slots, pa.int32()), pa.array(total.ravel()[slots], pa.int64())], NAMES)

    return run


def encode(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) of every vector of dim finite components.

    Components are taken as floor(scale * component) and cut into equal parts. Codebooks start as the parts of the vectors
    of smallest id; each of rounds assigns all parts and replaces every entry by its parts' floored mean, an unused one
    stays; then all are assigned once more. A null vector, one of another length and one with null or non-finite components
    is left out; a null id comes after all others. Rows that repeat an id or a vector count each; of equal ids the smaller
    vector comes first. Equal distances go to the lower index. Null labels are one label. Fewer vectors than entries make
    as many entries, an empty table an empty result. Columns other than the three are not looked at, whatever their names.
    """
    if dim % parts or entries > 256:
        raise ValueError("parts must divide dim, and a code has two hexadecimal digits")
    spark = df.sparkSession
    rows = in_small_batches(integer_vectors(df, vector_col, scale, dim, id=id_col, label=label_col))
    kind, label = (dict(rows.dtypes)[c] for c in ("id", "label"))
    first = rows.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    if not first:
        return rows.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, -1).swapaxes(0, 1)
    lost, sums = np.zeros(books.shape[:2]), np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
    states = States(spark, "codes")
    state = rows
    schema = f"id {kind}, label {label}, x array<int>, code array<int>, key array<double>, error bigint, slot int, by bigint"
    for i in range(rounds + 1):
        vectors = state.select("id", "label", "x") if i == 0 else state.filter("slot is null").select(*NAMES[:5])
        state = states.keep(vectors.mapInArrow(_round(books, lost, i == 0, i == rounds), schema), f"round_{i}")
        if i < rounds:
            sums += added(state, sums.size).reshape(sums.shape)
            new = floors(sums[..., :-1], sums[..., -1], books)
            books, lost = new, lose(lost, books, new)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    found = state.filter("slot is null").select("id", "label", "code", "error")
    by_label = maybe_broadcast(cut(found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))))
    hexed = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return found.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left").select(F.col("id").alias(id_col), hexed.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def code_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """The rounds written out, every distance taken."""
    width = DIM // PARTS
    gap = f"list_sum(list_transform(range(1, {width + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} as materialized (select v.vec_id, v.label, v.p, any_value(v.x) as x, arg_min(c.n, ({gap}, c.n)) as n, cast(min({gap}) as bigint) as d from v join c{r} c on v.p = c.p group by v.vec_id, v.label, v.p)")
        if r < ROUNDS:
            steps.append(f"s{r} as (select p, n, i, sum(x[i]) as s, count(*) as m from a{r}, (select unnest(range(1, {width + 1})) as i) group by p, n, i)")
            steps.append(f"m{r} as (select p, n, list(cast((s - ((s % m) + m) % m) // m as bigint) order by i) as x from s{r} group by p, n)")
            steps.append(f"c{r + 1} as materialized (select c.p, c.n, coalesce(m.x, c.x) as x from c{r} c left join m{r} m on c.p = m.p and c.n = m.n)")
    return f"""
with w as materialized (select vec_id, label, list_transform(embedding, lambda e: cast(floor({SCALE} * cast(e as double)) as bigint)) as x from embeddings
  where len(embedding) = {DIM} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {DIM}),
v as materialized (select vec_id, label, p, x[p * {width} + 1:p * {width} + {width}] as x from w, (select unnest(range(0, {PARTS})) as p)),
c0 as materialized (select p, n, x from (select p, row_number() over (partition by p order by vec_id) - 1 as n, x from v) where n < {ENTRIES}),
{', '.join(steps)},
b as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, n)) as codebooks_sha256 from c{ROUNDS}),
e as (select vec_id, label, string_agg(lpad(lower(hex(n)), 2, '0'), '' order by p) as code, cast(sum(d) as bigint) as error from a{ROUNDS} group by vec_id, label)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from e, b"""


ORACLE = _oracle()
