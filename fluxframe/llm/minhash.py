"""Near duplicates: MinHash bands propose, odd sketches estimate, full shingle sets confirm.

Odd sketches (Mitzenmacher, Pagh, Pham 2014): the samples of a MinHash signature are folded into a parity bitmap; the
number of ones in the XOR of two bitmaps estimates high similarities closely, at 32 bytes a text.

Plan, each step over all rows:

1. One vectorised pass turns every text into its set's size, a 128-bit key of the set, 32 band keys and the odd sketch.
2. Texts with equal sets are one class (a partially aggregated minimum); only its representative goes on.
3. Stars: a bucket of a band proposes the pairs of its members with its smallest one, so its pairs grow with its members.
   Sizes and sketches drop most; the rest are confirmed on full sets, dealt out by the star's centre in bounded chunks.
   Components of these links settle a group of near copies of any size with a shuffle in proportion to it.
4. Buckets whose other members still lie in several components are compared by sizes and sketches alone, some 60 bytes a
   member: small buckets many to a task, large ones in blocks, every pair of blocks in a task of its own. A task returns
   who has a partner in another component, as a forest, so its rows grow with the members and not with their pairs.
5. Only those members' sets are compared in full, dealt out in blocks by the same rule within the components of that
   forest, leaving out pairs that step 3 has in one component already.
6. Connected components of all confirmed links label the classes, and these label the documents.

So every pair that shares a band is either confirmed or told apart by size, by sketch or in full; whole components of
buckets are never compared, and full sets meet only where sketches cannot decide. What stays quadratic is step 5 within a
group of texts that all look at least half alike and are not linked by stars, in tasks of bounded size.

With 4 rows in each of 32 bands a pair at similarity 0.75 shares no bucket once in 190,000 times, and the sketch limit sits
five deviations above what such a pair differs by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, in_small_batches, maybe_broadcast
from .shingle import mix, shingle_sets

SAMPLES, ROWS, BITS = 128, 4, 256
BANDS = SAMPLES // ROWS
#: Two sketches differ in 50 bits at similarity 0.75 on average, with a deviation of 7; at 0.5 in 81. The limit lies so many bits above the average.
SPARE_BITS = 38
#: Shingles of a task's block of sets (8 MB), and members of a task's block of sketches (2 MB).
BLOCK, MEMBERS = 1_000_000, 30_000
_rng = np.random.default_rng(20250103)
_FACTOR = (_rng.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SHIFT = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)[:, None]
_TAG = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)

SIGNATURE = "id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>, o0 bigint, o1 bigint, o2 bigint, o3 bigint"


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The smallest of each of the 128 hashes over a non-empty set."""
    s = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 2**32 - 1, np.uint32)
    for at in range(0, len(s), 2048):
        np.minimum(best, (_FACTOR * s[None, at : at + 2048] + _SHIFT).min(axis=1), out=best)
    return best


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of signatures, a row of four 64-bit words each."""
    bit = mix(samples.astype(np.uint64) ^ _TAG) & np.uint64(BITS - 1)
    one, word = np.uint64(1) << (bit & np.uint64(63)), bit >> np.uint64(6)
    return np.stack([np.bitwise_xor.reduce(np.where(word == np.uint64(w), one, np.uint64(0)), axis=1) for w in range(BITS // 64)], axis=1)


def estimate(bits: float) -> float:
    """The similarity at which two odd sketches differ in so many bits on average."""
    return 1 + BITS / (4 * SAMPLES) * float(np.log(max(1e-9, 1 - 2 * bits / BITS)))


def most_bits(percent: int) -> int:
    """The most bits in which the sketches of a linked pair may differ."""
    toggles = 2 * SAMPLES * (1 - percent / 100)
    return int(BITS / 2 * (1 - (1 - 2 / BITS) ** toggles)) + SPARE_BITS


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            n, k1, k2, sig = [], [], [], []
            for s in shingle_sets(x.as_buffer().to_pybytes() if x.is_valid else None for x in batch.column(1)):
                n.append(len(s))
                y = mix(s ^ _TAG[0])
                k1.append(y.sum(dtype=np.uint64))
                k2.append(np.bitwise_xor.reduce(mix(y + _TAG[1])))
                sig.append(minhash(s) if len(s) else np.zeros(SAMPLES, np.uint32))
            samples = np.array(sig, np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = np.broadcast_to(_TAG[None, :BANDS], samples.shape[:2])
            for j in range(ROWS):
                keys = mix(keys + samples[:, :, j] * _TAG[BANDS + j])
            odd = odd_sketch(samples.reshape(-1, SAMPLES)).view(np.int64)
            full = np.array(n) > 0
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(full * BANDS))), pa.int32()), pa.array(keys[full].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(k1, np.uint64).view(np.int64)), pa.array(np.array(k2, np.uint64).view(np.int64)), bands, *(pa.array(odd[:, w]) for w in range(4))],
                ["id", "n_shingles", "k1", "k2", "bands", "o0", "o1", "o2", "o3"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            sets = [s.tobytes() for s in shingle_sets(x.as_buffer().to_pybytes() if x.is_valid else None for x in batch.column(batch.schema.get_field_index("data")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(sets, pa.binary())], [*batch.schema.names[:-1], "shingles"])


class _Forest:
    """Union-find over positions; roots are the smallest of their trees."""

    def __init__(self, n: int, labels: np.ndarray | None = None):
        self.parent = np.arange(n)
        if labels is not None:  # equal labels are one tree from the start
            _, first, back = np.unique(labels, return_index=True, return_inverse=True)
            self.parent = first[back]

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        """The root of every position; paths are shortened on the way."""
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up.copy()
            self.parent = up


def _near(sizes: np.ndarray, odd: np.ndarray, i: int, lo: int, percent: int, most: int) -> np.ndarray:
    """Which of the sets from lo on the size and the sketch of set i let be linked to it."""
    near = 100 * np.minimum(sizes[lo:], sizes[i]) >= percent * np.maximum(sizes[lo:], sizes[i])
    near &= np.bitwise_count(odd[lo:] ^ odd[i]).sum(axis=1) <= most
    return near


def _links(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], odd: np.ndarray, left: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets; with left > 0, of those between the first left ones and the rest.

    Sets of one label are linked already and not compared.
    """
    m, most = len(sets), most_bits(percent)
    forest = _Forest(m, labels)
    sizes = np.array([len(s) for s in sets])
    roots = forest.roots()
    index = None
    out = []
    for i in range(left or m):
        lo = left or i + 1
        if lo >= m:
            break
        found = np.flatnonzero(_near(sizes, odd, i, lo, percent, most) & (roots[lo:] != roots[i])) + lo
        if not len(found):
            continue
        if left == 1 and len(found) > 4:  # a star: look all its members up in the centre at once
            at = np.append(0, np.cumsum(sizes[found]))
            shared = np.add.reduceat(_held(sets[i], np.concatenate([sets[j] for j in found.tolist()])), at[:-1])
        elif len(found) > 24:  # count what is shared with all sets at once
            if index is None:
                flat = np.concatenate(sets)
                order = np.argsort(flat, kind="stable")
                index = flat[order], np.repeat(np.arange(m, dtype=np.int32), sizes)[order]
                del flat, order
            a, b = np.searchsorted(index[0], sets[i], "left"), np.searchsorted(index[0], sets[i], "right")
            n = b - a
            hits = index[1][np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            shared = np.bincount(hits, minlength=m)[found]
        else:
            shared = np.array([_held(sets[i], sets[j]).sum() for j in found.tolist()])
        new = False
        for j in found[100 * shared >= percent * (sizes[i] + sizes[found] - shared)].tolist():
            if forest.join(i, j):
                out.append((int(ids[i]), int(ids[j])))
                new = True
        if new:
            roots = forest.roots()
    return out


def _held(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which values of b the sorted a has, as 0 and 1."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return (a[at] == b).astype(np.int64)


def _groups(table: pa.Table, keys: tuple[str, ...]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """An order of the rows by keys and side, and the ranges in it that hold one group each."""
    cols = [table.column(k).to_numpy() for k in keys]
    order = np.lexsort((table.column("side").to_numpy(), *cols))
    apart = np.zeros(max(len(order) - 1, 0), bool)
    for c in cols:
        apart |= np.diff(c[order]) != 0
    cuts = (np.flatnonzero(apart) + 1).tolist()
    return order, list(zip([0, *cuts], [*cuts, len(order)], strict=True))


def _sketches(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(f"o{w}").to_numpy() for w in range(4)], axis=1).view(np.uint64)


def _pairs(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"src": pa.array([x for x, _ in links], pa.int64()), "dst": pa.array([y for _, y in links], pa.int64())})


def _confirm(percent: int):
    def confirm(table: pa.Table) -> pa.Table:
        out = []
        order, ranges = _groups(table, ("grp", "x", "y"))
        ids, labels, side = (table.column(c).to_numpy()[order] for c in ("rep", "label", "side"))
        odd = _sketches(table)[order]
        blob = table.column("shingles").combine_chunks()  # the sets are views of its buffer
        where = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1] // 8
        data = np.frombuffer(blob.buffers()[2] or b"", np.uint64) if len(blob) and where[-1] else np.empty(0, np.uint64)
        for a, b in ranges:
            sets = [data[where[r] : where[r + 1]] for r in order[a:b].tolist()]
            two = int((side[a:b] == 0).sum()) if side[a] != side[b - 1] else 0
            out += _links(ids[a:b], labels[a:b], sets, odd[a:b], two, percent)
        return _pairs(out)

    return confirm


def _undecided(percent: int):
    """(src, dst): for every member that sketches cannot tell from one of another label in its bucket, the root of its tree of such members."""

    def survivors(table: pa.Table) -> pa.Table:
        most = most_bits(percent)
        order, ranges = _groups(table, ("grp", "x", "y"))
        ids, labels, sizes, side = (table.column(c).to_numpy()[order] for c in ("rep", "label", "n_shingles", "side"))
        odd = _sketches(table)[order]
        forest, held = _Forest(len(order)), np.zeros(len(order), bool)
        many = [r for r in ranges if r[1] - r[0] > 64 or side[r[0]] != side[r[1] - 1]]
        end = np.zeros(len(order), np.int64)
        for a, b in ranges:
            end[a:b] = b
        for a, b in many:
            end[a:b] = 0
        d = 1
        while True:  # all small buckets at once: every member with the one d places on
            i = np.flatnonzero(end > np.arange(len(end)) + d)
            if not len(i):
                break
            j = i + d
            near = (labels[i] != labels[j]) & (100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j]))
            near &= np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1) <= most
            for p, q in zip(i[near].tolist(), j[near].tolist(), strict=True):
                forest.join(p, q)
                held[[p, q]] = True
            d += 1
        roots = forest.roots()
        for a, b in many:
            two = int((side[a:b] == 0).sum()) if side[a] != side[b - 1] else 0
            own = _Forest(b - a)
            tops = own.roots()
            for i in range(two or b - a):
                lo = two or i + 1
                if lo >= b - a:
                    break
                found = np.flatnonzero(_near(sizes[a:b], odd[a:b], i, lo, percent, most) & (labels[a + lo : b] != labels[a + i])) + lo
                if len(found):
                    held[a + i] = True
                    held[a + found] = True
                    if sum(own.join(i, j) for j in np.unique(tops[found]).tolist()):
                        tops = own.roots()
            roots[a:b] = a + tops
        at = np.flatnonzero(held)
        return _pairs(list(zip(ids[at].tolist(), ids[roots[at]].tolist(), strict=True)))

    return survivors


def _deal(members: DataFrame, load: str, block: int) -> DataFrame:
    """members(grp, rep, ...) with side, task, x and y, so that all of a group meet: small groups many to a task, and a large one in blocks, every pair of blocks in a task.

    load names a number of every member; a block holds about block of it. A member is repeated once for each block of its group.
    """
    loads = cut(members.groupBy("grp").agg(F.sum(load).alias("load")))
    total = loads.filter(F.col("load") <= block).agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0]
    bins = int(2 * total // block) + 1
    large = loads.filter(F.col("load") > block).select("grp", (F.ceil(F.col("load") / block) + 1).cast("int").alias("blocks"))
    members = members.join(maybe_broadcast(large), "grp", "left")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    # a block meets itself and every other block once; (x, y) with x <= y names the task
    tasks = F.expr("transform(sequence(0, blocks - 1), b -> named_struct('x', least(own, b), 'y', greatest(own, b)))")
    big = members.filter("blocks is not null").withColumn("own", own).withColumn("t", F.explode(tasks))
    big = big.withColumns({"side": F.when((F.col("t.x") == F.col("t.y")) | (F.col("own") == F.col("t.x")), 0).otherwise(1), "task": F.xxhash64("grp"), "x": F.col("t.x") + 1, "y": F.col("t.y") + 1}).drop("own", "t", "blocks")
    zero = F.lit(0).cast("int")
    small = members.filter("blocks is null").withColumns({"side": zero, "task": F.pmod(F.xxhash64("grp"), F.lit(bins)), "x": zero, "y": zero}).drop("blocks")
    return small.unionByName(big)


def _deal_stars(stars: DataFrame, slim: DataFrame, block: int) -> DataFrame:
    """stars(src, dst) as rows of (rep, grp, side, task, x, y): side 0 is the centre dst, once for each chunk of its members."""
    sized = stars.join(slim.select(F.col("rep").alias("src"), "n_shingles"), "src")
    loads = cut(sized.groupBy("dst").agg((F.floor(F.sum("n_shingles") / block) + 1).cast("int").alias("chunks"), F.sum("n_shingles").alias("load")))
    bins = int(2 * loads.agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0] // block) + 1
    zero = F.lit(0).cast("int")
    leaves = stars.join(maybe_broadcast(loads.select("dst", "chunks")), "dst").select(F.col("src").alias("rep"), F.col("dst").alias("grp"), F.lit(1).alias("side"), F.pmod(F.xxhash64("src"), F.col("chunks")).cast("int").alias("x"))
    centres = loads.select(F.col("dst").alias("rep"), F.col("dst").alias("grp"), F.lit(0).alias("side"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("x"))
    return leaves.unionByName(centres).withColumns({"task": F.pmod(F.xxhash64("grp", "x"), F.lit(bins)), "y": zero})


def _compare(dealt: DataFrame, slim: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(src, dst): the confirmed links of dealt(rep, label, grp, side, task, x, y), with the sets taken from rows(id, data)."""
    dealt = cut(dealt)
    wanted = cut(dealt.select("rep").distinct())
    texts = rows.join(maybe_broadcast(wanted), F.col("id") == F.col("rep"), "left_semi")
    sets = texts.mapInArrow(_sets, "id bigint, shingles binary").withColumnRenamed("id", "rep")
    joined = dealt.join(slim.select("rep", "o0", "o1", "o2", "o3"), "rep").join(sets, "rep")
    joined = joined.select("rep", "label", "grp", "side", "task", "x", "y", "o0", "o1", "o2", "o3", "shingles")
    return joined.groupBy("task", "x", "y").applyInArrow(_confirm(percent), "src bigint, dst bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, block: int = BLOCK, members: int = MEMBERS) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row of docs.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set holds the distinct runs of five words. Two
    rows are linked if 100 * shared >= percent * united; component_id is the smallest id that links reach. Null, empty
    and blank texts have no shingles and no links; they keep their own id and are kept. A very long text is hashed in
    pieces and its set is as large as it has distinct runs; one task holds at least one set whole. Rows that share an id
    count as one document, though each is returned, and repeated rows get equal results. A row without an id is never
    linked: its component_id is null, and it is kept. An empty table gives an empty result; other columns of docs are not
    looked at, whatever their names. block and members bound what a task compares, in shingles and in sketches.
    """
    rows = in_small_batches(docs).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").cast("binary").alias("data"))
    sig = cut(rows.mapInArrow(_signatures, SIGNATURE))
    usable = sig.filter("n_shingles > 0 and id is not null")
    keys = ["k1", "k2", "n_shingles"]
    same = cut(usable.groupBy(*keys).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies"))
    same = maybe_broadcast(same)
    classes = sig.select("id", *keys).join(same, keys, "left").select("id", "n_shingles", F.expr("case when id is not null and n_shingles > 0 then coalesce(first, id) end").alias("rep"))
    # representatives: the smallest id of each class; repeated rows fall together again
    reps = usable.join(same, keys, "left").filter("first is null or first = id").dropDuplicates(["id", *keys]).select(F.col("id").alias("rep"), "n_shingles", "bands", "o0", "o1", "o2", "o3")
    reps = cut(reps)
    slim = reps.drop("bands")

    bands = reps.select("rep", F.explode("bands").alias("band"))
    buckets = cut(bands.groupBy("band").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).filter("first < last").drop("last"))
    spokes = cut(bands.join(maybe_broadcast(buckets), "band").filter("rep <> first"))  # (band, rep, first) of every member but the first
    stars = spokes.select(F.col("rep").alias("src"), F.col("first").alias("dst")).distinct()
    ends = lambda c: slim.select(F.col("rep").alias(c), F.struct("n_shingles", "o0", "o1", "o2", "o3").alias(f"_{c}"))
    apart = " + ".join(f"bit_count(_src.o{w} ^ _dst.o{w})" for w in range(4))
    sizes = f"100 * least(_src.n_shingles, _dst.n_shingles) >= {int(percent)} * greatest(_src.n_shingles, _dst.n_shingles)"
    stars = cut(stars.join(ends("src"), "src").join(ends("dst"), "dst").filter(f"{sizes} and {apart} <= {most_bits(percent)}").select("src", "dst"))
    near = cut(_compare(_deal_stars(stars, slim, block).withColumn("label", F.col("rep")), slim, rows, percent))

    linked = settled = connected_components(near)
    label = F.coalesce("component", "rep").alias("label")
    labelled = cut(spokes.join(maybe_broadcast(settled), F.col("rep") == F.col("node"), "left").select("band", "rep", label))
    mixed = cut(labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("band"))
    if not mixed.isEmpty():
        parts = labelled.join(maybe_broadcast(mixed), "band", "left_semi").select(F.col("band").alias("grp"), "rep", "label", F.lit(1).alias("one"))
        dealt = _deal(cut(parts), "one", members).join(slim, "rep").select("grp", "rep", "label", "side", "task", "x", "y", "n_shingles", "o0", "o1", "o2", "o3")
        alike = connected_components(dealt.groupBy("task", "x", "y").applyInArrow(_undecided(percent), "src bigint, dst bigint"))
        rest = alike.select(F.col("node").alias("rep"), F.col("component").alias("grp")).join(slim.select("rep", "n_shingles"), "rep").join(settled.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "grp", "n_shingles", label)
        far = cut(_compare(_deal(cut(rest), "n_shingles", block), slim, rows, percent))
        if not far.isEmpty():
            linked = connected_components(near.unionByName(far))
    out = classes.join(linked, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def near_duplicate_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
