import hashlib

import numpy as np
import pytest
from oracle import assert_same

from fluxframe.llm import centroids, codes

SF = "/root/testdata/sf0.01"


def lloyd(x, centres, rounds):
    """Plain Lloyd on integers: the whole table of distances in every round."""
    for i in range(rounds + 1):
        d = ((x[:, None] - centres[None]) ** 2).sum(2)
        near = d.argmin(1)
        if i < rounds:
            centres = np.array([x[near == c].sum(0) // max(1, (near == c).sum()) if (near == c).any() else centres[c] for c in range(len(centres))])
    return near, d.min(1), centres


def test_agree_with_sql(spark):
    assert_same(centroids.centroid_query(spark, SF), centroids.ORACLE, SF)
    assert_same(codes.code_query(spark, SF), codes.ORACLE, SF)


def table(spark, x, parts, extra=()):
    rows = [(i, [float(c) for c in v], i % 3 or None, "s") for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, slot string").repartition(parts)


@pytest.mark.parametrize("case", ["ties", "copies", "spread", "large"])
def test_equal_plain_lloyd_on_a_larger_and_harder_table(spark, case):
    rng = np.random.default_rng(5)
    n = 3000
    x = {"ties": rng.integers(-2, 3, (n, 16)), "copies": np.repeat(rng.integers(-50, 50, (n // 100, 16)), 100, 0), "spread": rng.normal(0, 40, (n, 16)).round(), "large": rng.integers(-(2**21), 2**21, (n, 16))}[case]
    x = x.astype(np.int64)
    df = table(spark, x, 5)
    got = {r.vec_id: r for r in centroids.clusters(df, k=30, rounds=6, scale=1, dim=16).collect()}
    order = sorted(range(n), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:30]
    near, d, centres = lloyd(x, x[order], 6)
    assert [(got[i].cluster, got[i].distance) for i in range(n)] == list(zip(near, d, strict=True))
    assert {r.inertia for r in got.values()} == {d.sum()} and all(got[i].cluster_inertia == d[near == near[i]].sum() for i in range(0, n, 97))
    assert all(got[i].centroid_sha256 == hashlib.sha256(",".join(map(str, centres[near[i]])).encode()).hexdigest() for i in range(0, n, 97))
    got = {r.vec_id: r for r in codes.encode(df, parts=4, entries=12, rounds=6, scale=1, dim=16).collect()}
    each = [lloyd(x[:, p * 4 : p * 4 + 4], x[:12, p * 4 : p * 4 + 4], 6) for p in range(4)]
    error = sum(e[1] for e in each)
    labels = np.array([i % 3 for i in range(n)])
    assert [(got[i].code, got[i].error) for i in range(n)] == [("".join(f"{e[0][i]:02x}" for e in each), error[i]) for i in range(n)]
    assert all(got[i].label_error == error[labels == i % 3].sum() for i in range(0, n, 97))
    assert {r.codebooks_sha256 for r in got.values()} == {hashlib.sha256(",".join(str(c) for e in each for c in e[2].ravel()).encode()).hexdigest()}


def test_bounds_leave_most_distances_out():
    """Of well separated groups nearly nothing is looked at twice, and the heaps hand out few parts."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-9000, 9000, (40, 64))
    x = centres[rng.integers(0, 40, 4000)] + rng.integers(-30, 30, (4000, 64))
    s = centroids.Bounds.fresh(x, 40)
    s.assign(centres)
    taken = s.taken
    s.drift(np.full(40, 3.0))
    s.assign(centres + rng.integers(0, 1, (40, 64)))
    assert taken < 4000 * 40 and s.taken - taken < 4000
    near = s.near.copy()
    assert (near == ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)).all()
    code, key = codes.rescan(x, centres, np.zeros(40))
    lost = codes.lose(np.zeros((1, 40)), centres[None], centres[None] + 2)[0]
    assert (code == near).all() and len(codes.popped(code, key, lost)) == 0 and len(codes.popped(code, key, np.full(40, 1e6))) == 4000


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    odd = [(100, None, 1, "a"), (101, [1.0] * 3, 1, "a"), (102, [1.0, 2.0, nan, 0.0], None, "a"), (103, [1.0, 2.0, -inf, 0.0], None, "a"), (104, [1.0, None, 2.0, 0.0], 2, "a"), (105, [], 2, None), (None, [0.5, -0.5, 0.0, -0.001], None, None), (7, [0.5, -0.5, 0.0, -0.001], 1, "b"), (7, [0.5, -0.5, 0.0, -0.001], 1, "b")]
    df = table(spark, [], 1, odd)
    got = centroids.clusters(df, k=5, rounds=3, dim=4).collect()
    assert sorted((r.vec_id or -1, r.cluster, r.distance, r.inertia) for r in got) == [(-1, 0, 0, 0), (7, 0, 0, 0), (7, 0, 0, 0)]
    assert got[0].centroid_sha256 == hashlib.sha256(b"128,-128,0,-1").hexdigest()
    got = codes.encode(df, parts=2, entries=4, rounds=2, dim=4).collect()
    assert sorted((r.vec_id or -1, r.code, r.error, r.label_error) for r in got) == [(-1, "0000", 0, 0), (7, "0000", 0, 0), (7, "0000", 0, 0)]
    for empty in (df.limit(0), df.filter("vec_id = 100")):
        assert centroids.clusters(empty, dim=4).count() == 0 and codes.encode(empty, parts=2, dim=4).count() == 0
    with pytest.raises(Exception, match="is not below"):
        centroids.clusters(table(spark, [[1e30] * 4], 1), dim=4).count()
