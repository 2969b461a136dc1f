from collections import defaultdict

import pytest
from oracle import assert_same

from fluxframe.llm import mixing

SF = "/root/testdata/sf0.01"


def reshared(sizes, weights=(3, 1, 2)):
    """The targets as the contract tells them: capped sources leave their excess to the others, until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        share = (total - sum(2 * sizes[s] for s in capped)) / sum(w[s] for s in free) if free else 0
        above = {s for s in free if share * w[s] > 2 * sizes[s]}
        if not above:
            return {s: 2 * sizes[s] if s in capped else share * w[s] for s in order}
        capped |= above


def checked(rows, near=None):
    by = defaultdict(list)
    for r in rows:
        assert r.taken % max(1, r.size) == 0 and 0 <= r.taken <= 2 * r.size
        by[r.source_size, round(r.target, 6)].append(r)
    for (size, target), own in by.items():
        assert sum(r.size for r in own) == size
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own) / 2 + 1e-6, (target, sum(r.taken for r in own))


def test_agrees_with_sql_and_hits_targets(spark):
    df = mixing.mixing_query(spark, SF)
    assert_same(df, mixing.ORACLE, SF)
    rows = df.collect()
    checked(rows)
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes, got = defaultdict(int), {}
    for r in rows:
        sizes[source[r.doc_id]] += r.size
        got[source[r.doc_id]] = r.target
    assert got == pytest.approx(reshared(sizes))


@pytest.mark.parametrize("few", [1, 50])
def test_every_pass_narrows_to_the_same_result(spark, few):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {(r.doc_id, r.taken) for r in mixing.mix(docs).collect()}
    assert want == {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7), few=few).collect()}


def test_longer_documents_come_more_often_and_evenly_over_seeds(spark):
    rows = [(i, "w " * (4 if i % 2 else 100), "a") for i in range(600)] + [(i, "w " * 50, "b") for i in range(600, 900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    times = defaultdict(int)
    for seed in range(12):
        out = mixing.mix(df, weights=(1, 2), seed=str(seed)).collect()
        checked(out)
        for r in out:
            times[r.doc_id] += r.taken // r.size
    short, long = ([times[i] / 12 for i in range(600) if i % 2 == odd] for odd in (1, 0))
    # expected copies are in proportion to the bits of the size, 3 and 7
    assert sum(long) / sum(short) == pytest.approx(7 / 3, rel=0.08)


def test_equal_rows_are_taken_by_number(spark):
    """A third of all rows, then nearly all, share one id and text: so many of them are taken as fit, in whatever partition they lie."""
    rows = [(None, "five words in this text", "a", 1)] * 300 + [(i, "x y z", "a", 1) for i in range(500)] + [(9, "b " * 700, "b", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int").repartition(6)
    out = mixing.mix(df, weights=(1, 3), few=1).collect()
    checked(out)
    again = mixing.mix(df.repartition(3), weights=(1, 3), few=100).collect()
    key = lambda r: (r.doc_id or -1, r.size, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))
    alone = mixing.mix(df.filter("doc_id is null or doc_id = 9").filter("source = 'b' or text like 'five%'"), weights=(1, 3), few=1).collect()
    checked(alone)
    assert sorted(r.taken for r in alone if r.doc_id is None) == [5] * 220 + [10] * 80


def test_odd_rows(spark):
    rows = [(1, None, "a", 0), (2, "", "a", 0), (3, " \n\t ", None, 0), (4, "\u00a0 word\x0bother ", None, 0), (5, "word " * 200_000, "b", 0), (None, "x y", "a", 0), (None, None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, weight int")
    out = {(r.doc_id, r.size, r.source_size) for r in mixing.mix(df).collect()}
    assert out == {(1, 0, 2), (2, 0, 2), (3, 0, 3), (4, 3, 3), (5, 200_000, 200_000), (None, 2, 2), (None, 0, 3)}
    weighed = {r.doc_id: r.taken for r in mixing.mix(df, weight_col="weight").collect()}
    assert weighed[5] % 200_000 == 0
    assert mixing.mix(df.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(df.filter("doc_id < 4")).collect()} == {0}
