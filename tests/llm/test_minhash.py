import re

import numpy as np
import pytest

from fluxframe.llm import minhash
from fluxframe.llm.minhash import near_duplicates


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} - {()} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in holders[x]:
                shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if j > i and 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return {(d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("sf,block,members", [("sf0.01", 3000, 20), ("sf0.1", minhash.BLOCK, minhash.MEMBERS)])
def test_agrees_with_brute_force(spark, sf, block, members):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = {tuple(r) for r in near_duplicates(docs, block=block, members=members).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def variants(n, edits, of=120, seed=0):
    """n texts, each the same words but for a few of its own."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = [f"w{j}" for j in range(of)]
        for j in rng.choice(of, edits, replace=False).tolist():
            words[j] = f"x{i}_{j}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("edits", [5, 8])
def test_large_groups_of_copies_around_the_limit(spark, edits):
    texts = variants(300, edits) + variants(60, edits, seed=1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {tuple(r) for r in near_duplicates(df, block=4000, members=50).collect()}
    assert got == brute(list(enumerate(texts)))


def test_sets_sent_grow_with_the_group(spark):
    sent = {}
    for n in (200, 2000):
        df = spark.createDataFrame(list(enumerate(variants(n, 1))), "doc_id bigint, text string")
        dealt = []
        real = minhash._compare
        minhash._compare = lambda d, *rest: dealt.append(d.count()) or real(d, *rest)
        try:
            assert near_duplicates(df, block=10_000).filter("kept").count() == 1
        finally:
            minhash._compare = real
        sent[n] = sum(dealt)
    assert sent[2000] < 12 * sent[200]


def test_odd_cases(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(9, None), (4, ""), (5, " \t\n"), (6, "A b"), (2, "a B"), (7, long), (3, long + " tail"), (8, "one two three four five six"), (8, "one two three four five six"), (None, "a b"), (1, "a b")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, rep string, component int")
    got = sorted(near_duplicates(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got] == [
        (1, 1, 1, True), (2, 1, 2, True), (3, 199_997, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 2, False), (7, 199_996, 3, False), (8, 2, 8, True), (8, 2, 8, True), (9, 0, 9, True), (None, 1, None, True),
    ]
    assert near_duplicates(df.limit(0)).count() == 0


def test_sketch_estimates_high_similarity():
    rng = np.random.default_rng(5)
    for shared in (0.75, 0.9):
        errors = []
        for _ in range(60):
            n = 2000
            core = rng.integers(0, 2**63, int(n * 2 * shared / (1 + shared)), dtype=np.uint64)
            a, b = (np.concatenate([core, rng.integers(0, 2**63, n - len(core), dtype=np.uint64)]) for _ in range(2))
            odd = minhash.odd_sketch(np.stack([minhash.minhash(a), minhash.minhash(b)]))
            errors.append(minhash.estimate(int(np.bitwise_count(odd[0] ^ odd[1]).sum())) - shared)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08
