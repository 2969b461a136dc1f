import zlib

import numpy as np

from fluxframe.llm import gam

SF = "/root/testdata/sf0.1"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in gam.quality_query(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [r for r in labels if got[r.doc_id].held_out]
    y, s = np.array([r.quality for r in held]), np.array([got[r.doc_id].score for r in held])
    p = np.array([got[r.doc_id].predicted for r in held])
    print(auc(y, s), (p == y).mean(), p[y == 1].mean(), p[y == 0].mean())
    assert auc(y, s) > 0.85 and p[y == 1].mean() > 0.95 and (p == y).mean() > 0.9


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x, y)
    assert any(p[0] == (0, 1) for p in model.pairs) and auc(y, model.score(x)) > 0.95


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (None, "b c"), (6, "word " * 300_000), (7, "\n\n|\n|")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (4, 0), (None, 1), (7, None)], "doc_id int, quality int")
    got = gam.classify(docs, gam.train(docs, labels)).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert gam.classify(docs.limit(0), gam.train(docs.limit(0), labels.limit(0))).count() == 0
    kept = gam.keep_good(docs, gam.train(docs, labels))
    assert kept.columns == docs.columns


def test_scores_are_sums_of_table_entries(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = gam.train(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    place = lambda edges, v: sum(e <= v for e in edges)
    got = {r.doc_id: r.score for r in gam.classify(docs, model).collect()}
    for r in docs.collect():
        x = gam.features((r.text or "").encode())
        z = model.bias + sum(t[place(e, v)] for e, t, v in zip(model.edges, model.tables, x, strict=True))
        z += sum(t[place(ef, x[f]), place(eg, x[g])] for (f, g), ef, eg, t in model.pairs)
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9


def test_a_shared_id_counts_once(spark):
    docs = spark.createDataFrame([(i % 50, f"word{i} " * (i % 7 + 1)) for i in range(500)], "doc_id int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] * 3, "doc_id int, quality int")
    sample = gam.labelled_sample(docs, labels, "doc_id", "text", "quality", 10)
    assert sample.select("key").distinct().count() == 10 and sample.count() == 100
    a, b = (gam.train(d, labels, bound=10) for d in (docs, docs.repartition(7)))
    assert a.bias == b.bias and all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))
