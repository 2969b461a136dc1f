import re

from test_minhash import brute
from test_packing import check
from test_secrets import ASSIGN, base

import corpus_pipeline as cp
from fluxframe.llm import gam

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(docs, items):
    runs = {}
    for t in items:
        w = words(t)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            runs.setdefault(k, set()).add(tuple(w[i : i + k]))
    out = set()
    for d, t in docs.items():
        w, hit = words(t), set()
        for k, known in runs.items():
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in known:
                    hit.update(range(i, i + k))
        if hit and 20 * len(hit) >= len(w):
            out.add(d)
    return out


def test_every_stage_agrees_with_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
        seen.append({r.doc_id: r.text for r in docs.collect()} if name != "packing" else docs.collect())
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    model = gam.train(whole, spark.read.parquet(f"{SF}/labels.parquet"))
    first = {r.doc_id: r.text for r in whole.collect()}
    good = {d for d, t in first.items() if model.score(gam.np.array([gam.features((t or "").encode())]))[0] >= gam.THRESHOLD}
    assert set(seen[0]) == good and len(good) > 0.75 * len(first)
    assert set(seen[1]) == {d for d, _, _, kept in brute(list(seen[0].items())) if kept}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(seen[2]) == set(seen[1]) - contaminated(seen[1], items) != set(seen[1])
    assert set(seen[3]) == set(seen[2]) and any(base(t) for t in seen[2].values()) and not any(ASSIGN.search(t) and base(t) for t in seen[3].values())
    assert all(seen[3][d] == t for d, t in seen[2].items() if not base(t) and "[" not in seen[3][d])
    check(seen[4], seen[3])
    ran = cp.run(spark, SF)
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in ran.collect()) == sorted((r.doc_id, r.start, r.ids_crc32) for r in seen[4])


def test_rows_that_share_an_id(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "totally different words of one more row"), (2, "A b c d e f"), (None, "a b c d e f"), (3, None)]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(((r.doc_id, r.text) for r in cp.near_duplicate(spark, df, SF).collect()), key=str)
    assert got == sorted([(1, "a b c d e f"), (1, "totally different words of one more row"), (3, None), (None, "a b c d e f")], key=str)


def test_odd_rows_pass_through_every_stage(spark):
    long = " ".join(f"word{i}" for i in range(30_000)) + " token = abcdef123"
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (3, " \n\t", "en", "s", 3), (4, long, "en", "s", 5), (4, long, "en", "s", 5), (None, "secret: whatever1 x", "en", None, 19), (6, "plain words of a short text here", "en", "s", 6)]
    clash = ["_gone", "_again", "_bad", "_mask_spans", "_in", "_key", "_spans", "id", "rep", "spans", "kept", "component_id", "words"]
    df = spark.createDataFrame([(*r, *range(len(clash))) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` int" for c in clash))
    for docs in (df, df.limit(0)):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, SF)
            if name == "packing":
                assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and (out.count() > 0) == (docs is df)
            else:
                assert out.columns == docs.columns
                got = out.collect()
                assert all([r[c] for c in clash] == list(range(len(clash))) for r in got) and (len(got) == 7 or docs is not df or name in ("quality_classifier", "near_dedup"))
                if name == "secrets" and docs is df:
                    assert {(r.doc_id, r.n_chars) for r in got if r.doc_id != 4} == {(1, None), (2, 0), (3, 3), (None, 10), (6, 32)}
