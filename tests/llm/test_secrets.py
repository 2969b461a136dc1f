import hashlib
import re
import time

from pyspark.sql import functions as F

from fluxframe.llm.secrets import mask_secrets, scan_secrets, secrets_query

SF = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)]


def test_base_spans_agree_with_brute_force(spark):
    got = {r.doc_id: r for r in secrets_query(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(docs) == len(got)
    some = 0
    for d in docs:
        want = base(d.text or "")
        r = got[d.doc_id]
        some += bool(want)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(r.spans.split(",")) | {""}
    assert some > 10


def _frame(spark):
    opaque = "Zx9" + "Qw3rTy7uIo1pAs5d" * 3
    shared = "Aa1" + "bC2dE3fG4hI5jK6l" * 3
    rows = [
        (1, "é password = 'hunter22' end", "a"), (2, None, "a"), (3, "", None), (4, f"x {opaque} y", "a"), (4, f"x {opaque} y", "a"),
        *((10 + i, f"see {shared}!", f"o{i}") for i in range(4)),
        (20, "token=abc token==abcdef AKIA" + "B" * 16 + " " + "a1" * 15, "b"), (None, "secret: whatever1", "b"), (21, "secret: whatever1 " * 3000, "c"),
    ]
    return spark.createDataFrame(rows, "doc_id int, text string, source string").withColumn("spans", F.lit("clash")).withColumn("copied", F.lit(1))


def test_ownership_and_odd_rows(spark):
    got = [(r.doc_id, [(s.kind, s.start, s.end, s.copied) for s in r.spans]) for r in scan_secrets(_frame(spark)).collect()]
    by = {}
    for d, s in got:
        by.setdefault(d, []).append(s)
    assert len(got) == 12 and by[2] == [[]] and by[3] == [[]]
    assert by[1] == [[("assign", 2, 22, False)]]
    assert by[4] == [[("opaque", 2, 53, False)]] * 2  # one owner: looks live
    assert all(by[10 + i] == [[]] for i in range(4))  # four owners: an example, so the opaque string adds nothing
    assert [k for k, *_ in by[20][0]] == ["assign", "access", "hex"] and by[None][0][0][0] == "assign"
    assert len(by[21][0]) == 3000
    assert scan_secrets(_frame(spark).limit(0)).count() == 0


def test_masking_keeps_rows_and_columns(spark):
    df = _frame(spark)
    out = mask_secrets(df)
    assert out.columns == df.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert out.count() == 12 and text[1] == "é [secret]' end" and text[2] is None and "whatever1" not in text[21]


def test_many_repositories_of_one_owner_are_an_example(spark):
    rows = [(i, "token = manual-example-1", "hot") for i in range(120)] + [(i, "token = own-live-value-2", "hot") for i in range(200, 250)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r.doc_id: r.spans[0].copied for r in scan_secrets(df).collect()}
    assert all(got[i] for i in range(120)) and not any(got[i] for i in range(200, 250))


def test_a_long_dump_costs_in_proportion(spark):
    took = {}
    for n in (2_000, 100_000):  # 5 MB
        text = "é " + "secret: whatever1 token=é password = 'hunter22x' " * n
        df = spark.createDataFrame([(1, text, "a")], "doc_id int, text string, source string")
        began = time.time()
        r = mask_secrets(df).select("text").first()
        took[n] = time.time() - began
        assert r.text == "é " + "[secret] token=é [secret]' " * n
    assert took[100_000] < 60


def test_overlaps_are_merged(spark):
    text = "x secret=" + "0a" * 20 + "Zz9-" + "AKIA" + "B1" * 12 + " é end"
    df = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (1, "plain", "b"), (2, None, None)], "doc_id int, text string, source string").withColumn("_key", F.lit(1)).withColumn("_spans", F.lit(2))
    out = mask_secrets(df)
    assert out.columns == df.columns and sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, "plain"), (1, "x [secret] é end"), (1, "x [secret] é end"), (2, "")]
