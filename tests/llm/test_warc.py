import gzip
import hashlib
from pathlib import Path

from oracle import assert_same

from fluxframe.llm.warc import ORACLE, read_archives, warc_query, with_originals, write_archives

SF = "/root/testdata/sf0.01"


def test_agrees_with_sql(spark):
    assert_same(warc_query(spark, SF), ORACLE, SF)


def test_headers_alone_meet_many_repeated_digests(spark, monkeypatch):
    from fluxframe.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert_same(warc_query(spark, SF), ORACLE, SF)


def test_round_trip_of_odd_payloads(spark, tmp_path):
    odd = ["", None, "a\r\n\r\nb", "\r\n\r\n", "x" * 99 + "\r", "\r\n" * 120, "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9, "é" * 200_000, "\n", "\r\n\r\n\r"]
    rows = [(i, f"http://a/{i}\r\nX: y", h) for i, h in enumerate(odd)] + [(50, None, "é" * 200_000), (40, "u", "é" * 200_000), (41, "u", ""), (5, "u", odd[5]), (None, "u", odd[5]), (None, None, "lone" * 40)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id int, url string, html string, digest string, payload_bytes int")
    path = f"{tmp_path}/warc"
    write_archives(df, path)
    records = read_archives(spark, path).collect()
    assert len(records) == len(rows)
    full = {(r.page_id, bytes(r.payload)) for r in records if r.record_type == "response"}
    assert full == {(i, (h or "").encode()) for i, h in enumerate(odd)} | {(41, b""), (None, b"lone" * 40)}
    got = {(r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in with_originals(read_archives(spark, path)).collect()}
    big, six = odd[7].encode(), odd[5].encode()
    assert {x for x in got if x[1] == "revisit"} == {(p, "revisit", len(b), hashlib.sha256(b).hexdigest(), o) for p, b, o in ((50, big, 7), (40, big, 7), (None, six, 5))}
    assert any(gzip.open(f).read().startswith(b"WARC/1.1\r\n") for f in Path(path).glob("*.gz"))
    write_archives(df.limit(0), path)
    assert read_archives(spark, path).count() == 0 and with_originals(read_archives(spark, path)).count() == 0


def test_payloads_that_end_with_line_ends(spark, tmp_path):
    ends = ["\r\n", "\r\n" * 3, "\r\n" * 2, "\n\r\n", "\r\r\n", "\r\n\r"]
    pages = [e for e in ends] + [f"<p>{i}</p>\r\n<p>line</p>{e}" for i, e in enumerate(ends)] + ["x" * 150 + "\r\n", "x" * 150 + "\r\n", "last\r\n"]
    df = spark.createDataFrame([(i, f"http://a/{i}", h) for i, h in enumerate(pages)], "page_id int, url string, html string")
    for parts in (1, 5):  # every file ends with such a payload at some place, and one task reads several files
        path = f"{tmp_path}/warc{parts}"
        write_archives(df.repartition(parts), path)
        records = read_archives(spark, path).collect()
        assert len(records) == len(pages) and [r.page_id for r in records if r.record_type == "revisit"] == [13]
        assert {r.page_id: bytes(r.payload).decode() for r in records if r.payload is not None} == {i: h for i, h in enumerate(pages) if i != 13}
    write_archives(df.filter("page_id = 14"), f"{tmp_path}/one")
    assert [bytes(r.payload) for r in read_archives(spark, f"{tmp_path}/one").collect()] == [b"last\r\n"]
