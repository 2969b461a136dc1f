"""WARC archives with revisit records.

Headers (page, digest, size) are shuffled by payload digest and reduced to the smallest page of each digest that repeats.
Payloads are never dealt by digest, so a page that very many sites serve makes no large task: few repeated digests are
broadcast, else headers alone meet them, and the pages that repeat others are told to the payloads by page. Records are written by Spark's own text sink: with
CR LF CR LF as the line separator, which ends every WARC record, a row becomes a record, executors commit their files as
for any other output, and a lost one is repeated. Archives are gzip files, so a file is read by one task as a stream; the
reader follows Content-Length and holds one record at a time. Revisits are resolved by joining them to the records that
they refer to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_small_batches, is_small, maybe_broadcast, shared_dir

END = "\r\n\r\n"
#: Smaller payloads are always written in full: a revisit record would save nothing.
LEAST_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id bigint, record_id string, record_type string, refers_to_id string, url string, digest string, payload binary"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x00", *(F.coalesce(p.cast("string"), F.lit("\x01")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if a > 1 else ()) + (F.substring(h, a, n),)), F.lit(">"))


def resolve(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, original): original is the page that a revisit repeats, else null."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "digest": F.sha2(F.col("payload").cast("binary"), 256)})
    headers = rows.filter(F.col("payload_bytes") >= least_bytes).select("page_id", "digest")
    repeated = cut(headers.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").drop("n"))
    if is_small(repeated):
        joined = rows.join(F.broadcast(repeated), "digest", "left")
    else:
        named = cut(headers.join(repeated, "digest").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "first").distinct())
        joined = rows.join(maybe_broadcast(named), F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").drop("_page", "_digest")
    return joined.withColumn("original", F.expr("case when first is not null and not (page_id <=> first) then first end")).drop("first")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None, least_bytes: int = LEAST_BYTES) -> None:
    """One record per row of pages into gzip archives under path, which is replaced.

    Of rows with equal payloads of at least least_bytes, those with the smallest id are responses and the others revisit
    them. A null payload is empty, a null URL has no target, line breaks in one are escaped. Rows that repeat the smallest
    id are all responses. A very long payload is one record, which its task holds whole. An empty table writes an archive
    without records. Other columns are not looked at, whatever their names.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    r = resolve(pages, id_col, url_col, html_col, least_bytes)
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        line("WARC-Record-ID", _uuid(F.lit("page"), F.col("page_id"), F.when(F.col("page_id").isNull(), F.col("digest")))), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        F.when(revisit, F.concat(line("WARC-Refers-To", _uuid(F.lit("page"), F.col("original"), F.lit(None).cast("string"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit(END), block,
    )
    r.select(record.alias("value")).write.mode("overwrite").text(path, compression="gzip", lineSep=END)


def parse(chunks: Iterator[bytes]) -> Iterator[tuple]:
    """Records of a stream that is given without its separators: the stream is every chunk followed by CR LF CR LF.

    Records are told by Content-Length alone: a block that ends with CR LF moves the cuts after it by two bytes. The last
    chunk of a file has no separator then, and the one that is added to it is left over and dropped.
    """
    end = END.encode()
    held = b""
    while True:
        if held in (b"", end):
            chunk = next(chunks, None)
            if chunk is None:
                return
            held = chunk + end
        head, _, held = held.partition(end)
        lines = head.split(b"\r\n")
        if lines[0] != b"WARC/1.1":
            raise ValueError(f"no record starts with {head[:60]!r}")
        named = dict(x.split(b": ", 1) for x in lines[1:])
        need = int(named[b"Content-Length"])
        parts, size = [held], len(held)
        while size < need + len(end):
            chunk = next(chunks, None)
            if chunk is None:
                raise ValueError(f"a block has less than the {need} bytes that its record says")
            parts += (chunk, end)
            size += len(chunk) + len(end)
        whole = b"".join(parts)
        if not whole.startswith(end, need):
            raise ValueError(f"a block does not end after the {need} bytes that its record says")
        held = whole[need + len(end) :]
        at = whole.find(end, 0, need)
        payload = whole[at + len(end) : need] if at >= 0 else b""
        text = lambda k: named[k].decode() if k in named else None
        page = text(b"X-Page-ID")
        kind = text(b"WARC-Type")
        digest = hashlib.sha256(payload).hexdigest() if kind == "response" else None
        stated = text(b"WARC-Payload-Digest").removeprefix("sha256:")
        if digest not in (None, stated):
            raise ValueError(f"the payload of page {page} does not have its digest")
        yield page if page is None else int(page), text(b"WARC-Record-ID"), kind, text(b"WARC-Refers-To"), text(b"WARC-Target-URI"), stated, payload if kind == "response" else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.binary()]
    rows: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for r in parse(x.as_buffer().to_pybytes() for b in batches for x in b.column(0)):
        rows.append(r)
        size += len(r[-1] or b"")
        if len(rows) >= 2000 or size > 8_000_000:
            yield out()
            rows, size = [], 0
    if rows:
        yield out()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under path; payload is null for revisits. A damaged record ends the job."""
    chunks = spark.read.text(path, lineSep=END).select(F.col("value").cast("binary").alias("value"))
    return in_small_batches(chunks).mapInArrow(_read, RECORDS)


def with_originals(records: DataFrame) -> DataFrame:
    """(page_id, record_type, payload_bytes, payload_digest, refers_to): revisits take size and page from what they refer to."""
    slim = cut(records.select("page_id", "record_id", "record_type", "refers_to_id", "digest", F.octet_length("payload").cast("bigint").alias("bytes")))
    wanted = slim.filter("record_type = 'revisit'").select(F.col("refers_to_id").alias("wanted")).distinct()
    originals = slim.filter("record_type = 'response'").join(wanted, F.col("record_id") == F.col("wanted"), "left_semi").groupBy("record_id").agg(F.min("page_id").alias("refers_to"), F.min("bytes").alias("full"))
    originals = cut(originals)
    revisits = slim.filter("record_type = 'revisit'").drop("record_id").join(maybe_broadcast(originals), F.col("refers_to_id") == F.col("record_id"))
    both = slim.filter("record_type = 'response'").select("page_id", "record_type", "bytes", "digest", F.lit(None).cast("bigint").alias("refers_to"))
    both = both.unionByName(revisits.select("page_id", "record_type", F.col("full").alias("bytes"), "digest", "refers_to"))
    return both.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/warc_{hashlib.md5(sf_dir.encode()).hexdigest()}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return with_originals(read_archives(spark, path))


ORACLE = f"""
with p as (select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as original from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes < {LEAST_BYTES} or page_id = original then 'response' else 'revisit' end as record_type,
  case when payload_bytes >= {LEAST_BYTES} and page_id <> original then original end as refers_to from f"""
