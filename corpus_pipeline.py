"""A corpus pipeline of five stages: each takes what its predecessor kept, and its decisions take effect."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxframe.llm import gam
from fluxframe.llm.common import cut, maybe_broadcast, shared_dir
from fluxframe.llm.decontaminate import decontaminate
from fluxframe.llm.minhash import near_duplicates
from fluxframe.llm.packing import pack_documents
from fluxframe.llm.secrets import mask_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts; it learns from the labelled rows among docs.

    Null, empty and very long texts are scored like others, repeated rows alike; an empty table leaves an empty one, and
    columns other than doc_id and text are passed on unread.
    """
    model = gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return gam.keep_good(docs, model)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Rows that share an id are one document: it goes or stays as a whole, and of its rows with equal texts one stays. Rows
    without an id, and null or empty texts, stay; a very long text is compared whole. An empty table leaves an empty one;
    columns other than doc_id and text are passed on unread, whatever their names.
    """
    found = cut(near_duplicates(docs))
    gone = maybe_broadcast(found.filter("not kept").select(F.col("doc_id").alias("id")).distinct())
    left = docs.join(gone, docs["doc_id"] == gone["id"], "left_anti")
    again = cut(found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("id")))
    if again.isEmpty():
        return left
    again = maybe_broadcast(again)
    shared = left.join(again, left["doc_id"] == again["id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, left["doc_id"] == again["id"], "left_anti").unionByName(shared)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the benchmark does not contaminate.

    Rows that share an id go together; rows without an id, and null or empty texts, stay; a very long text is read whole.
    An empty table on either side is fine; columns other than doc_id and text are passed on unread, whatever their names.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their secrets masked and n_chars counted anew; a null text keeps both.

    Very long texts cost in proportion to their length, repeated rows are masked alike, an empty table leaves an empty one,
    and columns other than doc_id, text, source and n_chars are passed on unread, whatever their names.
    """
    return mask_secrets(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized rows with their sequences.

    A null or empty text is its end id alone, a very long one is cut into full windows and a rest, repeated rows are packed
    each, and an empty table gives no piece. Columns other than doc_id and text are not looked at.
    """
    packed = pack_documents(docs, with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_classifier", quality), ("near_dedup", near_duplicate), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]
#: A learned stage and a tokenizer are not expressible in SQL; tests/llm/test_pipeline.py holds it against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again.

    What a stage wrote is removed when the next one is written, but for the last, which the returned rows are read from.
    """
    base = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/pipeline_{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            _remove(spark, before)
        before = f"{base}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
