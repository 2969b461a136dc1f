"""Helpers shared by the text operators: checkpoints, checked broadcasts, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only if it is measured and has at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Bytes of a batch of rows that goes to a Python worker.
ARROW_BYTES = 8 << 20
#: White space of the word contracts, as a Java character class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a temporary folder stands in for it in local mode alone; on a cluster no executor would find it
    again, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            base = known.rsplit("/", 1)[0]
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            base = "file://" + tempfile.mkdtemp(prefix="shared_")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage; a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _row_bytes(df: DataFrame) -> Column:
    """What a row of df takes in memory, about: 16 bytes a column and the text of those that have no fixed size."""
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)
    sized = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in df.schema.fields if not isinstance(f.dataType, fixed)]
    total = F.lit(16 * len(df.columns)).cast("bigint")
    for size in sized:
        total = total + size
    return total


def is_small(df: DataFrame) -> bool:
    """df is measured to be within both limits of a broadcast. It is counted for that, up to the limit, so it should be cheap or cut() before."""
    n, held = df.select(_row_bytes(df).alias("b")).limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return n <= BROADCAST_ROWS and held <= BROADCAST_BYTES


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is small; else unchanged, so that Spark shuffles it."""
    return F.broadcast(df) if is_small(df) else df


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, whose session is set to hand Python ARROW_BYTES at once at most: rows hold whole texts, so a number of rows bounds nothing."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    df.sparkSession.conf.set(name, str(ARROW_BYTES))
    return df


def ascii_lower(col: Column | str) -> Column:
    """A-Z lower-cased, all else unchanged."""
    return F.translate(F.col(col) if isinstance(col, str) else col, UPPER, LOWER)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often then names it."""
    return F.transform(F.array(value), then)[0]


def held_out(doc_id: str) -> Column:
    """crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _state_of(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges(u, v), and whether they are stars: every u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    each = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("n"))
    r = each.agg(F.coalesce(F.sum("ups"), F.lit(0)).alias("n"), F.coalesce(F.max((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("n") > F.col("ups")))), F.lit(False)).alias("open")).first()
    return r["n"], not r["open"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) of every node that an edge touches; component is the smallest node reachable.

    Alternating large-star and small-star rounds: every round replaces a node's links by links to its smallest neighbour.
    A round is two partially aggregated minima and two joins. The minima are cut before they are joined, so each join
    stands right above two exchanges and Spark splits it where a node has very many links. Null ends, loops and repeated
    edges are ignored. No link or label reaches the driver but for the number of links and whether they are stars.
    """
    e = (
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = cut(e)
    for _ in range(max_rounds):
        n, stars = _state_of(e)
        if stars:
            break
        # a minimum has a row of two numbers for a node, and there are twice as many nodes as edges at most
        small = 2 * n <= BROADCAST_ROWS
        ready = F.broadcast if small else cut
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ready(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")))
        large = cut(both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = ready(large.groupBy("u").agg(F.min("v").alias("m")))
        e = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(e.union(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
