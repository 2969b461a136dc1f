"""A file for each target, written by the tasks that hold its rows.

write_csv and write_windows deal targets out, and every task writes its targets one after the other into a folder of its
own. Folders become visible, one rename for each task, when the job has ended well; a failed one leaves nothing. The driver
sees no rows. A target's file is <target>.csv or <target>.npz in one of the folders.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.expr import KEY, broadcast_if_small, canonical
from ..functions.state import settled


@dataclass
class Folder(WriterCommitMessage):
    name: str | None


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


class _Writer(DataSourceArrowWriter):
    """Rows come sorted by target, the first column; a target is open until the next one begins."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.uri, self.kind, self.overwrite, self.run = options["path"], options.get("kind", "csv"), overwrite, uuid.uuid4().hex
        if self.kind not in ("csv", "npz"):
            raise ValueError(f"no target files of kind {self.kind!r}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Folder:
        where, base = _place(self.uri)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        folder = f"{base}/_{self.run}/{name}"
        now, write, done = None, None, set()
        for b in iterator:
            keys = b.column(0).to_pylist()
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for x, y in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if y == x:
                    continue
                if write is None or keys[x] != now:
                    if write is not None:
                        write(None)
                    now = keys[x]
                    if now in done:
                        raise ValueError(f"the rows of {now!r} are not together")
                    done.add(now)
                    where.create_dir(folder, recursive=True)
                    write = getattr(self, f"_{self.kind}")(where, f"{folder}/{quote(str(now), safe='')}.{self.kind}", b.schema.names[1:])
                write(b.slice(x, y - x))
        if write is not None:
            write(None)
        return Folder(name if done else None)

    def _csv(self, where: fs.FileSystem, path: str, names: list[str]):
        """A line for a row, written as it comes."""
        out = where.open_output_stream(path)
        out.write((",".join(names) + "\n").encode())

        def write(b: pa.RecordBatch | None) -> None:
            if b is None:
                out.close()
                return
            text = io.StringIO()
            csv.writer(text, lineterminator="\n").writerows(zip(*(["" if v is None else repr(v) if isinstance(v, float) else v for v in c.to_pylist()] for c in b.columns[1:]), strict=True))
            out.write(text.getvalue().encode())

        return write

    def _npz(self, where: fs.FileSystem, path: str, names: list[str]):
        """An array for each column; the rows of one target are held."""
        held: list[pa.RecordBatch] = []

        def write(b: pa.RecordBatch | None) -> None:
            if b is not None:
                held.append(b)
                return
            table = pa.Table.from_batches(held)
            arrays = {}
            for n in names:
                c = table.column(n).combine_chunks()
                arrays[n] = np.array(c.to_pylist(), np.float64 if pa.types.is_list(c.type) or pa.types.is_floating(c.type) else None)
            content = io.BytesIO()
            np.savez_compressed(content, **arrays)
            with where.open_output_stream(path) as out:
                out.write(content.getvalue())

        return write

    def commit(self, messages: list[Folder | None]) -> None:
        where, base = _place(self.uri)
        if self.overwrite and where.get_file_info(base).type == fs.FileType.Directory:
            for f in where.get_file_info(fs.FileSelector(base)):
                if f.type == fs.FileType.Directory and re.match(r"part-\d", f.base_name):
                    where.delete_dir(f.path)
        for m in messages:
            if m is not None and m.name:
                where.move(f"{base}/_{self.run}/{m.name}", f"{base}/{m.name}")
        self._clear()

    def abort(self, messages: list[Folder | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        where, base = _place(self.uri)
        if where.get_file_info(f"{base}/_{self.run}").type == fs.FileType.Directory:
            where.delete_dir(f"{base}/_{self.run}")


class TargetFiles(DataSource):
    """Options: path; kind, csv or npz. The first column is the target, and a task's rows must come sorted by it."""

    @classmethod
    def name(cls) -> str:
        return "target_files"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def _write(dealt: DataFrame, path: str, kind: str) -> None:
    dealt.sparkSession.dataSource.register(TargetFiles)
    dealt.write.format("target_files").option("kind", kind).mode("overwrite").save(path)


def write_csv(lc: DataFrame, path: str) -> None:
    """<target>.csv with the columns time and flux, in array order; missing values are empty."""
    _write(lc.repartition(KEY).sortWithinPartitions(KEY, "seq").select(KEY, "time", "flux"), path, "csv")


def write_windows(windows: DataFrame, path: str) -> None:
    """<target>.npz with the arrays flux, time and window_ids, in the order of windows."""
    _write(windows.repartition(KEY).sortWithinPartitions(KEY, "idx").select(KEY, "flux", "time", F.col("window_id").alias("window_ids")), path, "npz")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The curves that write_csv wrote. Lines are numbered by their place, which holds over the splits of a large file."""
    raw = spark.read.schema("time string, flux string").option("header", True).csv(f"{path}/part-*/*.csv")
    return in_file_order(raw, [_text_number("time").alias("time"), _text_number("flux").alias("flux")])


def _text_number(c: str) -> Column:
    x = F.lower(F.trim(F.col(c)))
    return canonical(F.when(x == "inf", F.lit(float("inf"))).when(x == "-inf", F.lit(float("-inf"))).otherwise(x.try_cast("double")))


def in_file_order(raw: DataFrame, columns: list[Column]) -> DataFrame:
    """(target_id, mission, seq, columns): seq is a line's place in its file, by the split that it was read in and its place there.

    raw is a scan of text files, so a row's file and the start of its split are known where it is read. A split's rows keep
    their order within a task; the rows of the splits before it are counted, one number a split, and no file is gathered.
    """
    d = raw.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), *columns)
    d = settled(d)  # ids stay what they were when the file was read
    names = [c for c in d.columns if not c.startswith("_")]
    splits = d.groupBy("_path", "_start").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("_first"))
    # the name is encoded once as a file's and once more as a path's
    stem = F.url_decode(F.url_decode(F.regexp_extract("_path", r"([^/]+?)(\.[^./]*)?$", 1)))
    splits = splits.select(F.col("_path").alias("_p"), F.col("_start").alias("_s"), "_first", (F.sum("n").over(Window.partitionBy("_path").orderBy("_start")) - F.col("n")).alias("_before"), stem.alias(KEY))
    j = d.join(broadcast_if_small(splits), (F.col("_path") == F.col("_p")) & (F.col("_start") == F.col("_s")))
    return j.select(KEY, F.lit("unknown").alias("mission"), (F.col("_before") + F.col("_id") - F.col("_first")).alias("seq"), *names)
