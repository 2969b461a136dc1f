"""FITS binary tables as a data source: spark.read.format("fits") and df.write.format("fits") after register(spark).

A file is read in ranges of table rows, so one large file makes many tasks, and only the columns of the given schema are
decoded. Of more than TASKS ranges, a task takes neighbours. A null text is written as an empty one. Files are opened through pyarrow's file systems (file, s3, gs, hdfs), which seek. Compressed files are one range
each. A task writes its rows to one file, which becomes visible when the whole job has ended well.
"""

from __future__ import annotations

import gzip
import io
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.expr import canonical
from .adapters import FITS_FLUX

# Fixed values of the FITS standard: type codes with their bytes, stored kind and Spark's type; blocks and cards.
KINDS = {"L": (1, "u1", "boolean"), "B": (1, "u1", "smallint"), "I": (2, ">i2", "smallint"), "J": (4, ">i4", "int"), "K": (8, ">i8", "bigint"), "E": (4, ">f4", "float"), "D": (8, ">f8", "double"), "A": (1, "S", "string")}
OTHER_BYTES = {"X": 1 / 8, "C": 8, "M": 16, "P": 8, "Q": 16}
BLOCK, CARD = 2880, 80
#: What every file tells besides its table's columns.
EXTRA = "_file string, _row bigint, _object string, _telescope string"
ROWS = 1_000_000
CHUNK_BYTES = 8 << 20
#: Ranges of up to so many are a task each; of more, a task takes neighbours up to its share of the bytes, at most TASK_BYTES. So small ranges and files make no tasks that cost more to start than to run.
TASKS, TASK_BYTES = 200, 16 << 20


@dataclass
class Column:
    name: str
    code: str
    count: int
    offset: int
    scale: float | None
    zero: float | None
    null: int | None

    @property
    def readable(self) -> bool:
        return self.code == "A" or self.code in KINDS and self.count == 1

    @property
    def type(self) -> str:
        return "double" if self.scale is not None or self.zero is not None else KINDS[self.code][2]

    def decode(self, table: np.ndarray, kind: pa.DataType) -> pa.Array:
        """The column of rows of bytes."""
        size = KINDS[self.code][0] * self.count
        raw = np.ascontiguousarray(table[:, self.offset : self.offset + size])
        if self.code == "A":
            return pa.array([x.decode("utf-8", "replace").rstrip(" ") for x in raw.view(f"S{size}")[:, 0]] if size else [""] * len(table), pa.string()).cast(kind)
        stored = raw.view(np.dtype(KINDS[self.code][1]))[:, 0]
        missing = stored == self.null if self.null is not None and self.code in "BIJK" else None
        if self.code == "L":
            return pa.array(stored == ord("T"), mask=stored == 0).cast(kind)
        value = stored.astype(stored.dtype.newbyteorder("="))
        if self.type == "double" and self.code != "D":
            value = value.astype(float) * (1.0 if self.scale is None else self.scale) + (self.zero or 0.0)
        return pa.array(value, mask=missing).cast(kind)


@dataclass
class Table:
    start: int
    width: int
    rows: int
    columns: dict[str, Column]
    about: dict[str, str]


def _cards(source) -> dict[str, str]:
    out: dict[str, str] = {}
    while True:
        block = source.read(BLOCK)
        if len(block) < BLOCK:
            raise ValueError("the header is cut off")
        for i in range(0, BLOCK, CARD):
            card = bytes(block[i : i + CARD]).decode("ascii", "replace")
            if card[:8].strip() == "END":
                return out
            if card[8:10] == "= ":
                value = card[10:].strip()
                out[card[:8].strip()] = value[1:].split("'")[0].strip() if value.startswith("'") else value.split("/")[0].strip()


def read_header(source) -> Table:
    """The first binary table of a file that is open at its start; only headers are read."""
    about: dict[str, str] = {}
    at = 0
    while True:
        source.seek(at)
        c = _cards(source)
        at = source.tell()
        about |= {k: c[k] for k in ("OBJECT", "TELESCOP") if k in c and k not in about}
        axes = [int(c[f"NAXIS{i + 1}"]) for i in range(int(c.get("NAXIS", "0")))]
        if c.get("XTENSION") == "BINTABLE":
            columns, offset = {}, 0
            for i in range(1, int(c["TFIELDS"]) + 1):
                form = c[f"TFORM{i}"]
                digits = len(form) - len(form.lstrip("0123456789"))
                count, code = int(form[:digits] or 1), form[digits]
                number = lambda k: float(c[k].upper().replace("D", "E")) if k in c else None  # noqa: E731, B023
                name = c.get(f"TTYPE{i}", f"COLUMN{i}")
                columns[name] = Column(name, code, count, offset, number(f"TSCAL{i}"), number(f"TZERO{i}"), int(c[f"TNULL{i}"]) if f"TNULL{i}" in c else None)
                offset += int(np.ceil((KINDS[code][0] if code in KINDS else OTHER_BYTES[code]) * count))
            return Table(at, axes[0], axes[1], columns, about)
        size = abs(int(c.get("BITPIX", "8"))) // 8 * (int(np.prod(axes)) + int(c.get("PCOUNT", "0"))) if axes else 0
        at += -(-size // BLOCK) * BLOCK


def _open(uri: str):
    """A seekable file; a compressed one is unpacked whole."""
    where, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))
    source = where.open_input_file(path)
    if uri.endswith(".gz"):
        return io.BytesIO(gzip.decompress(source.read()))
    return source


def _files(uri: str) -> list[str]:
    where, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))
    base = uri[: len(uri) - len(path)] if "://" in uri and uri.endswith(path) else ""
    if where.get_file_info(path).type == fs.FileType.File:
        return [uri]
    found = where.get_file_info(fs.FileSelector(path, recursive=True))
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(path) :].strip("/").split("/"))
    return sorted(base + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".fits", ".fit", ".fits.gz")) and not hidden(f.path))


@dataclass
class Rows:
    uri: str
    first: int
    count: int


@dataclass
class Task(InputPartition):
    ranges: list[Rows]


def _dealt(found: list[tuple[Rows, int]]) -> list[Task]:
    """Tasks of ranges and their bytes, in order; neighbours in a file become one range."""
    if len(found) <= TASKS:
        return [Task([r]) for r, _ in found]
    share = min(TASK_BYTES, -(-sum(b for _, b in found) // TASKS))
    out: list[Task] = []
    held = share
    for r, size in found:
        if held >= share:
            out.append(Task([]))
            held = 0
        own = out[-1].ranges
        if own and own[-1].uri == r.uri and own[-1].first + own[-1].count == r.first:
            own[-1].count += r.count
        else:
            own.append(r)
        held += size
    return out


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema, self.uri, self.rows = schema, options["path"], int(options.get("rowsPerPartition", ROWS))

    def partitions(self) -> list[Task]:
        found = []
        for uri in _files(self.uri):
            with _open(uri) as source:
                table = read_header(source)
            n = table.rows
            step = n if uri.endswith(".gz") else self.rows
            ranges = (Rows(uri, i, min(step, n - i)) for i in range(0, n, max(step, 1)))
            found += [(r, r.count * table.width) for r in ranges]
        return _dealt(found) or [Task([])]

    def read(self, task: Task) -> Iterator[pa.RecordBatch]:
        for part in task.ranges:
            yield from self._read(part)

    def _read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        with _open(part.uri) as source:
            table = read_header(source)
            known = {k.lower(): c for k, c in table.columns.items()}
            source.seek(table.start + part.first * table.width)
            step = max(1, CHUNK_BYTES // max(table.width, 1))
            for at in range(part.first, part.first + part.count, step):
                n = min(step, part.first + part.count - at)
                content = source.read(n * table.width)
                if len(content) < n * table.width:
                    raise ValueError(f"{part.uri} ends before row {at + n}")
                rows = np.frombuffer(content, np.uint8).reshape(n, table.width)
                extra = {"_file": lambda n=n: pa.array([part.uri] * n), "_row": lambda at=at, n=n: pa.array(np.arange(at, at + n)), "_object": lambda n=n: pa.array([table.about.get("OBJECT")] * n, pa.string()), "_telescope": lambda n=n: pa.array([table.about.get("TELESCOP")] * n, pa.string())}
                out = []
                for f in arrow:
                    if f.name in extra:
                        out.append(extra[f.name]().cast(f.type))
                    elif f.name.lower() in known and known[f.name.lower()].readable:
                        out.append(known[f.name.lower()].decode(rows, f.type))
                    else:
                        out.append(pa.nulls(n, f.type))  # a file that has no such column
                yield pa.RecordBatch.from_arrays(out, schema=arrow)


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class _Writer(DataSourceArrowWriter):
    """A file for each task, under a hidden folder until all have ended; a failed job leaves none."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool) -> None:
        self.schema, self.uri, self.overwrite, self.run = schema, options["path"], overwrite, uuid.uuid4().hex
        self.text = int(options.get("stringWidth", 32))
        codes = {T.BooleanType: "L", T.ShortType: "I", T.IntegerType: "J", T.LongType: "K", T.FloatType: "E", T.DoubleType: "D", T.StringType: "A"}
        for f in schema:
            if type(f.dataType) not in codes:
                raise ValueError(f"FITS has no type for column {f.name}")
        self.codes = [codes[type(f.dataType)] for f in schema]

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri) if "://" in self.uri else (fs.LocalFileSystem(), self.uri.removeprefix("file:"))

    def _record(self) -> np.dtype:
        return np.dtype([(f"c{i}", f"S{self.text}" if c == "A" else KINDS[c][1]) for i, c in enumerate(self.codes)])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        kind, n = self._record(), 0
        with tempfile.TemporaryFile() as held:  # the header comes first and has the number of rows
            for b in iterator:
                rows = np.zeros(b.num_rows, kind)
                for i, (code, column) in enumerate(zip(self.codes, b.columns, strict=True)):
                    if code == "A":
                        texts = [(x or "").encode() for x in column.to_pylist()]
                        if any(len(x) > self.text for x in texts):
                            raise ValueError(f"a text of {self.schema[i].name} is longer than stringWidth={self.text}")
                        rows[f"c{i}"] = [x.ljust(self.text) for x in texts]
                    elif code == "L":
                        rows[f"c{i}"] = [0 if x is None else ord("T") if x else ord("F") for x in column.to_pylist()]
                    elif code in "ED":
                        rows[f"c{i}"] = column.to_numpy(zero_copy_only=False)
                    else:
                        rows[f"c{i}"] = column.fill_null(self._null(code)).to_numpy(zero_copy_only=False)
                held.write(rows.tobytes())
                n += b.num_rows
            if not n:
                return Written(None)
            where, base = self._place()
            task = TaskContext.get()
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.fits"
            where.create_dir(f"{base}/_{self.run}", recursive=True)
            with where.open_output_stream(f"{base}/_{self.run}/{name}") as out:
                out.write(self._header(n, kind.itemsize))
                held.seek(0)
                while block := held.read(CHUNK_BYTES):
                    out.write(block)
                out.write(b"\0" * (-n * kind.itemsize % BLOCK))
        return Written(name)

    def _null(self, code: str) -> int:
        return int(np.iinfo(np.dtype(KINDS[code][1])).min)

    def _header(self, rows: int, width: int) -> bytes:
        def block(cards: list[tuple[str, object]]) -> bytes:
            text = lambda v: "T" if v is True else str(v) if isinstance(v, int) else f"'{v:<8}'"
            body = "".join(f"{k:<8}= {text(v):>20}".ljust(CARD) for k, v in cards) + "END".ljust(CARD)
            return body.encode().ljust(-(-len(body) // BLOCK) * BLOCK)

        fields = []
        for i, (f, code) in enumerate(zip(self.schema, self.codes, strict=True), 1):
            fields += [(f"TTYPE{i}", f.name), (f"TFORM{i}", f"{self.text}A" if code == "A" else code)]
            if code in "IJK":
                fields.append((f"TNULL{i}", self._null(code)))
        table = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", rows), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(self.codes)), *fields]
        return block([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0)]) + block(table)

    def commit(self, messages: list[Written | None]) -> None:
        where, base = self._place()
        if self.overwrite and where.get_file_info(base).type == fs.FileType.Directory:
            for f in where.get_file_info(fs.FileSelector(base)):
                if f.type == fs.FileType.File:
                    where.delete_file(f.path)
        where.create_dir(base, recursive=True)
        for m in messages:
            if m is not None and m.path:
                where.move(f"{base}/_{self.run}/{m.path}", f"{base}/{m.path}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        where, base = self._place()
        if where.get_file_info(f"{base}/_{self.run}").type == fs.FileType.Directory:
            where.delete_dir(f"{base}/_{self.run}")


class FitsSource(DataSource):
    """Options: path, a file or folder; rowsPerPartition; stringWidth, the bytes of a text in files that are written."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        found = _files(self.options["path"])
        if not found:
            return EXTRA
        with _open(found[0]) as source:
            columns = read_header(source).columns.values()
        return ", ".join([*(f"`{c.name}` {c.type}" for c in columns if c.readable), EXTRA])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FitsSource)


def read_curves(spark: SparkSession, path: str, rows_per_partition: int = ROWS) -> DataFrame:
    """Light curves of FITS files with a TIME column and one of FITS_FLUX, a file a curve: two columns are decoded, in as many tasks as its ranges of rows."""
    register(spark)
    read = spark.read.format("fits").option("rowsPerPartition", rows_per_partition)
    names = {c.upper(): c for c in read.load(path).columns}
    flux = next((names[n] for n in FITS_FLUX if n in names), None)
    if "TIME" not in names or flux is None:
        raise ValueError(f"no time and flux among {sorted(names)}")
    d = read.schema(f"{EXTRA}, `{names['TIME']}` double, `{flux}` double").load(path)
    stem = F.regexp_extract("_file", r"([^/]+?)(\.[^./]*)*$", 1)
    return d.select(F.coalesce("_object", stem).alias("target_id"), F.coalesce("_telescope", F.lit("unknown")).alias("mission"), F.col("_row").alias("seq"), canonical(names["TIME"]).alias("time"), canonical(flux).alias("flux"))
