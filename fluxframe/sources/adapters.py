"""Readers: every input becomes rows (target_id, mission, seq, time, flux), many curves in one table."""

from __future__ import annotations

import io
import struct
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import canonical
from ..schema import LIGHT_CURVE

# Column names that are tried, in this order.
TIME_NAMES = ("time", "bjd", "bkjd", "btjd", "t")
FLUX_NAMES = ("flux", "pdcsap_flux", "sap_flux", "f")
FITS_FLUX = ("PDCSAP_FLUX", "SAP_FLUX", "FLUX")
#: Rows of curves that a task holds at most, but for a single longer curve: windows take some 4 KB of memory for each and reports 18 KB.
ROWS_A_TASK = 75_000


def detect_input_type(data) -> str:
    """One of fits, csv, npy, parquet, lightkurve, spark, dataframe, array_pair, array_2d; ValueError otherwise."""
    if isinstance(data, (str, PurePosixPath)):
        name = str(data).lower()
        for kind, ends in (("fits", (".fits", ".fits.gz", ".fit")), ("csv", (".csv",)), ("npy", (".npy",)), ("parquet", (".parquet",))):
            if name.endswith(ends):
                return kind
        raise ValueError(f"no reader for {data!r}")
    if isinstance(data, DataFrame):
        return "spark"
    if isinstance(data, pd.DataFrame):
        return "dataframe"
    if hasattr(data, "time") and hasattr(data, "flux"):
        return "lightkurve"
    if isinstance(data, (tuple, list)) and len(data) == 2:
        return "array_pair"
    if isinstance(data, np.ndarray) and data.ndim == 2 and data.shape[1] == 2:
        return "array_2d"
    raise ValueError(f"no reader for {type(data).__name__}")


def pick_columns(columns: list[str], time_col: str | None = None, flux_col: str | None = None) -> tuple[str, str]:
    """The names of the time and flux columns: those given, or the first known ones whatever their case."""
    lower = {c.lower(): c for c in columns}
    found = []
    for given, known, what in ((time_col, TIME_NAMES, "time"), (flux_col, FLUX_NAMES, "flux")):
        name = given or next((lower[k] for k in known if k in lower), None)
        if name is None or name not in columns:
            raise ValueError(f"no {what} column among {columns}")
        found.append(name)
    return found[0], found[1]


def from_arrays(spark: SparkSession, time, flux, target_id: str = "unknown", mission: str = "unknown") -> DataFrame:
    """Vectors of equal length in array order."""
    t, f = (np.asarray(x, dtype=np.float64).ravel() for x in (time, flux))
    if len(t) != len(f):
        raise ValueError(f"time and flux length mismatch: {len(t)} vs {len(f)}")
    pdf = pd.DataFrame({"target_id": target_id, "mission": mission, "seq": np.arange(len(t)), "time": t, "flux": f})
    return spark.createDataFrame(pdf, LIGHT_CURVE).withColumns({"time": canonical("time"), "flux": canonical("flux")})


def from_table(df: DataFrame, time_col: str | None = None, flux_col: str | None = None, order_by: list[Column | str] | None = None, target: Column | str | None = None, mission: Column | str | None = None) -> DataFrame:
    """Light curves from any table. target and mission are columns or expressions; without target it is one curve.

    order_by gives array order within a curve; without it, time does. The key is renamed before seq is computed, so one
    exchange serves this and all later steps.
    """
    t, f = pick_columns(df.columns, time_col, flux_col)
    as_col = lambda c, default: F.lit(default) if c is None else F.col(c) if isinstance(c, str) else c
    order = order_by or [t, f]
    d = df.withColumns({"_target": as_col(target, "unknown").cast("string"), "_mission": as_col(mission, "unknown").cast("string")})
    d = d.select(F.col("_target").alias("target_id"), F.col("_mission").alias("mission"), canonical(t).alias("time"), canonical(f).alias("flux"), *(as_col(o, None).alias(f"_o{i}") for i, o in enumerate(order)))
    by = Window.partitionBy("target_id").orderBy(*(f"_o{i}" for i in range(len(order))))
    return d.withColumn("seq", (F.row_number().over(by) - 1).cast("bigint")).select("target_id", "mission", "seq", "time", "flux")


def _number(c: str) -> Column:
    """A double from text as numeric files write it: empty and nan are missing, inf is infinite."""
    x = F.lower(F.trim(F.col(c)))
    return F.when(x.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf"))).when(x.isin("-inf", "-infinity"), F.lit(float("-inf"))).otherwise(x.try_cast("double"))


def read_csv(spark: SparkSession, path: str, time_col: str | None = None, flux_col: str | None = None, order_by: list[str] | None = None, target: str | None = None) -> DataFrame:
    """CSV files with a header. A file is a curve, named after it, unless target names a column; lines are in array order.

    Columns are read as text, so infinite values are kept. A line's order is that of its split in the file, then that of
    the line in its split, so files of many splits come in order too.
    """
    raw = spark.read.option("header", True).csv(path)
    t, f = pick_columns(raw.columns, time_col, flux_col)
    d = raw.select(*(c for c in raw.columns if c not in (t, f)), _number(t).alias(t), _number(f).alias(f), F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)*$", 1).alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"))
    return from_table(d, t, f, order_by or ["_start", "_line"], target or "_file")


def parse_npy(content: bytes) -> np.ndarray:
    a = np.load(io.BytesIO(content), allow_pickle=False)
    if a.ndim != 2 or a.shape[1] != 2:
        raise ValueError(f"expected two columns, found shape {a.shape}")
    return a.astype(np.float64)


def _fits_header(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Cards of one header and the place after it; headers are blocks of 2880 bytes of 80-byte cards."""
    cards: dict[str, str] = {}
    while True:
        block = data[at : at + 2880]
        if len(block) < 2880:
            raise ValueError("the header is cut off")
        at += 2880
        for i in range(0, 2880, 80):
            card = block[i : i + 80].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards, at
            if card[8:10] == "= ":
                value = card[10:]
                cards[key] = value.split("'")[1].strip() if value.lstrip().startswith("'") else value.split("/")[0].strip()


def parse_fits(content: bytes) -> tuple[np.ndarray, dict[str, str]]:
    """(time and flux, metadata) of the first binary table with a TIME column, by the public FITS standard."""
    import gzip

    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    at, meta = 0, {}
    sizes = {"L": 1, "B": 1, "I": 2, "J": 4, "K": 8, "E": 4, "D": 8, "A": 1, "X": 1 / 8, "C": 8, "M": 16, "P": 8, "Q": 16}
    kinds = {"I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "B": "u1"}
    while at < len(data):
        cards, at = _fits_header(data, at)
        for key, name in (("OBJECT", "target_id"), ("TELESCOP", "mission")):
            if key in cards:
                meta.setdefault(name, cards[key])
        axes = [int(cards[f"NAXIS{i}"]) for i in range(1, int(cards.get("NAXIS", "0")) + 1)]
        length = abs(int(cards.get("BITPIX", "8"))) // 8 * (int(np.prod(axes)) if axes else 0) + int(cards.get("PCOUNT", "0")) * bool(axes)
        if cards.get("XTENSION", "").strip() == "BINTABLE":
            width, rows = axes
            fields, offset = {}, 0
            for i in range(1, int(cards["TFIELDS"]) + 1):
                form = cards[f"TFORM{i}"].strip()
                count = int("".join(ch for ch in form[: len(form) - len(form.lstrip("0123456789"))]) or 1)
                code = form.lstrip("0123456789")[0]
                scaling = tuple(float(cards[k].replace("D", "E")) if k in cards else None for k in (f"TSCAL{i}", f"TZERO{i}", f"TNULL{i}"))
                fields[cards.get(f"TTYPE{i}", "").strip().upper()] = (code, offset, scaling)
                offset += -(-count // 8) if code == "X" else int(sizes[code] * count)
            if "TIME" in fields:
                name = next((n for n in FITS_FLUX if n in fields), None)
                if name is None:
                    raise ValueError(f"no flux column among {sorted(fields)}")
                table = np.frombuffer(data, np.uint8, width * rows, at).reshape(rows, width)
                out = []
                for n in ("TIME", name):
                    code, o, (scale, zero, null) = fields[n]
                    kind = np.dtype(kinds[code])
                    stored = np.ascontiguousarray(table[:, o : o + kind.itemsize]).view(kind)[:, 0]
                    missing = stored == int(null) if null is not None and kind.kind in "iu" else np.zeros(rows, bool)
                    value = stored.astype(np.float64) * (1.0 if scale is None else scale) + (zero or 0.0)
                    out.append(np.where(missing, np.nan, value))
                return np.stack(out, axis=1), meta | {"flux_column": name}
        at += -(-length // 2880) * 2880
    raise ValueError("no table with a TIME column")


def write_fits(time: np.ndarray, flux: np.ndarray, target_id: str, mission: str, flux_name: str = "PDCSAP_FLUX") -> bytes:
    """A small FITS file with one table, for exchange and tests."""
    card = lambda k, v: f"{k:<8}= {v:>20}".ljust(80)
    text = lambda s: f"'{s:<8}'"

    def header(cards: list[str]) -> bytes:
        block = "".join([*cards, "END".ljust(80)]).encode()
        return block.ljust(-(-len(block) // 2880) * 2880)

    first = header([card("SIMPLE", "T"), card("BITPIX", 8), card("NAXIS", 0), card("OBJECT", text(target_id)), card("TELESCOP", text(mission))])
    rows = b"".join(struct.pack(">dif", t, i, f) for i, (t, f) in enumerate(zip(time, flux, strict=True)))
    second = header([card("XTENSION", text("BINTABLE")), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", 16), card("NAXIS2", len(time)), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", 3), card("TTYPE1", text("TIME")), card("TFORM1", text("D")), card("TTYPE2", text("CADENCENO")), card("TFORM2", text("J")), card("TTYPE3", text(flux_name)), card("TFORM3", text("E"))])
    return first + second + rows.ljust(-(-len(rows) // 2880) * 2880, b"\0")


def _read_binary(spark: SparkSession, path: str, parse, kind: str) -> DataFrame:
    """A file a curve, parsed where it is read."""

    def rows(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                table, meta = parse(bytes(content))
                stem = PurePosixPath(name).name.split(".")[0]
                yield pd.DataFrame({"target_id": meta.get("target_id", stem), "mission": meta.get("mission", "unknown"), "seq": np.arange(len(table)), "time": table[:, 0], "flux": table[:, 1]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(rows, LIGHT_CURVE).withColumns({"time": canonical("time"), "flux": canonical("flux")})


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    return _read_binary(spark, path, lambda c: (parse_npy(c), {}), "npy")


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    return _read_binary(spark, path, parse_fits, "fits")


def _plain(x):
    x = getattr(x, "value", x)
    return np.asarray(getattr(x, "value", x), dtype=np.float64)


def load_input(spark: SparkSession, data, time_col: str | None = None, flux_col: str | None = None, target_id: str | None = None, mission: str | None = None) -> tuple[DataFrame, dict]:
    """(light curves, metadata) of any supported input. target_id and mission given here go before those found in it."""
    kind = detect_input_type(data)
    meta: dict = {"source_type": kind}
    if kind in ("csv", "fits", "npy", "parquet"):
        meta["source_path"] = str(data)
    if kind == "csv":
        lc = read_csv(spark, str(data), time_col, flux_col)
    elif kind == "fits":
        lc = read_fits(spark, str(data))
    elif kind == "npy":
        lc = read_npy(spark, str(data))
    elif kind in ("spark", "parquet", "dataframe"):
        df = data if kind == "spark" else spark.read.parquet(str(data)) if kind == "parquet" else spark.createDataFrame(data.assign(_line=np.arange(len(data))))
        meta["time_column"], meta["flux_column"] = pick_columns([c for c in df.columns if c != "_line"], time_col, flux_col)
        order = next(([c] for c in ("_line", "seq") if c in df.columns), None)
        lc = from_table(df, meta["time_column"], meta["flux_column"], order, "target_id" if "target_id" in df.columns else None, "mission" if "mission" in df.columns else None)
    elif kind == "lightkurve":
        found = getattr(data, "targetid", None)
        meta["target_id"] = str(getattr(data, "label", "unknown") if found is None else found)
        meta["mission"] = str(getattr(data, "mission", "unknown"))
        lc = from_arrays(spark, _plain(data.time), _plain(data.flux), meta["target_id"], meta["mission"])
    elif kind == "array_pair":
        lc = from_arrays(spark, *data)
    else:
        lc = from_arrays(spark, data[:, 0], data[:, 1])
    for name, value in (("target_id", target_id), ("mission", mission)):
        if value is not None:
            meta[name] = value
            lc = lc.withColumn(name, F.lit(value))
    return lc, meta


def curves_from_events(events: DataFrame, dirty: bool = False) -> DataFrame:
    """Light curves of an event table: a user is a target, a timestamp a time in days, a value the flux.

    dirty spoils them by the ids alone: missing and infinite flux, spikes, and repeated times. The one exchange on target_id, which
    all later operators share, gets a task for every ROWS_A_TASK rows where that is more than the cluster's cores.
    """
    d = events.select(F.col("user_id").cast("string").alias("target_id"), F.lit("events").alias("mission"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000.0).alias("time"), F.col("value").alias("flux"))
    by = Window.partitionBy("target_id").orderBy("time", "event_id")
    tasks = -(-events.count() // ROWS_A_TASK)
    if tasks > events.sparkSession.sparkContext.defaultParallelism:
        d = d.repartition(tasks, "target_id")
    d = d.withColumn("seq", (F.row_number().over(by) - 1).cast("bigint"))
    if dirty:
        i = F.col("event_id")
        flux = F.when(i % 11 == 0, F.lit(None).cast("double")).when(i % 97 == 0, F.lit(float("inf"))).when(i % 53 == 0, F.col("flux") * 10).otherwise(F.col("flux"))
        d = d.withColumns({"flux": flux, "time": F.when((i % 29 == 0) & (F.col("seq") > 0), F.lag("time").over(by)).otherwise(F.col("time"))})
    return d.select("target_id", "mission", "seq", "time", "flux")
