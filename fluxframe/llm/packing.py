"""Packing of tokenized documents into windows, best fit decreasing.

Documents are tokenized in batches; a piece that the tokenizer would look at alone is encoded once and kept in a bounded
cache, since the tokenizer never joins over the ends of pieces. An overlong document is cut into full windows and a rest. The rests are packed
longest first: a segment tree over remaining capacities finds the tightest open window in a logarithm of its size.

Packing runs in shards of a bounded number of pieces, dealt out evenly, so the windows of one shard never need another.
Text never leaves the task that tokenizes it; what is shuffled are the pieces' columns.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Pieces of a shard: some ten MB in a task.
SHARD = 50_000
#: Pieces that a worker's cache holds before it is emptied: some 20 MB.
CACHE = 100_000
_UNITS = re.compile(r"[^ \t-\r]+")
_LATIN = [chr(c) for c in range(0x250)]
_L = "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == "L")
_N = "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == "N")
#: The vocabulary's own split of normalized text.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
#: White space, printable ASCII and Latin letters whose small form is one of these characters again: some capitals of
#: African and Turkic languages have theirs farther on, and one has two characters.
_PLAIN = [c for c in _LATIN if (c in "\t\n\v\f\r" or c >= " ") and not "\x7f" <= c < "\xa0" and len(c.lower()) == 1 and c.lower() in _LATIN]
#: Texts with other characters, or special tokens.
_ODD = re.compile(f"[^{''.join(map(re.escape, _PLAIN))}]|<\\|")
#: What a tokenizer file must say for its texts to be split here, as fixed values: its normalizer, and its split before the model.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
PIECES = "doc bigint, start bigint, length bigint, ids binary, doc_tokens bigint"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit numbers, equal to the tokenizer's own for whole texts.

    Texts of Latin letters are split here into the pieces that the tokenizer would split them into, and each new piece goes
    to its model alone; other texts are split at white space and each new unit goes through the whole tokenizer. Both hold
    only for a file that normalizes and splits as _NORMALIZER and _SPLIT say; any other gets whole texts, some at a time.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.splits = told["normalizer"] == _NORMALIZER and told["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
        self.limit = cache
        self.pieces: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def _piece(self, piece: str) -> bytes:
        if len(self.pieces) >= self.limit:
            self.pieces.clear()
        word = "".join([self.letters[b] for b in piece.encode()])
        found = self.pieces[piece] = np.array([t.id for t in self.tokenizer.model.tokenize(word)], "<u4").tobytes()
        return found

    def _plain(self, text: str) -> bytes:
        known, out = self.pieces.get, []
        for piece in _PIECES.findall(text.lower()):
            out.append(known(piece) or self._piece(piece))
        return b"".join(out)

    def _other(self, text: str) -> bytes:
        units = _UNITS.findall(text)
        new = list({u for u in units if u not in self.units})
        if len(self.units) + len(new) > self.limit // 4:
            self.units.clear()
            new = list(set(units))
        for at in range(0, len(new), 2_000):
            part = new[at : at + 2_000]
            for unit, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                self.units[unit] = np.array(e.ids, "<u4").tobytes()
        return b"".join(map(self.units.__getitem__, units))

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Texts through the tokenizer as they are, in batches of a million characters or one text."""
        out, part, size = [], [], 0
        for i, t in enumerate(texts):
            part.append(t)
            size += len(t)
            if size >= 1_000_000 or i + 1 == len(texts):
                out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(part, add_special_tokens=False)]
                part, size = [], 0
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.splits:
            return self._whole(texts)
        return [self._other(t) if _ODD.search(t) else self._plain(t) for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _tokenize(path: str, window: int, end_id: int) -> Callable:
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows: list[tuple] = []
                for doc, ids in zip(batch.column(0).to_pylist(), own.ids([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    ids += end
                    total = len(ids) // 4
                    rows += [(doc, s, min(window, total - s), ids[4 * s : 4 * (s + window)], total) for s in range(0, total, window)]
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc", "start", "length", "ids", "doc_tokens"])

    return run


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces(doc, start, length, ids, doc_tokens): every document's ids and end_id, cut into full windows and a rest.

    A null text is empty and has end_id alone. ids holds little-endian unsigned 32-bit ids.
    """
    rows = in_small_batches(docs).select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_tokenize(path or tokenizer_path(), window, end_id), PIECES)


class Capacities:
    """Open windows by remaining capacity; a segment tree finds the smallest capacity that is enough."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.held: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, name: int) -> None:
        self.held[capacity].append(name)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest window that has room for need, as (capacity, name), taken out; None if there is none."""
        i, count = need + self.size, self.count
        if not count[i]:  # climb until a right-hand neighbour has windows, then go down to its smallest
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.held[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of every piece; pieces are placed longest first, equal ones in the order given."""
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened = Capacities(window)
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = opened.take(n) if n < window else None
        if found is None:
            found = window, made
            made += 1
        capacity, name = found
        where[i], offset[i] = name, window - capacity
        if capacity > n:
            opened.add(capacity - n, name)
    return where, offset


def _pack(window: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc", "start", "ids_crc32"], kind="stable")  # the same sequences whatever order the rows came in
        where, offset = best_fit_decreasing(pdf["length"].to_numpy(), window)
        shard = pdf.pop("_shard").to_numpy()
        return pdf.assign(sequence_id=shard * (1 << 32) + where, offset=offset)

    return run


def pack(pieces: DataFrame, shards: int, window: int = WINDOW) -> DataFrame:
    """pieces(doc, start, length, ids_crc32, ...) with sequence_id and offset. Ids are unique over shards; offsets in a sequence are gapless from 0."""
    dealt = pieces.withColumn("_shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return dealt.groupBy("_shard").applyInPandas(_pack(window), f"{fields}, sequence_id bigint, offset bigint")


def shards_for(docs: DataFrame, text_col: str = "text", window: int = WINDOW, shard: int = SHARD) -> int:
    """So many that a shard gets about shard pieces at most: a document has one rest, and a full window takes window bytes at least."""
    n = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b")).first()
    return int((n["n"] + n["b"] // window) // shard) + 1


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """(id_col, start, length, [ids,] ids_crc32, doc_tokens, sequence_id, offset) of every piece of every row.

    Null and empty texts are one id. A very long text is encoded whole and cut into full windows. Repeated rows are packed
    each; pieces of one length are placed by id and start. An empty table gives an empty result. Ids that docs share, or
    nulls, do no harm: pieces are dealt out by their place, not by key. Other columns are not looked at, whatever their names.
    """
    pieces = tokenize(docs, id_col, text_col, path, window).withColumn("ids_crc32", F.crc32("ids"))
    if not with_ids:
        pieces = pieces.drop("ids")
    packed = pack(pieces, shards_for(docs, text_col, window), window)
    return packed.withColumnRenamed("doc", id_col)


def sequences(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(sequence_id, n_tokens, padded, ids): whole sequences of packed pieces with their ids; at most window ids each.

    padded is the length after padding: window, or n_tokens where that is a power of two.
    """
    put = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), put.alias("p"))
    ids = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    power = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    return whole.select("sequence_id", "n_tokens", F.when(power, F.col("n_tokens")).otherwise(F.lit(window)).cast("bigint").alias("padded"), ids.alias("ids"))


def packing_query(spark, sf_dir: str) -> DataFrame:
    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
