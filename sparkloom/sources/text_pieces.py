"""Corpora as plain text, of any length, as the data source `text_pieces`: a document that is larger than a task or a row is read in pieces.

A file is dealt to tasks by ranges of bytes. A range, and a piece within it, ends only where no pre-token, special string or separator can cross:
before white space, or before a mark that follows a letter or a digit. Such a place is found from the bytes around it, so neighbouring tasks agree
on it without a look at the rest of the file, and the ids of pieces one after another are the ids of the whole text. Texts without such a place
stay in one piece."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkloom.functions.patterns import SPECIALS, WS
from sparkloom.operators import bpe, ordered

from .corpus_text import MARKER
from .files import names, opened, stored

SCHEMA = "path string, start long, begins boolean, text string"
#: Bytes of a task and of a piece, unless options say otherwise, and bytes that are looked through at a time for a place to cut.
TASK_BYTES, PIECE_BYTES, LOOK = 64 << 20, 1 << 20, 1 << 14
#: White space and the stand-ins of broken bytes; letters and digits that all versions of Unicode have; marks after them.
_SPACE = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", WS)
_LETTER = r"0-9A-Za-z\u00c0-\u00d6\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_MARK = r"!-/:-@\[-^`{-~\u3001\u3002\uff0c\uff01\uff1f"
_PLACE = re.compile(rf"(?<=[^{_SPACE}\udc80-\udcff])(?=[{_SPACE}])|(?<=[{_LETTER}])(?=[{_MARK}])")


class Cuts:
    """Places of a file where a text can be cut. `apart`: the separator; `whole`: strings that must stay whole."""

    def __init__(self, f: BinaryIO, size: int, apart: bytes, whole: tuple[bytes, ...]) -> None:
        self.f, self.size, self.apart, self.whole = f, size, apart, whole
        self.around = max(4, *map(len, (apart, *whole)))

    def read(self, low: int, high: int) -> bytes:
        self.f.seek(low)
        return self.f.read(high - low)

    def _crossed(self, data: bytes, at: int) -> bool:
        """A separator has its end or inside at this byte, or another string its inside: whichever of overlapping separators count."""
        n = len(self.apart)
        return data.find(self.apart, max(0, at - n), at - 1 + n) >= 0 or any(data.find(w, max(0, at - len(w) + 1), at - 1 + len(w)) >= 0 for w in self.whole)

    def after(self, low: int) -> int:
        """The first place at or after this byte; else the file's end."""
        if low <= 0:
            return 0
        while low < self.size:
            begin, upto = max(0, low - self.around), min(self.size, low + LOOK)
            data = self.read(begin, min(self.size, upto + self.around))
            text, seen, at = data.decode(errors="surrogateescape"), 0, 0
            for m in _PLACE.finditer(text):
                at += len(text[seen : m.start()].encode(errors="surrogateescape"))
                seen = m.start()
                if low <= begin + at < upto and not self._crossed(data, at):
                    return begin + at
            low = upto
        return self.size


@dataclass
class Bytes(InputPartition):
    path: str
    size: int
    low: int
    high: int


class PieceReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.apart = options["path"].rstrip("/"), options.get("separator", f"\n{MARKER}\n").encode()
        self.whole = tuple(w.encode() for w in options.get("whole", "\n".join(SPECIALS)).split("\n") if w)
        self.task, self.piece = int(options.get("task_bytes", TASK_BYTES)), int(options.get("piece_bytes", PIECE_BYTES))
        if not self.apart or self.task < 1 or self.piece < 1:
            raise ValueError("separator, task_bytes and piece_bytes must not be empty or zero")

    def partitions(self) -> list[Bytes]:
        files = [(f"{self.path}/{name}", size) for name, size in names(self.path) if name[0] not in "._"]
        if not files and not names(self.path):
            with opened(self.path) as f:
                files = [(self.path, f.seek(0, 2))]
        return [Bytes(path, size, low, min(size, low + self.task)) for path, size in files for low in range(0, size, self.task)]

    def read(self, partition: Bytes) -> Iterator[pa.RecordBatch]:
        with opened(partition.path) as f:
            cuts = Cuts(f, partition.size, self.apart, self.whole)
            at, end = cuts.after(partition.low), cuts.after(partition.high)
            while at < end:
                upto = min(end, cuts.after(at + self.piece))
                rows, start = [], at
                for i, part in enumerate(cuts.read(at, upto).split(self.apart)):
                    begins = i > 0 or at == 0
                    if part or begins and start < partition.size:
                        rows.append((partition.path, start, begins, part.decode()))
                    start += len(part) + len(self.apart)
                at = upto
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.bool_(), pa.string()), strict=True)], ["path", "start", "begins", "text"])


class TextPieces(DataSource):
    """Options: path (a file, or a folder whose files are read), separator, whole (strings that must not be cut, one a line), task_bytes, piece_bytes."""

    @classmethod
    def name(cls) -> str:
        return "text_pieces"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PieceReader:
        return PieceReader(dict(self.options))


def read_pieces(spark: SparkSession, path: str, separator: str = f"\n{MARKER}\n", **options) -> DataFrame:
    """(path, start, begins, text): the documents of plain-text files in pieces. start is a piece's first byte, begins says that a document
    starts with it. Pieces by path and start, put together from one that begins to the next, are the rows of corpus_text.read_delimited().
    Null texts do not occur; empty documents are one empty piece, an empty file has none. Bytes that are no UTF-8 are an error."""
    spark.dataSource.register(TextPieces)
    return spark.read.format("text_pieces").options(path=path, separator=separator, **options).load()


def encode_pieces(pieces: DataFrame, merges: list[tuple[int, int]], add_eot: bool = True) -> DataFrame:
    """(doc_id, ids) of pieces, as bpe.encode_documents() has them of whole documents: doc_id is the struct of path, start and begins, whose order is
    the stream's, so shards.pieces() lays the rows out as it does documents. With add_eot the id stands where a document begins."""
    rows = bpe.encode_documents(pieces.select(F.struct("path", "start", "begins").alias("doc_id"), "text"), merges, add_eot=False)
    front = F.array(F.lit(SPECIALS[MARKER]))
    return rows.withColumn("ids", F.when(F.col("doc_id.begins"), F.concat(front, "ids")).otherwise(F.col("ids"))) if add_eot else rows


def document_sums(encoded: DataFrame) -> DataFrame:
    """(path, document, tokens, checksum) from encoded pieces: documents are numbered from 0 over all files, and the checksum is the sum of
    each token's id times its place in the document, from 1. No document is put together: a piece sends two sums and its length."""
    total = lambda weight: F.aggregate(F.transform("ids", weight), F.lit(0).cast("long"), lambda a, x: a + x)
    narrow = encoded.select("doc_id", F.size("ids").cast("long").alias("n"), total(lambda x: x.cast("long")).alias("ids_sum"), total(lambda x, i: x.cast("long") * (i + 1)).alias("placed_sum"))
    numbered = ordered.running_before(narrow, F.col("doc_id.begins").cast("long"), "before")
    placed = stored(ordered.running_before(numbered, F.col("n"), "first"), "placed")
    document = (F.col("before") + F.col("doc_id.begins").cast("long") - 1).alias("document")
    # a piece's places count from the stream's start here; the document's own start is taken off at the end
    sums = placed.groupBy(F.col("doc_id.path").alias("path"), document).agg(
        F.sum("n").alias("tokens"), F.min("first").alias("low"), F.sum("ids_sum").alias("s"), F.sum(F.col("placed_sum").cast("decimal(38,0)") + F.col("first").cast("decimal(19,0)") * F.col("ids_sum")).alias("w")
    )
    return sums.select("path", "document", "tokens", (F.col("w") - F.col("low").cast("decimal(19,0)") * F.col("s")).cast("long").alias("checksum"))
