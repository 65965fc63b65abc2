"""Token shards as Spark data sources: `token_shards` reads and writes pieces of shards, `token_windows` reads training windows.

A task reads a range of tokens, or of windows, of the files, by position. Filters on shard_index reach the list of files, so others are not opened.
Written shards lie in a folder of their own until all tasks are done: the commit gives them their names and writes the manifest, an abort
removes the folder, so a failed write leaves neither shards nor a manifest, and a shard that is there is never replaced."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from sparkloom.functions.permutation import permuted

from .files import dropped, moved, names, opened, written

PIECES = "shard_index long, low long, piece array<int>"
WINDOWS = "step long, epoch int, shard_index long, win_index long, input array<int>, target array<int>"
#: Tokens that a task reads at a time, and of a task in all.
READ_TOKENS, TASK_TOKENS = 1 << 20, 1 << 26


def file_name(index: int) -> str:
    return f"shard_{index:05d}.npy"


def index_of(path: str) -> int:
    return int(path.rsplit("_", 1)[1].split(".")[0])


def header(f) -> tuple[int, np.dtype]:
    """Length and type of a flat .npy file, from its header alone; f stands at the data then."""
    version = np.lib.format.read_magic(f)
    shape, _, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
    return int(shape[0]), kind


def _shards(options: dict) -> list[tuple[int, int]]:
    """(index, tokens) of the shards of the folder, by index: as the manifest has them."""
    with opened(f"{options['path']}/metadata.json") as f:
        return sorted((s["index"], s["tokens"]) for s in json.load(f)["shards"])


def _tokens(folder: str, index: int, low: int, n: int) -> np.ndarray:
    with opened(f"{folder}/{file_name(index)}") as f:
        _, kind = header(f)
        f.seek(low * kind.itemsize, 1)
        return np.frombuffer(f.read(n * kind.itemsize), kind).astype(np.int32)


def _list(values: np.ndarray, ends: list[int] | np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


@dataclass
class Ranges(InputPartition):
    """(shard, low, high) in tokens, in order."""

    parts: list[tuple[int, int, int]]


def packed(counts: list[tuple[int, int]], tasks: int, most: int = TASK_TOKENS) -> list[Ranges]:
    """Shards' tokens dealt to about `tasks` partitions of `most` tokens at most, in order; long shards are cut."""
    total = sum(n for _, n in counts)
    room = max(1, min(most, -(-total // max(1, tasks))))
    out, held = [], 0
    for index, n in counts:
        for low in range(0, n, room):
            part = (index, low, min(n, low + room))
            if not out or held + part[2] - part[1] > room:
                out.append(Ranges([]))
                held = 0
            out[-1].parts.append(part)
            held += part[2] - part[1]
    return out


class PieceReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.tasks, self.at_once = options["path"], int(options.get("tasks", 8)), int(options.get("read_tokens", READ_TOKENS))
        self.shards = _shards(options)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes what compares shard_index with constants; the rest stays with Spark."""
        tests = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
        for f in filters:
            if type(f) in tests and f.attribute == ("shard_index",) and f.value is not None:
                self.shards = [s for s in self.shards if tests[type(f)](s[0], f.value)]
            else:
                yield f

    def partitions(self) -> list[Ranges]:
        return packed(self.shards, self.tasks)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for index, first, last in partition.parts:
            for low in range(first, last, self.at_once):
                tokens = _tokens(self.folder, index, low, min(self.at_once, last - low))
                yield pa.RecordBatch.from_arrays([pa.array([index], pa.int64()), pa.array([low], pa.int64()), _list(tokens, [0, len(tokens)])], ["shard_index", "low", "piece"])


@dataclass
class Written(WriterCommitMessage):
    """(index, tokens, bytes, name) of each file."""

    files: list[tuple[int, int, int, str]]


class PieceWriter(DataSourceArrowWriter):
    """Rows must come sorted by shard_index and low, each shard's in one task (see npy_shards.write_pieces)."""

    def __init__(self, options: dict) -> None:
        self.folder, self.vocab, self.size, self.version = options["path"], int(options["vocab_size"]), int(options["shard_size"]), options["version"]
        self.own = f"{self.folder}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, f, done, at, n, name = [], None, None, -1, 0, ""

        def closed() -> None:
            if f is not None:
                # numpy leaves room for the count to grow, so it can be set at the end
                f.seek(0)
                np.lib.format.write_array_header_1_0(f, {"descr": "<u2", "fortran_order": False, "shape": (n,)})
                size = f.seek(0, 2)
                done.__exit__(None, None, None)
                files.append((at, n, size, name))

        for batch in iterator:
            for index, piece in zip(batch.column("shard_index").to_pylist(), batch.column("piece"), strict=True):
                tokens = piece.values.to_numpy(zero_copy_only=False)
                if len(tokens) and (tokens.min() < 0 or tokens.max() >= self.vocab):
                    bad = tokens[(tokens < 0) | (tokens >= self.vocab)]
                    raise ValueError(f"ids out of range: {tokens.min()} to {tokens.max()}, first {bad[:5].tolist()}")
                if index != at:
                    closed()
                    name = f"{uuid.uuid4().hex}.npy"
                    done, at, n = written(f"{self.own}/{name}"), index, 0
                    f = done.__enter__()
                    np.lib.format.write_array_header_1_0(f, {"descr": "<u2", "fortran_order": False, "shape": (0,)})
                f.write(tokens.astype("<u2").tobytes())
                n += len(tokens)
        closed()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """The manifest, with what it listed before, is written when all shards have their names: one record a shard."""
        records, there = {}, {name for name, _ in names(self.folder)}
        if "metadata.json" in there:
            with opened(f"{self.folder}/metadata.json") as f:
                records = {r["index"]: r for r in json.load(f)["shards"]}
        try:
            new = sorted(x for m in messages if m for x in m.files)
            if replaced := [file_name(x[0]) for x in new if file_name(x[0]) in there]:
                raise FileExistsError(f"{self.folder} has {replaced[0]}; shards are never overwritten")
            for index, n, size, name in new:
                moved(f"{self.own}/{name}", f"{self.folder}/{file_name(index)}")
                records[index] = {"index": index, "filename": file_name(index), "tokens": n, "size_mb": round(size / 1e6, 2)}
        finally:
            dropped(self.own)
        if records:
            write_manifest(self.folder, [records[i] for i in sorted(records)], self.size, self.version, self.vocab)

    def abort(self, messages: list[Written | None]) -> None:
        dropped(self.own)


def write_manifest(folder: str, records: list[dict], shard_size: int, version: str, vocab_size: int) -> dict:
    manifest = {"dataset_version": version, "vocab_size": vocab_size, "total_tokens": sum(r["tokens"] for r in records), "total_shards": len(records), "shard_size": shard_size, "created_at": datetime.now(UTC).isoformat(), "shards": records}
    with written(f"{folder}/metadata.json") as f:
        f.write(json.dumps(manifest, indent=2).encode())
    return manifest


class TokenShards(DataSource):
    """Options: path, and to write vocab_size, shard_size and version; to read `tasks` (about so many partitions) and `read_tokens` (tokens of a row)."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return PIECES

    def reader(self, schema) -> PieceReader:
        return PieceReader(self.options)

    def writer(self, schema, overwrite: bool) -> PieceWriter:
        if overwrite:
            raise ValueError("shards are never overwritten")
        return PieceWriter(self.options)


# ---- windows by step


@dataclass
class Steps(InputPartition):
    low: int
    high: int


class Windows:
    """Windows of a folder's shards by step: step s is place s % k of epoch s div k, where k is the number of windows. Without a seed a place is the
    window's number, with one each epoch has an order of its own."""

    def __init__(self, options: dict) -> None:
        self.folder, self.length = options["path"], int(options["length"])
        self.stride, self.tasks = int(options.get("stride", self.length)), int(options.get("tasks", 8))
        self.seed = int(options["seed"]) if "seed" in options else None
        val = int(options["val_shard"]) if "val_shard" in options else None
        part = options.get("part", "all")
        shards = _shards(options)
        if part != "all" and val not in [i for i, _ in shards]:
            raise ValueError(f"no shard {val}")
        shards = [s for s in shards if part == "all" or (s[0] == val) == (part == "val")]
        self.shards = [(i, (n - self.length - 1) // self.stride + 1) for i, n in shards if n > self.length]
        self.ends = np.cumsum([n for _, n in self.shards], dtype=np.int64)
        self.total = int(self.ends[-1]) if self.shards else 0

    def ranges(self, low: int, high: int) -> list[Steps]:
        if not self.total or high <= low:
            return [Steps(0, 0)]
        room = max(1, min(TASK_TOKENS // self.length, -(-(high - low) // max(1, self.tasks))))
        return [Steps(x, min(high, x + room)) for x in range(low, high, room)]

    def rows(self, steps: Steps) -> Iterator[pa.RecordBatch]:
        block = max(1, READ_TOKENS // (self.length + 1))
        for low in range(steps.low, steps.high, block):
            step = np.arange(low, min(steps.high, low + block), dtype=np.int64)
            epoch, number = step // self.total, step % self.total
            if self.seed is not None:
                for e in np.unique(epoch):
                    number[epoch == e] = permuted(number[epoch == e], self.total, self.seed, int(e))
            shard = np.searchsorted(self.ends, number, side="right")
            win = number - np.concatenate([[0], self.ends])[shard]
            tokens = np.empty((len(step), self.length + 1), np.int32)
            for s in np.unique(shard):  # each file once, its windows in order
                with opened(f"{self.folder}/{file_name(self.shards[s][0])}") as f:
                    _, kind = header(f)
                    data = f.tell()
                    for i in sorted(np.flatnonzero(shard == s), key=lambda i: win[i]):
                        f.seek(data + int(win[i]) * self.stride * kind.itemsize)
                        tokens[i] = np.frombuffer(f.read((self.length + 1) * kind.itemsize), kind)
            ends = np.arange(len(step) + 1) * self.length
            index = np.array([i for i, _ in self.shards], np.int64)[shard]
            yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(epoch, pa.int32()), pa.array(index), pa.array(win), _list(tokens[:, :-1].ravel(), ends), _list(tokens[:, 1:].ravel(), ends)], ["step", "epoch", "shard_index", "win_index", "input", "target"])


class WindowReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.windows = Windows(options)
        self.low = int(options.get("skip", 0))
        self.high = self.low + int(options["steps"]) if "steps" in options else max(self.low, self.windows.total)

    def partitions(self) -> list[Steps]:
        return self.windows.ranges(self.low, self.high)

    def read(self, partition: Steps) -> Iterator[pa.RecordBatch]:
        return self.windows.rows(partition)


class WindowStream(DataSourceStreamReader):
    """The endless stream of steps, as far as `upto`. An offset is an epoch and a place in it, and a step's window follows from them alone, so a restart goes on exactly
    where its checkpoint stands."""

    def __init__(self, options: dict) -> None:
        self.windows, self.low, self.upto = Windows(options), int(options.get("skip", 0)), int(options["upto"])
        if not self.windows.total:
            raise ValueError("there are no windows")

    def _offset(self, step: int) -> dict:
        return {"epoch": step // self.windows.total, "place": step % self.windows.total}

    def _step(self, offset: dict) -> int:
        return offset["epoch"] * self.windows.total + offset["place"]

    def initialOffset(self) -> dict:  # noqa: N802
        return self._offset(self.low)

    def latestOffset(self) -> dict:  # noqa: N802
        return self._offset(max(self.low, self.upto))

    def partitions(self, start: dict, end: dict) -> list[Steps]:
        return self.windows.ranges(self._step(start), self._step(end))

    def read(self, partition: Steps) -> Iterator[pa.RecordBatch]:
        return self.windows.rows(partition)


class TokenWindows(DataSource):
    """Options: path, length, stride, part (train, val or all) with val_shard, seed, skip (steps), steps (a batch) or upto (a stream), tasks."""

    @classmethod
    def name(cls) -> str:
        return "token_windows"

    def schema(self) -> str:
        return WINDOWS

    def reader(self, schema) -> WindowReader:
        return WindowReader(self.options)

    def streamReader(self, schema) -> WindowStream:  # noqa: N802
        return WindowStream(self.options)


def register(spark) -> None:
    """Makes the sources known to the session and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TokenShards, TokenWindows):
        spark.dataSource.register(source)
