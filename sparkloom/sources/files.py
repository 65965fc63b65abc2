"""Single files and folders by path or URI: small ones from the driver, large ones from tasks, and tables in the shared folder."""

from __future__ import annotations

import atexit
import io
import os
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession


def local_path(uri: str) -> str | None:
    scheme = re.match(r"(\w+):", uri)
    return re.sub(r"^file:(//)?", "", uri) if not scheme or scheme[1] == "file" else None


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def opened(uri: str) -> BinaryIO:
    if path := local_path(uri):
        return open(path, "rb")
    store, path = _store(uri)
    return io.BufferedReader(store.open_input_file(path))


@contextmanager
def written(uri: str) -> Iterator[BinaryIO]:
    """A file to write: under another name first, renamed at the end, so that a reader never sees part of it."""
    if path := local_path(uri):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        part = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.{os.getpid()}")
        with open(part, "wb") as f:
            yield f
        os.replace(part, path)
        return
    store, path = _store(uri)
    folder, name = path.rsplit("/", 1)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/.{name}.{os.getpid()}") as f:
        yield f
    store.move(f"{folder}/.{name}.{os.getpid()}", path)


def names(folder: str) -> list[tuple[str, int]]:
    """(name, bytes) of the files of a folder, by name, without a session: for tasks and data sources; none if there is no such folder."""
    if path := local_path(folder):
        return sorted((x.name, x.stat().st_size) for x in os.scandir(path) if x.is_file()) if os.path.isdir(path) else []
    from pyarrow import fs

    store, path = _store(folder)
    return sorted((x.base_name, x.size) for x in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.type == fs.FileType.File)


def moved(source: str, target: str) -> None:
    """Gives a file another name in the same store. Callers see to it that none is there by that name."""
    if path := local_path(source):
        os.rename(path, local_path(target))
    else:
        store, path = _store(source)
        store.move(path, _store(target)[1])


def dropped(folder: str) -> None:
    """Deletes a folder without a session; one that is not there is no error."""
    if path := local_path(folder):
        shutil.rmtree(path, ignore_errors=True)
    else:
        store, path = _store(folder)
        if any(True for _ in names(folder)):
            store.delete_dir(path)


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> list[tuple[str, int]]:
    """(name, bytes) of the files of a folder that match, by name, through Spark's file systems; none if there is no such folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(place, pattern)) if store.exists(place) else None
    return sorted((f.getPath().getName(), f.getLen()) for f in found or [] if f.isFile())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; with a local master a temporary folder may take its place."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "sparkloom-shared")
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _note(path)
    return path


def stored(df: DataFrame, name: str, few: bool | int = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: the lineage ends here, a lost executor
    costs only the tasks that ran on it. `few`: rows are narrow or few; what would be many small files is written as four for
    each core, or one for eight shuffle partitions, if that is more, or as the number given. Local file systems start a process for each file."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    if few:
        df = df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8) if few is True else few)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's file systems; one that is not there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Open Scratches, by thread: streams and callers of several threads each have their own.
_threads = threading.local()
#: Folders outside any Scratch: results may still read them; removed when the driver ends, or by clean().
_left: list[str] = []


def _open() -> list[Scratch]:
    return _threads.__dict__.setdefault("open", [])


def _note(path: str) -> None:
    (_open()[-1].folders if _open() else _left).append(path)


class Scratch:
    """While it is open in a thread, stored() and new_folder() note their folders here; at its end all are removed but those of frames that were
    kept, which go to the surrounding Scratch, if any, or stay until the driver ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folders, self.kept = spark, [], set()

    def __enter__(self) -> Scratch:
        _open().append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df._folder)
        return df

    def drop(self, *frames: DataFrame) -> None:
        """Removes the folders of frames that nothing reads any more."""
        for df in frames:
            self.folders.remove(df._folder)
            remove(self.spark, df._folder)

    def __exit__(self, *error) -> None:
        _open().remove(self)
        for path in self.folders:
            if path in self.kept and not error[0]:
                _note(path)
            else:
                remove(self.spark, path)


def clean(spark: SparkSession) -> None:
    """Removes all folders that results of earlier calls still read; they can't be read again."""
    while _left:
        remove(spark, _left.pop())


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if _left and spark is not None:
        try:
            clean(spark)
        except Exception:  # noqa: BLE001  the JVM may be gone; the shared folder's owner clears the rest
            _left.clear()


atexit.register(_at_exit)
