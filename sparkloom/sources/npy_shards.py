"""Token shards as .npy files (flat uint16) with a metadata.json, in a folder that driver and executors share (a path or URI).

Shards are written from pieces (see operators.shards.pieces): a task streams a shard's pieces, in order, into its file, so it never
holds a shard. All files of a write get their names together, when every task is done, with the manifest (see shard_source). A folder that
has shards is only added to with `resume`, which demands a manifest that fits the files; shards are never overwritten."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import shards as S

from .files import listed, opened, stored
from .shard_source import header, index_of, register, write_manifest

SCHEMA = "shard_index long, tokens array<int>"
RECORD = "index long, filename string, tokens long, size_mb double"
MANIFEST = f"dataset_version string, vocab_size int, total_tokens long, total_shards int, shard_size long, created_at string, shards array<struct<index: bigint, filename: string, tokens: bigint, size_mb: double>>"
VERSION, VOCAB, PATTERN = "v1", 32768, "shard_*.npy"


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", PATTERN).load(folder).select("path", "length")


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """RECORD rows of the shards on disk: their token counts come from the files' headers, no data is read."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for path, size in zip(part.column("path").to_pylist(), part.column("length").to_pylist(), strict=True):
                with opened(path) as f:
                    rows.append((index_of(path), path.rsplit("/", 1)[-1], header(f)[0], round(size / 1e6, 2)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.float64()))], ["index", "filename", "tokens", "size_mb"])

    return _paths(spark, folder).mapInArrow(run, RECORD)


def existing(spark: SparkSession, folder: str) -> tuple[int, int]:
    """(shards, tokens) on disk: a row a shard is summed up on the executors."""
    if not listed(spark, folder, PATTERN):
        return 0, 0
    row = counts(spark, folder).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).first()
    return row["n"], row["t"]


def write_pieces(pieces: DataFrame, folder: str, shard_size: int, version: str = VERSION, vocab_size: int = VOCAB, resume: bool = False) -> dict:
    """Writes pieces (shard_index, low, piece) as one file a shard and returns the manifest, which is written last and lists all shards of
    the folder. `resume`: shards may be there; pieces must start after them (see write_documents)."""
    spark = pieces.sparkSession
    there = listed(spark, folder, PATTERN)
    if there and not resume:
        raise FileExistsError(f"{folder} has shards, the first is {there[0][0]}; shards are never overwritten")
    register(spark)
    # each shard's pieces in one task, in order; a task holds one batch of them
    ordered = pieces.select(F.col("shard_index").cast("long").alias("shard_index"), F.col("low").cast("long").alias("low"), "piece").repartition("shard_index").sortWithinPartitions("shard_index", "low")
    ordered.write.format("token_shards").mode("append").option("vocab_size", vocab_size).option("shard_size", shard_size).option("version", version).save(folder)
    if not listed(spark, folder, PATTERN):
        raise ValueError("there are no tokens to write")
    return read_manifest(spark, folder)


def write(shards: DataFrame, folder: str, shard_size: int, version: str = VERSION, vocab_size: int = VOCAB, resume: bool = False) -> dict:
    """write_pieces() for whole shards (shard_index, tokens)."""
    pieces = shards.select("shard_index", (F.col("shard_index") * 0).alias("low"), F.col("tokens").alias("piece")).filter("size(piece) > 0")
    return write_pieces(pieces, folder, shard_size, version, vocab_size, resume)


def _standing(spark: SparkSession, folder: str) -> tuple[list[dict], list[dict]]:
    """(the manifest's records, those whose files are missing). Shards without a manifest, files that it doesn't list or that have another number of
    tokens, and a gap in the numbers are errors: where the stream stands would be a guess."""
    if not listed(spark, folder, "metadata.json"):
        if listed(spark, folder, PATTERN):
            raise ValueError(f"{folder} has shards but no manifest; rebuild it if none is missing")
        return [], []
    with opened(f"{folder}/metadata.json") as f:
        records = sorted(json.load(f)["shards"], key=lambda r: r["index"])
    found = {r["index"]: r["tokens"] for r in counts(spark, folder).collect()} if listed(spark, folder, PATTERN) else {}  # a row a shard
    if [r["index"] for r in records] != list(range(len(records))):
        raise ValueError("the manifest's shards have gaps")
    if other := sorted(found.keys() - {r["index"] for r in records}):
        raise ValueError(f"the manifest does not list the shards {other}")
    if other := [r["index"] for r in records if found.get(r["index"], r["tokens"]) != r["tokens"]]:
        raise ValueError(f"the shards {other} have other numbers of tokens than the manifest says")
    return records, [r for r in records if r["index"] not in found]


def write_documents(encoded: DataFrame, folder: str, shard_size: int, version: str = VERSION, vocab_size: int = VOCAB, token_budget: int | None = None, resume: bool = False) -> dict:
    """Shards of encoded documents (doc_id, ids): the first `token_budget` tokens of the stream, if given. `resume` goes on where the shards
    of the manifest end: their tokens are skipped in the stream, and numbering goes on after them, so nothing is written twice. A last shard that is
    not full stays so; numbering by position goes on with the next one. Shards that the manifest lists and the folder lacks are written again, from their places
    in the stream."""
    spark = encoded.sparkSession
    if not resume and (there := listed(spark, folder, PATTERN)):
        raise FileExistsError(f"{folder} has {len(there)} shards; shards are never overwritten")
    records, missing = _standing(spark, folder) if resume else ([], [])
    tokens_there = sum(r["tokens"] for r in records)
    if missing:
        encoded = stored(encoded.select("doc_id", "ids"), "encoded")
    cut = S.pieces(encoded, shard_size, skip=tokens_there, budget=token_budget).withColumn("shard_index", F.col("shard_index") + len(records))
    for r in missing:
        low = sum(x["tokens"] for x in records[: r["index"]])
        again = S.pieces(encoded, r["tokens"], skip=low, budget=low + r["tokens"]).withColumn("shard_index", F.lit(r["index"]).cast("long"))
        cut = cut.unionByName(again)
    manifest = write_pieces(cut, folder, shard_size, version, vocab_size, resume)
    if other := [r["index"] for r in records if manifest["shards"][r["index"]]["tokens"] != r["tokens"]]:
        raise ValueError(f"the stream ends within the shards {other}, which were written again")
    return manifest


def rebuild_manifest(spark: SparkSession, folder: str, shard_size: int, version: str = VERSION, vocab_size: int = VOCAB) -> dict:
    """Writes metadata.json anew from the shards on disk. The manifest is one document with a record a shard, so it goes through the driver."""
    records = [r.asDict() for r in counts(spark, folder).orderBy("index").collect()] if listed(spark, folder, PATTERN) else []
    if not sum(r["tokens"] for r in records):
        raise ValueError("there are no tokens to write")
    return write_manifest(folder, records, shard_size, version, vocab_size)


def read_manifest(spark: SparkSession, folder: str) -> dict:
    """The manifest, checked against the files: another number of shards is an error."""
    if not listed(spark, folder, "metadata.json"):
        raise FileNotFoundError(f"{folder}/metadata.json")
    with opened(f"{folder}/metadata.json") as f:
        manifest = json.load(f)
    found = len(listed(spark, folder, PATTERN))
    if not found:
        raise FileNotFoundError(f"{folder} has no shards")
    if found != manifest["total_shards"]:
        raise ValueError(f"the manifest lists {manifest['total_shards']} shards, {found} are there")
    return manifest


def manifest_table(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest as one row, by Spark's JSON reader."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(f"{folder}/metadata.json")


def reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """Per shard that the manifest lists or the folder has: shard_index, listed and found tokens (null where missing), agrees."""
    said = manifest_table(spark, folder).select(F.explode("shards").alias("s")).select(F.col("s.index").alias("shard_index"), F.col("s.tokens").alias("listed"))
    here = counts(spark, folder).select(F.col("index").alias("shard_index"), F.col("tokens").alias("found"))
    return said.join(here, "shard_index", "full_outer").withColumn("agrees", F.coalesce(F.col("listed") == F.col("found"), F.lit(False)))


def read_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """(shard_index, low, piece): shards' tokens in rows of some million at most; a task reads a range of them and holds one row at a time. Filters on
    shard_index leave other files unopened."""
    read_manifest(spark, folder)
    register(spark)
    return spark.read.format("token_shards").option("tasks", spark.sparkContext.defaultParallelism).load(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(shard_index, tokens): whole shards, one row each, for shards that fit into a row; read_pieces() is for any."""
    return S.assembled(read_pieces(spark, folder))


def synthetic(spark: SparkSession, n_shards: int = 4, shard_size: int = 10_000, vocab_size: int = VOCAB, seed: int = 42) -> DataFrame:
    """(shard_index, low, piece): even tokens from md5 of seed and position, a row for every 1000."""
    at = spark.range(n_shards * shard_size)
    token = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long") % vocab_size
    rows = at.select(F.expr(f"id div {shard_size}").alias("shard_index"), F.expr(f"id % {shard_size} div 1000 * 1000").alias("low"), F.struct("id", token.cast("int").alias("t")).alias("x"))
    return rows.groupBy("shard_index", "low").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]).alias("piece"))
