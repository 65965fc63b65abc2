"""Structured Streaming over document files: each micro-batch is encoded and appended; a restart goes on at its checkpoint."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import bpe, documents, ordered, shards
from sparkloom.sources.files import new_folder


def _stream(spark: SparkSession, path: str, files_per_trigger: int) -> DataFrame:
    """The Parquet files of a folder, with those that come later, or a single file. A pattern that only this name matches lets both be read alike."""
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    path = path.rstrip("/")
    exact = re.sub(r"([\[\]{}*?\\])", r"\\\1", path[:-1]) + f"[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(exact)


def encode_stream(spark: SparkSession, path: str, merges: list[tuple[int, int]], folder: str | None = None, files_per_trigger: int = 16) -> DataFrame:
    """Reads the Parquet files at `path` as a stream, encodes them and returns the rows written so far (doc_id, ids). Files that are
    there are processed, then the query stops; a later call with the same folder takes only new files."""
    folder = folder or new_folder(spark, "encode")
    encoded = bpe.encode_documents(_stream(spark, path, files_per_trigger), merges)
    run = encoded.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("doc_id bigint, ids array<int>").parquet(f"{folder}/rows")


PIECES, TOTALS = "shard_index bigint, low bigint, piece array<int>, batch bigint", "total bigint, batch bigint"


def _so_far(spark: SparkSession, folder: str, number: int) -> int:
    """What the micro-batches before this one have added up to: it stands in the row of the last of them."""
    return spark.read.schema(TOTALS).parquet(f"{folder}/totals/batch={number - 1}").agg(F.max("total")).first()[0] if number else 0


def _keep(rows: DataFrame | None, size, folder: str, name: str, number: int, there: int, spark: SparkSession) -> None:
    """Stores a micro-batch's rows, if there are any, and the total up to its end; a batch that runs again writes the same folders anew."""
    own = spark.createDataFrame([(0,)], "total bigint")
    if rows is not None:
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        own = spark.read.schema(rows.schema).parquet(f"{folder}/{name}/batch={number}").agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total"))
    own.select((F.col("total") + there).alias("total")).write.mode("overwrite").parquet(f"{folder}/totals/batch={number}")


def budget_stream(spark: SparkSession, path: str, budget: int, least: int = 100, folder: str | None = None, files_per_trigger: int = 16) -> DataFrame:
    """(doc_id, text, char_count, chars_before): documents of a stream of files until a budget of characters, as documents.char_budget() takes
    them; the stream's order is that of the micro-batches, and doc_id within each. When the budget is reached no more files are read."""
    folder = folder or new_folder(spark, "budget")
    kept = "doc_id bigint, text string, char_count bigint, chars_before bigint"

    def add(batch: DataFrame, number: int) -> None:
        there, rows = _so_far(batch.sparkSession, folder, number), None
        if there < budget:
            rows = ordered.running_before(documents.min_length(batch, least), F.col("char_count"), "chars_before", then=["text"])
            rows = rows.withColumn("chars_before", F.col("chars_before") + there).filter((F.col("chars_before") < budget) | (F.col("chars_before") == 0))
            rows = rows.select("doc_id", "text", "char_count", "chars_before")
        _keep(rows, F.col("char_count"), folder, "rows", number, there, batch.sparkSession)

    run = _stream(spark, path, files_per_trigger).writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(kept).parquet(f"{folder}/rows")


def shard_stream(spark: SparkSession, path: str, merges: list[tuple[int, int]], shard_size: int, folder: str | None = None, files_per_trigger: int = 16) -> DataFrame:
    """(shard_index, low, piece) of a token stream that grows: micro-batches one after another, by doc_id within each.

    The state is where the stream has got to: each micro-batch stores the number of tokens up to its end beside its pieces, and begins where the one before it
    ends: one row is read, however many batches there were, so a shard that one batch leaves unfinished is gone on with by the next. A batch that runs again writes the same folders anew.
    Files that are there are processed, then the query stops; a later call with the same folder takes only new files."""
    folder = folder or new_folder(spark, "shard-stream")

    def add(batch: DataFrame, number: int) -> None:
        there = _so_far(batch.sparkSession, folder, number)
        parts = shards.pieces(bpe.encode_documents(batch, merges), shard_size, skip=-there)
        _keep(parts, F.size("piece"), folder, "pieces", number, there, batch.sparkSession)

    run = _stream(spark, path, files_per_trigger).writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(PIECES).parquet(f"{folder}/pieces").drop("batch")
