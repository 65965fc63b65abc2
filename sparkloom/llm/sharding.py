"""Proportional stratified interleaving: every shard gets the corpus' mixture of sources.

Rows are put in a seeded order within each source; the row of rank r among n has the fractional rank (r - 1/2) / n. All
rows are sorted by it and cut into shards whose counts differ by one at most, so each run of rows, and with it each
shard, holds every source in proportion. Both ranks come from bucket counts and numbers within buckets (see
common.ranked): a source with a third of all rows is spread over as many tasks as the rest.

Defined results: null sources are a source; a null text has size 16 and checksum 0; null doc_ids are rows like any
other; repeated rows each get a slot of their own (which of them gets which is open, the result is the same).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, bucket_of, ranked, seeded, stored

SHARDS, SEED, OVERHEAD = 40, 17, 16


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, overhead: int = OVERHEAD) -> DataFrame:
    """Per row: doc_id, source, size (UTF-8 bytes and `overhead`), text_crc32, law ('rows'), shard, slot (from 0, gapless in
    each shard), grown_shard (null: another shard count moves rows between all shards)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = stored(rows.withColumn("__h", seeded(seed, "doc_id", "source", "text_crc32")), "sharding-rows")
    n = rows.count()
    buckets = bucket_count(n)
    ties = [F.col("__h"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranks = ranked(rows.withColumn("__bucket", bucket_of(F.col("__h"), buckets)), ["source"], "__bucket", ties, "__rank", "__n")
    fraction = (F.col("__rank") - 0.5) / F.col("__n")
    placed = ranks.withColumn("__at", fraction).withColumn("__bucket", F.floor(F.col("__at") * buckets).cast("int"))
    placed = ranked(placed, [], "__bucket", [F.col("__at"), seeded(seed, "source"), F.col("source"), *ties], "__place")
    place = F.col("__place") - 1
    # shard s starts at ceil(s * n / shards)
    number = F.expr(f"(__place - 1) * {shards} div {max(n, 1)}")
    out = placed.withColumn("shard", number.cast("int"))
    start = F.expr(f"(cast(shard as bigint) * {n} + {shards - 1}) div {shards}")
    return out.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (place - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
