"""A training-data pipeline over `documents`: quality rules, near-duplicates, decontamination, mixing, shards.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; run() writes each stage's rows as
Parquet to the shared folder and reads them again for the next.

Stages decide on narrow rows (ids, hashes, counts), which they store; texts are read again where a decision is applied and are shuffled
only where a bit table can't tell them apart from what goes. Defined results: an empty table gives an empty table; nulls, repeated rows
and other columns as each stage says; columns of docs keep their names and order, whatever they are called."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontamination, mixing, near_duplicates, quality, sharding
from sparkloom.llm.common import Scratch, only, read_table, stored, without, word_count


def _as_row(docs: DataFrame, *more) -> DataFrame:
    """Each row as a struct `__row` beside columns of the stage's own."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), *more)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules reject; null and empty texts fail them. Rows that repeat are judged alike. Texts with a good
    label are scored twice, once for the cutoffs and once, like all others, to drop rows."""
    return quality.quality(_as_row(docs, "doc_id", "text", "lang"), read_table(spark, sf_dir, "labels")).filter("kept").select("__row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the row with the smallest doc_id (null last), of equal rows one.

    Rows are told apart by doc_id and text, and texts are linked whatever their ids: rows without a doc_id take part, and different
    texts under one doc_id stay apart unless they are near. Texts without a word are linked with nothing; of those that share doc_id and text one
    stays, those without a doc_id all stay."""
    with Scratch(spark) as scratch:
        rows, found = near_duplicates.classes(docs.select("doc_id", "text"))
        # a group's name: the component, or for texts without words the row itself
        grouped = rows.filter("n > 0").join(found, ["d1", "d2", "n"]).select(F.col("component").cast("string").alias("group"), "doc_id", "key")
        bare = rows.filter("n = 0 and doc_id is not null").select(F.concat(F.lit("="), "key").alias("group"), "doc_id", "key")
        texts = stored(grouped.unionByName(bare).groupBy("group", "key", "doc_id").agg(F.count(F.lit(1)).alias("n")), "pipeline-texts", few=True)
        lead = texts.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "n")).alias("lead"), F.sum("n").alias("rows"))
        lead = lead.filter("rows > 1").select("group", F.col("lead.key").alias("first"), F.col("lead.n").alias("n"))
        # keys that go, and those of which one of several equal rows stays
        out = texts.select("group", "key").join(lead, "group").filter("key <> first or n > 1").select(F.col("key").alias("__key"), (F.col("key") == F.col("first")).alias("stays"))
        out, rows = scratch.keep(stored(out, "pipeline-gone", few=True)), scratch.keep(rows)
        again = scratch.keep(stored(out.filter("stays").select("__key"), "pipeline-again", few=4))
    keyed = docs.withColumn("__key", near_duplicates.row_key())
    kept = without(keyed, "__key", out, rows.select(F.col("key").alias("__key")))
    if not again.isEmpty():
        kept = kept.unionByName(only(keyed, "__key", again).dropDuplicates(["__key"]))
    return kept.select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window of a benchmark item, by two hashes of the text: what is found depends on the text alone. Null
    texts have no words and stay."""
    key = F.concat_ws(":", F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    found = decontamination.decontaminate(docs.select(key.alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    gone = stored(found.filter("contaminated").select(F.col("doc_id").alias("__key")).distinct(), "pipeline-contaminated", few=True)
    keyed = docs.withColumn("__key", key)
    return without(keyed, "__key", gone, keyed.select("__key")).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Texts without words are never taken; a null source is a source."""
    taken = mixing.mix(_as_row(docs, "doc_id", "source", word_count(F.col("text")).alias("size"))).filter("taken > 0")
    return taken.select(F.explode(F.array_repeat("__row", F.expr("taken div size").cast("int"))).alias("__row")).select("__row.*")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row; see sharding.shard for nulls and repeated rows."""
    return sharding.shard(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SuperMinHash and union-find have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. A stage's rows and what it stored go when the next stage's are written."""
    docs, path = read_table(spark, sf_dir, "documents"), None
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            with Scratch(spark) as step:
                docs = step.keep(stored(stage(spark, docs, sf_dir), f"pipeline-{name}"))
            if path:
                scratch.drop(path)
            path = docs
        return scratch.keep(stored(STAGES[-1][1](spark, docs, sf_dir), "pipeline-shards"))
