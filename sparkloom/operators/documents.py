"""Scans, filters, dense ids and budget prefixes over documents in the order of doc_id (null last, equal ids by text).

doc_id may have any type that has an order: numbers, texts, timestamps. Running sums are those of operators.ordered, which put no more
than a range of the rows into one task; a budget first finds the id at which it is used up, and only the rows up to there go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import running_before, until


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, column: str = "text", id_col: str = "doc_id", strict: bool = False) -> DataFrame:
    """doc_id and text from columns of any name. `strict`: a null text is an error when the plan runs."""
    text = F.col(column).cast("string")
    if strict:
        text = F.when(text.isNull(), F.raise_error(F.concat(F.lit("no text at "), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).cast("string")).otherwise(text)
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))


def with_chars(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and char_count (code points)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.char_length(text).cast("long").alias("char_count"))


def min_length(docs: DataFrame, least: int = 100) -> DataFrame:
    return with_chars(docs).filter(F.col("char_count") >= least)


def non_empty(docs: DataFrame) -> DataFrame:
    return docs.filter("text is not null and text <> ''")


def dense_ids(docs: DataFrame, least: int = 100) -> DataFrame:
    return running_before(min_length(docs, least), F.lit(1).cast("long"), "dense_id", then=["text"])


def char_budget(docs: DataFrame, budget: int, least: int = 100) -> DataFrame:
    """Documents until the budget: the one that crosses it stays whole, and the first always stays."""
    some = until(min_length(docs, least), F.col("char_count"), max(budget, 1))
    return running_before(some, F.col("char_count"), "chars_before", then=["text"]).filter((F.col("chars_before") < budget) | (F.col("chars_before") == 0))


def token_budget(encoded: DataFrame, budget: int) -> DataFrame:
    """ids cut so that their total is the budget exactly, if there are as many. encoded: doc_id, ids; stored once."""
    rows = running_before(encoded, F.size("ids").cast("long"), "tokens_before", then=["ids"]).filter(F.col("tokens_before") < budget)
    return rows.withColumn("ids", F.expr(f"slice(ids, 1, cast(least(size(ids), {budget} - tokens_before) as int))"))


def least_tokens(docs: DataFrame, budget: int, longest: int, more: int = 1) -> DataFrame:
    """The first documents, by their bytes alone, that can be needed for `budget` tokens: a text has at least a token for every `longest`
    bytes, and `more` beside. What comes after them need not be encoded."""
    least = (F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / longest) + more).cast("long")
    return until(docs.select("doc_id", "text"), least, budget)
