"""Corpora as plain text: documents one after another with a marker between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "<|endoftext|>"


def dump(docs: DataFrame, folder: str, column: str = "text", marker: str = MARKER) -> None:
    """Writes each text and, on a line of its own, the marker. A null text is an error when the plan runs; an existing folder is, too."""
    text = F.col(column).cast("string")
    checked = F.when(text.isNull(), F.raise_error(F.lit("a document has no text")).cast("string")).otherwise(text)
    docs.select(checked.alias("value")).write.mode("errorifexists").option("lineSep", f"\n{marker}\n").text(folder)


def read_delimited(spark: SparkSession, path: str, separator: str = f"\n{MARKER}\n") -> DataFrame:
    """(text): the pieces of the files between separators. Bytes that are no UTF-8 are an error when the plan runs."""
    value = F.col("value")
    sound = F.when(~F.is_valid_utf8(value), F.raise_error(F.lit("the text is not valid UTF-8")).cast("string")).otherwise(value)
    return spark.read.option("lineSep", separator).text(path).select(sound.alias("text"))
