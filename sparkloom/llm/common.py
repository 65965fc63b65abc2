"""Helpers that the operators of this folder share."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.sources.files import Scratch, clean, new_folder, remove, shared_dir, stored

__all__ = ["Scratch", "clean", "new_folder", "remove", "shared_dir", "stored"]

#: ASCII whitespace as the contracts define it: space and U+0009 to U+000D.
SPACES = "[\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys up to which a bit table may go to all tasks (2 bytes a key, 32 MB at most); with more keys, all rows count as possible.
TABLE_KEYS = 16_000_000
#: Keys that the bit table takes for others' by mistake and that may go to all tasks themselves (some 100 bytes each).
BROADCAST_KEYS = 500_000
_BLOCK_BITS, _PROBES = 4096, 4


def _bits(key: str) -> list[Column]:
    h = F.xxhash64(F.lit(11), key)
    return [F.shiftrightunsigned(h, 12 * i).bitwiseAND(F.lit(_BLOCK_BITS - 1)) for i in range(_PROBES)]


def bit_table(keys: DataFrame, key: str, most: int = TABLE_KEYS) -> tuple[int, DataFrame] | None:
    """A Bloom filter over a stored table's keys, in blocks of 4096 bits, 16 bits a key, fewer beyond TABLE_KEYS: its number of blocks and its rows; None for
    more than `most` keys."""
    n = keys.count()
    if n > most:
        return None
    blocks = 1 << max(0, (min(n, TABLE_KEYS) * 16 // _BLOCK_BITS - 1).bit_length())
    bit = F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit")
    marks = keys.select(F.pmod(F.xxhash64(F.lit(7), key), F.lit(blocks)).alias("__block"), F.explode(F.array(*_bits(key))).alias("p")).select("__block", F.expr("cast(p div 64 as int)").alias("w"), bit)
    by = marks.groupBy("__block", "w").agg(F.bit_or("bit").alias("bits")).groupBy("__block").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("by"))  # 64 words a block
    numbers = F.transform(F.sequence(F.lit(0), F.lit(_BLOCK_BITS // 64 - 1)), lambda i: F.coalesce(F.try_element_at("by", i), F.lit(0).cast("long")))
    return blocks, stored(by.select("__block", numbers.alias("__words")), "bit-table", few=4)


def possible(rows: DataFrame, key: str, table: tuple[int, DataFrame] | None) -> DataFrame:
    """Adds `__possible`: false only for rows whose key is null or not in the table; true for all where there is none. Nothing is shuffled."""
    if table is None:
        return rows.withColumn("__possible", F.lit(True))
    probes = {f"__p{i}": p for i, p in enumerate(_bits(key))}
    hit = reduce(lambda x, y: x & y, [F.expr(f"shiftrightunsigned(get(__words, cast({p} div 64 as int)), cast({p} % 64 as int)) & 1L") == 1 for p in probes])
    block = F.pmod(F.xxhash64(F.lit(7), key), F.lit(table[0]))
    both = rows.withColumns(probes | {"__b": block}).join(F.broadcast(table[1]), F.col("__b") == F.col("__block"), "left")
    return both.withColumn("__possible", F.col(key).isNotNull() & F.coalesce(hit, F.lit(False))).drop(*probes, "__b", "__block", "__words")


def only(rows: DataFrame, key: str, keys: DataFrame, most: int = TABLE_KEYS) -> DataFrame:
    """The rows whose key is among the keys (a stored table with that column). Only they, and a few others, may be shuffled."""
    return possible(rows, key, bit_table(keys, key, most)).filter("__possible").drop("__possible").join(keys.select(key), key, "left_semi")


def without(rows: DataFrame, key: str, keys: DataFrame, known: DataFrame, most: int = TABLE_KEYS) -> DataFrame:
    """The rows whose key is not among the keys (a stored table); rows with a null key stay. known holds the key of every row, in narrow rows.

    Rows that the bit table tells apart stay where they are. Of the others, those that it takes for one of the keys by mistake
    are found on the narrow rows, so no row that goes is shuffled while the bit table may be used."""
    table = bit_table(keys, key, most)
    if table is None:
        return rows.join(keys.select(key), key, "left_anti")
    wrong = stored(possible(known.select(key), key, table).filter("__possible").select(key).distinct().join(keys.select(key), key, "left_anti"), "not-among", few=True)
    marked = possible(rows, key, table)
    if wrong.count() <= BROADCAST_KEYS:
        right = marked.join(F.broadcast(wrong.select(F.col(key).alias("__stays"))), F.col(key) == F.col("__stays"), "left")
        return right.filter("not __possible or __stays is not null").drop("__possible", "__stays")
    return marked.filter("not __possible").drop("__possible").unionByName(only(marked.filter("__possible").drop("__possible"), key, wrong, most))


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    return F.coalesce(F.array_remove(F.split(text, SPACES), ""), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """How many words, without an array of them left behind."""
    return F.size(words(text)).cast("long")


def bucket_count(rows: int, per_bucket: int = 50) -> int:
    """A power of two: about per_bucket rows a bucket up to 8192 buckets, then four times the root of the rows, so that neither the buckets of a
    group nor the rows of a bucket grow in proportion to the rows."""
    n, most = 1, max(8192, 4 * math.isqrt(rows))
    while n < most and n * per_bucket < rows:
        n *= 2
    return n


def seeded(*parts: Column | str | int) -> Column:
    """A number of 60 bits from the md5 digest of the parts, joined by "|"; null parts are empty."""
    texts = [F.lit(str(p)) if isinstance(p, int) else F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 15), 16, 10).cast("long")


def bucket_of(seeded_bits: Column, n: int) -> Column:
    """Bucket 0 to n - 1 (n a power of two) in the order of a number of 60 bits."""
    return F.shiftright(seeded_bits, 61 - n.bit_length()).cast("int")


def ranked(df: DataFrame, keys: list[str], bucket: str, order: list[Column], rank: str, total: str | None = None) -> DataFrame:
    """Adds `rank`, from 1 in each group of `keys` (nulls are a group), where `bucket` grows with the order.

    No task gets a whole group: rows are numbered in each (keys, bucket), and the number of rows in lower buckets,
    a running sum over the bucket counts, is added. `total` names a column for the group's row count."""
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    below = counts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col(bucket).alias("__b"),
        (F.sum("__n").over(group.orderBy(bucket)) - F.col("__n")).alias("__below"),
        *([F.sum("__n").over(group).alias("__total")] if total else []),
    )
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col(bucket) == F.col("__b")]
    joined = df.join(below, on)
    numbered = joined.withColumn(rank, F.col("__below") + F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)))
    if total:
        numbered = numbered.withColumn(total, F.col("__total"))
    return numbered.drop("__below", "__b", "__total", *[f"__k{i}" for i in range(len(keys))])
