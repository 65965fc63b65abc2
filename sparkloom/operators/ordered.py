"""Running sums over rows in an order of their own: ids of any type that Spark can sort, dense or sparse, hashed or text.

Rows are sampled and dealt to partitions by ranges of their keys, so a partition has about as many rows as any other whatever the ids are.
Each partition sums up its own rows, partitions get the sum of those before them, and both are added. Rows are stored once with a number of
their own that settles equal keys: a key that a third of all rows share is split like any other. One row a partition is all that meets in
one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from sparkloom.sources.files import stored

#: The rows' own number, and the partition and the sum within it while sums are made.
ROW, _PART, _INSIDE = "__u", "__part", "__inside"


def with_row_numbers(df: DataFrame, name: str) -> DataFrame:
    """df, stored, with a number for each row in ROW. What is read again is the same however often, so numbers stay with their rows."""
    return stored(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def sums_before(rows: DataFrame, keys: list[Column], value: str, name: str, parts: int | None = None) -> DataFrame:
    """Adds `name`: the sum of the column `value` (whole numbers, no null) over the rows before, by keys and then ROW. rows: narrow, from
    with_row_numbers(); the result is stored. `parts`: partitions, otherwise as many as Spark's shuffles have."""
    order = [*keys, F.col(ROW).asc()]
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    inside = dealt.sortWithinPartitions(*order).withColumn(_PART, F.spark_partition_id())
    schema = StructType([*inside.schema.fields]).add(_INSIDE, LongType())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            own = pc.cast(batch.column(value), pa.int64()).to_numpy(zero_copy_only=False)
            upto = total + np.cumsum(own)
            total = int(upto[-1]) if len(own) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - own, pa.int64())], [*batch.schema.names, _INSIDE])

    summed = stored(inside.mapInArrow(add, schema), "sums")
    by_part = summed.groupBy(_PART).agg(F.sum(value).alias("__t"))
    above = by_part.select(_PART, (F.sum("__t").over(Window.orderBy(_PART)) - F.col("__t")).alias("__above"))  # one row a partition
    return summed.join(F.broadcast(above), _PART).withColumn(name, F.col("__above") + F.col(_INSIDE)).drop(_PART, _INSIDE, "__above")


def running_before(df: DataFrame, value: Column, name: str, order: str = "doc_id", then: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Adds `name`: the sum of value (whole numbers) over the rows before, by `order` (any type with an order, null last) and, of equal
    ones, by the columns `then` (null first). Rows that are equal in these come in any order, each with a place of its own.

    df is stored once; only keys and values are sorted, with `then` only where a key occurs more than once, and the sums join
    their rows by row number."""
    rows = with_row_numbers(df.withColumn("__v", value.cast("long")), "in-order")
    key, then = F.col(order), then or []
    narrow = rows.select(key.alias("__k"), ROW, "__v")
    tied = []
    if then:
        again = stored(narrow.groupBy("__k").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(F.col("__k").alias("__again"), F.lit(True).alias("__tie")), "equal-keys", few=True)
        if not again.isEmpty():
            both = rows.join(again, key.eqNullSafe(F.col("__again")), "left")
            narrow = both.select(key.alias("__k"), ROW, "__v", *[F.when(F.col("__tie"), F.col(c)).alias(f"__t{i}") for i, c in enumerate(then)])
            tied = [F.col(f"__t{i}").asc_nulls_first() for i in range(len(then))]
    sums = sums_before(narrow, [F.col("__k").asc_nulls_last(), *tied], "__v", name, parts)
    return rows.drop(name).join(sums.select(ROW, name), ROW).drop(ROW, "__v")


def until(df: DataFrame, value: Column, most: int, order: str = "doc_id") -> DataFrame:
    """The rows of df, by `order` (null last), among which the running sum of value reaches `most`, with all rows that are equal in `order` to
    the last of them. Only keys and values are stored and sorted: the key where the sum is reached becomes a filter on df's own rows."""
    narrow = with_row_numbers(df.select(F.col(order).alias("__k"), value.cast("long").alias("__v")), "until")
    reached = sums_before(narrow, [F.col("__k").asc_nulls_last()], "__v", "__before").filter(F.col("__before") < most)
    last = reached.agg(F.max(F.struct(F.col("__k").isNull().alias("none"), "__k")).alias("last")).select("last.*").first()
    if last["none"] is None:
        return df.limit(0)
    return df if last["none"] else df.filter(F.col(order) <= F.lit(last["__k"]))
