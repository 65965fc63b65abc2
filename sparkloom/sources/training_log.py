"""Training logs: one JSON object a line, step rows and event rows, appended and read with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "step bigint, loss double, val_loss double, lr double, grad_norm double, `tok/s` bigint, ts string, event string, err string"


def append(rows: DataFrame, folder: str) -> None:
    """Adds rows (any of the schema's columns) to the log; nulls are left out of the lines."""
    rows.write.mode("append").json(folder)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def steps(log: DataFrame) -> DataFrame:
    return log.filter("event is null")


def evaluations(log: DataFrame) -> DataFrame:
    """(step, val_loss) of the steps that were evaluated."""
    return steps(log).filter("val_loss is not null").select("step", "val_loss")


def finite(x: Column) -> Column:
    """False for null, NaN and infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def broken(log: DataFrame) -> DataFrame:
    """Event rows (event, step, loss) for steps whose loss is not finite."""
    return steps(log).filter(~finite(F.col("loss"))).select(F.lit("nan").alias("event"), "step", "loss")


def mean_of_first(rows: DataFrame, value: str, order: str, n: int) -> DataFrame:
    """One row, mean_value: the mean over the first n rows at most; 0 without any."""
    return rows.orderBy(order).limit(n).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean_value"))


def throughput(rows: DataFrame, run: str, order: str, at: str, tokens: int, budget: int) -> DataFrame:
    """Per step of each run: seconds since the step before, tokens a second (null for the first), per cent of the budget so far and seconds
    to go at the mean rate. at is a timestamp."""
    over = Window.partitionBy(run).orderBy(at, order)
    clock = F.col(at).cast("timestamp").cast("double")
    seconds = clock - F.lag(clock).over(over)
    n = F.row_number().over(over)
    rows = rows.withColumn("seconds", seconds).withColumn("done", n.cast("long") * tokens).withColumn("elapsed", clock - F.first(clock).over(over))
    rate = (F.col("done") - tokens) / F.col("elapsed")
    return rows.select(run, order, "seconds", F.when(F.col("seconds") > 0, tokens / F.col("seconds")).alias("tokens_per_second"), (100.0 * F.col("done") / budget).alias("percent"), F.when(F.col("elapsed") > 0, F.greatest(F.lit(0.0), (budget - F.col("done")) / rate)).alias("seconds_to_go"))
