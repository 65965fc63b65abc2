"""Checkpoints of a table: a folder for each step, whole or absent, the newest restored by default."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folders(spark: SparkSession, folder: str) -> list[str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in store.listStatus(place) if f.isDirectory()) if store.exists(place) else []


def save(state: DataFrame, folder: str, step: int, kind: str = "step") -> str:
    """Writes the state of a step; `kind` may be emergency. One that is there is never written again."""
    path = f"{folder}/{kind}_{step:010d}"
    state.withColumn("__step", F.lit(step)).write.mode("errorifexists").parquet(path)
    return path


def steps(spark: SparkSession, folder: str) -> list[int]:
    """Steps that were saved whole."""
    names = [n for n in _folders(spark, folder) if n.startswith("step_")]
    done = spark._jvm.org.apache.hadoop.fs.Path
    store = done(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    return [int(n.removeprefix("step_")) for n in names if store.exists(done(f"{folder}/{n}/_SUCCESS"))]


def restore(spark: SparkSession, folder: str, step: int | None = None) -> tuple[int, DataFrame]:
    """(step, state) of the step, or the newest; without any it is a FileNotFoundError."""
    found = steps(spark, folder)
    if not found or step is not None and step not in found:
        raise FileNotFoundError(f"{folder} has no checkpoint" + (f" of step {step}" if step is not None else ""))
    step = max(found) if step is None else step
    return step, spark.read.parquet(f"{folder}/step_{step:010d}").drop("__step")
