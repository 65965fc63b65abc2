"""Training data over a folder of shards: its size, its metadata, and windows and batches for training and validation, read by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import npy_shards
from .shard_source import register


class TokenDataset:
    """Windows of `length` tokens, `stride` apart, that stay in their shard; `val_shard` is kept for validation, if given. A missing manifest, a manifest
    that doesn't fit the files, and a validation shard that is not there are errors at once."""

    def __init__(self, spark: SparkSession, folder: str, length: int, stride: int | None = None, val_shard: int | None = None, batch: int = 8) -> None:
        self.spark, self.folder, self.length, self.stride, self.val_shard, self.batch = spark, folder, length, stride or length, val_shard, batch
        self.metadata = npy_shards.read_manifest(spark, folder)
        if val_shard is not None and val_shard not in [s["index"] for s in self.metadata["shards"]]:
            raise ValueError(f"no shard {val_shard}")
        register(spark)

    def _count(self, val: bool) -> int:
        own = [s["tokens"] for s in self.metadata["shards"] if (s["index"] == self.val_shard) == val]
        return sum((n - self.length - 1) // self.stride + 1 for n in own if n > self.length)

    def __len__(self) -> int:
        """Windows for training."""
        return self._count(False)

    def _source(self, reader, part: str, options: dict) -> DataFrame:
        options = {"length": self.length, "stride": self.stride, "part": "all" if self.val_shard is None else part, "tasks": self.spark.sparkContext.defaultParallelism} | options
        if self.val_shard is not None:
            options["val_shard"] = self.val_shard
        for name, x in options.items():
            if x is not None:
                reader = reader.option(name, x)
        return reader.format("token_windows").load(self.folder)

    def windows(self, part: str = "train", steps: int | None = None, skip: int = 0, seed: int | None = None) -> DataFrame:
        """(step, epoch, shard_index, win_index, input, target): `steps` windows after the first `skip`, or the rest of the first epoch; beyond the last
        window the next epoch begins. With a seed each epoch comes in an order of its own."""
        return self._source(self.spark.read, part, {"steps": steps, "skip": skip, "seed": seed})

    def batched(self, windows: DataFrame, skip: int = 0) -> DataFrame:
        """Adds batch_id and slot, from 0 after the first `skip` steps."""
        at = F.col("step") - skip
        return windows.withColumns({"batch_id": F.floor(at / self.batch), "slot": at % self.batch})

    def train(self, batches: int, skip_tokens: int = 0, seed: int | None = None) -> DataFrame:
        """Whole batches for training, after the windows that skip_tokens hold."""
        skip = skip_tokens // self.length
        return self.batched(self.windows("train", batches * self.batch, skip, seed), skip)

    def validation(self, batches: int) -> DataFrame:
        """Whole batches of the validation shard, whose windows come again when they are used up."""
        if self.val_shard is None:
            raise ValueError("there is no validation shard")
        return self.batched(self.windows("val", batches * self.batch))

    def stream(self, upto: int, skip: int = 0, seed: int | None = None, part: str = "train") -> DataFrame:
        """The endless stream of windows up to a step. A query that is started again with a later step and the same checkpoint goes on where it stood."""
        return self._source(self.spark.readStream, part, {"upto": upto, "skip": skip, "seed": seed})
