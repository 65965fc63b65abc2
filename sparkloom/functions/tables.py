"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


class TokenWindows:
    """Training windows of one partition of pieces, which come in their order: what no later window needs is let go, so a task holds one piece and
    one window, however long the partition is. A window that its pieces do not fill is left out."""

    def __init__(self) -> None:
        self.shard, self.held, self.at, self.window = None, np.zeros(0, np.int32), 0, 0

    def eval(self, piece: Row, length: int, stride: int) -> Iterator[tuple]:
        if length < 1 or stride < 1:
            raise ValueError("length and stride must be positive")
        if piece["shard_index"] != self.shard:  # a task may get several shards
            self.__init__()
            self.shard = piece["shard_index"]
        self.held = np.concatenate([self.held, np.asarray(piece["piece"] or [], np.int32)])
        end = self.at + len(self.held)
        while (begin := self.window * stride) + length + 1 <= end:
            own = self.held[begin - self.at : begin - self.at + length + 1].tolist()
            yield self.shard, self.window, own[:-1], own[1:]
            self.window += 1
        gone = min(begin, end) - self.at
        self.held, self.at = self.held[gone:], self.at + gone


def register(spark: SparkSession) -> None:
    """token_windows(table(pieces) partition by shard_index order by (low), length, stride): shard_index, win_index, input and target from a table with
    the columns shard_index, low and piece; a null piece is empty."""
    spark.udtf.register("token_windows", udtf(TokenWindows, returnType="shard_index bigint, win_index int, input array<int>, target array<int>"))
