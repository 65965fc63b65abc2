"""The table function for windows against plain slices."""

import random

import pytest

from sparkloom.functions import tables


@pytest.mark.parametrize(("length", "stride"), [(1, 1), (4, 4), (5, 2), (3, 7)])
def test_windows_however_pieces_are_cut(spark, length, stride):
    rng = random.Random(length * 10 + stride)
    rows, want = [], []
    for shard in range(9):
        tokens, at = [rng.randrange(1000) for _ in range(rng.choice([0, 1, length, length + 1, 40]))], 0
        while at < len(tokens):
            n = rng.randint(1, 9)
            rows.append((shard, at, tokens[at : at + n]))
            at += n
        rows.append((shard, at, rng.choice([None, []])))
        starts = range(0, len(tokens) - length, stride)
        want += [(shard, k, tokens[s : s + length], tokens[s + 1 : s + length + 1]) for k, s in enumerate(starts)]
    rng.shuffle(rows)
    tables.register(spark)
    spark.createDataFrame(rows, "shard_index bigint, low bigint, piece array<int>").createOrReplaceTempView("cut_pieces")
    call = f"select * from token_windows(table(cut_pieces) partition by shard_index order by (low), {length}, {stride})"
    assert sorted(tuple(r) for r in spark.sql(call).collect()) == want


def test_a_stride_must_be_positive(spark):
    tables.register(spark)
    spark.createDataFrame([(0, 0, [1, 2])], "shard_index bigint, low bigint, piece array<int>").createOrReplaceTempView("cut_pieces")
    with pytest.raises(Exception, match="positive"):
        spark.sql("select * from token_windows(table(cut_pieces) partition by shard_index order by (low), 1, 0)").collect()
