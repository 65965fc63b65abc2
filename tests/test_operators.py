"""Operators of the engine against plain Python."""

import json
import os
import random
from itertools import accumulate

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from sparkloom.functions import patterns
from sparkloom.functions.merges import MERGES
from sparkloom.functions.permutation import permuted
from sparkloom.operators import bpe, documents, kernels, model, ordered, shards
from sparkloom.sources import checkpoints, configs, corpus_text, npy_shards, safetensors, training_log
from sparkloom.sources.token_dataset import TokenDataset
from sparkloom.streaming import encode as streaming

TEXTS = ["Hello world", "  it's 12_3!!\n\n\tx", "", "café 日本語 🔥", "aaa aaaa the the then", None]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_pretokens_lose_nothing(spark):
    rows = docs(spark).select("text", bpe.pretokens(F.col("text")).alias("p")).collect()
    assert all("".join(r["p"]) == (r["text"] or "") for r in rows)


def test_encode_is_greedy_and_round_trips(spark):
    word = bpe.WordEncoder(MERGES)
    rows = docs(spark).select("doc_id", "text", bpe.pretokens(F.col("text")).alias("p"), bpe.encode_text(F.col("text"), MERGES).alias("ids")).collect()
    for r in rows:
        assert r["ids"] == [i for w in r["p"] for i in word(w)]
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(bpe.encode_documents(docs(spark), MERGES), MERGES).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def plain_greedy(word, merges):
    """The rule itself: the pair of least rank, all its occurrences from left to right, until there is none."""
    rank, ids = {p: i for i, p in enumerate(merges)}, [b + 5 for b in word.encode()]
    while pairs := [rank[p] for p in zip(ids, ids[1:], strict=False) if p in rank]:
        pair, out = merges[min(pairs)], []
        while ids:
            n = 2 if tuple(ids[:2]) == pair else 1
            out, ids = [*out, 261 + min(pairs) if n == 2 else ids[0]], ids[n:]
        ids = out
    return ids


def test_all_ways_to_encode_agree(spark):
    r, word = random.Random(5), bpe.WordEncoder(MERGES)
    for _ in range(500):
        w = "".join(r.choice("the aning  ") for _ in range(r.randint(0, 30)))
        assert word(w) == plain_greedy(w, MERGES)
    texts = [*TEXTS, "a<|eos|>", "<|endoftext|>", "<|bos|>hello  <|eos|>!!<|pad|>x <|unk", "  <|eos|>  "]
    d = docs(spark, texts)
    tokenizer = bpe.Tokenizer(MERGES)
    want = {i: tokenizer.encode(t or "") for i, t in enumerate(texts)}
    got = lambda df: {x["doc_id"]: x["ids"] for x in df.collect()}
    assert got(bpe.encode_documents(d, MERGES, add_eot=False)) == want
    assert got(d.select("doc_id", bpe.encode_text(F.col("text"), MERGES, bpe.SPECIALS).alias("ids"))) == want
    assert got(bpe.encode_with(d, tokenizer, add_eot=False)) == want
    both = got(bpe.encode_documents(d, MERGES, add_bos=True, add_eos=True))
    assert both == {i: [0, 3, *x, 4] for i, x in want.items()}
    as_text = got(bpe.encode_documents(d, MERGES, add_eot=False, allow_special=False))
    assert as_text == got(bpe.encode_by_join(d, MERGES, add_eot=False)) == got(d.select("doc_id", bpe.encode_text(F.col("text"), MERGES).alias("ids")))
    assert all(i >= 5 for x in as_text.values() for i in x)


def split_first(text):
    """Pre-tokens of the chunks between special strings, which stand for themselves."""
    parts = regex.split(f"({patterns.special_pattern()})", text)
    return [w for c in parts if c for w in ([c] if c in bpe.SPECIALS else regex.findall(patterns.in_python(patterns.PRETOKEN), c))]


def test_special_strings_split_texts_first(spark):
    r = random.Random(2)
    pieces = ["a", " ", "  ", "\n", "!", "'s", "<", "|", ">", "<|", "<|eos|>", "<|pad|>", "endoftext", "<|endoftext|>", "1", "é", "_"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 9))) for _ in range(600)]
    d = docs(spark, texts).select("doc_id", bpe.pretokens(F.col("text"), specials=bpe.SPECIALS).alias("p"))
    assert {x["doc_id"]: x["p"] for x in d.collect()} == {i: split_first(t) for i, t in enumerate(texts)}


def test_tokenizer_object():
    t = bpe.Tokenizer(MERGES)
    assert t.encode("<|endoftext|>") == [0] and t.encode("") == [] and 0 in t.encode("hello<|endoftext|>world")
    ids = t.encode("<|bos|>hello<|eos|>")
    assert (ids[0], ids[-1]) == (3, 4) and t.encode("x", add_bos=True, add_eos=True) == [3, 5 + ord("x"), 4]
    assert t.decode([]) == "" and "?" in t.decode([99999]) and t.decode([0, 125]) == "x" and t.decode([0], skip_special_tokens=False) == "<|endoftext|>"
    assert t.decode_single_token(5) == b"\x00" and t.decode_single_token(0) == b"<|endoftext|>" and t.vocab_size == 261 + len(MERGES)
    assert t.decode([5 + 0xFF, 5 + 0x41], errors="ignore") == "A" and t.decode([5 + 0xFF]) == "\ufffd"
    for text in ["café résumé naïve 日本語", "emoji: 🔥", " a  b\n\tc "]:
        assert t.decode_batch(t.encode_batch([text])) == [text]
    assert t.encode_as_uint16("hello") == t.encode("hello")
    broken = bpe.Tokenizer(MERGES, {"<|endoftext|>": 40000})
    with pytest.raises(ValueError, match="out of range"):
        broken.encode_as_uint16("a<|endoftext|>")
    trained = bpe.Trainer(300, tie="first").train(["ab", "ab", "cd", "cd"])
    assert trained.merges == [(5 + 97, 5 + 98), (5 + 99, 5 + 100)] and bpe.Trainer(300).train(["ab", "ab", "cd", "cd"]).merges[0] == (5 + 99, 5 + 100)
    assert bpe.Tokenizer.from_trainer(trained).encode("ab") == [261] and trained.token_to_id[b"ab"] == 261


def test_decoding_errors(spark):
    r = random.Random(9)
    rows = [(i, [r.choice([5 + 0xFF, 5 + 0xC3, 5 + 0xE3, 5 + 0xA9, 5 + 0xF0, 5 + 0x9F, 5 + 0x41, 0, 7000, 262]) for _ in range(r.randint(0, 8))]) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    t = bpe.Tokenizer(MERGES)
    for errors in ("replace", "ignore"):
        for skip in (True, False):
            want = {i: t.decode(x, skip, errors) for i, x in rows}
            assert {x["doc_id"]: x["text"] for x in bpe.decode_documents(d, MERGES, skip, errors).collect()} == want
    large = [*MERGES, *[(5, 5 + i) for i in range(1, 256)], *[(6, 5 + i) for i in range(256)], *[(7, 5 + i) for i in range(256)]]
    t = bpe.Tokenizer(large)
    assert {x["doc_id"]: x["text"] for x in bpe.decode_documents(d, large).collect()} == {i: t.decode(x) for i, x in rows}
    t = bpe.Tokenizer(large)
    for errors in ("replace", "ignore"):
        for skip in (True, False):
            got = bpe.decode_documents(spark.createDataFrame([*rows, (400, None)], d.schema), large, skip, errors).collect()
            assert {x["doc_id"]: x["text"] for x in got} == {i: t.decode(x, skip, errors) for i, x in rows} | {400: None}
    for m in (MERGES, large):
        with pytest.raises(Exception):
            bpe.decode_documents(d, m, errors="strict").collect()
    with pytest.raises(Exception, match="out of range"):
        d.select(bpe.as_uint16(F.transform("ids", lambda x: x + 40000))).collect()


def test_distributed_learning_agrees(spark):
    d = docs(spark, ["hello world hello", "the then there", "aaa aaaa"] * 3)
    assert bpe.train(d, 290, driver_words=0) == bpe.train(d, 290)


def test_public_merge_table(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no public vocabulary here")
    merges = bpe.from_byte_level(path, 3000)
    word = bpe.WordEncoder(merges)
    for w in (" the", "hello", " international", "日本語", "aaaaaaaa"):
        assert word(w) == plain_greedy(w, merges)
    assert len(word(" the")) == 1
    d = docs(spark)
    back = bpe.decode_documents(bpe.encode_documents(d, merges), merges)
    assert {x["doc_id"]: x["text"] for x in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_learning(spark):
    assert len(bpe.learn_merges([("ab", 2)], 10)) == 1
    merges = bpe.train(docs(spark, ["hello world", "hello there"] * 20), 300)
    seqs = {w: [b + 5 for b in w.encode()] for w in ["hello", " world", " there"]}
    freq = {"hello": 40, " world": 20, " there": 20}
    for k, got in enumerate(merges):
        count = {}
        for w, s in seqs.items():
            for p in zip(s, s[1:], strict=False):
                count[p] = count.get(p, 0) + freq[w]
        assert got == max(count, key=lambda p: (count[p], p))
        for w, s in seqs.items():
            out = []
            while s:
                if tuple(s[:2]) == got:
                    out, s = [*out, 261 + k], s[2:]
                else:
                    out, s = [*out, s[0]], s[1:]
            seqs[w] = out


def test_artifact(tmp_path):
    path = bpe.save(MERGES, str(tmp_path))
    assert bpe.load(path) == MERGES
    with pytest.raises(FileExistsError):
        bpe.save(MERGES, str(tmp_path))
    (tmp_path / "bad.json").write_text('{"version": "9.9", "vocab_size": 261, "special_tokens": {}, "merges": []}')
    with pytest.raises(ValueError):
        bpe.load(str(tmp_path / "bad.json"))


@pytest.mark.parametrize("size,length,stride", [(7, 3, 2), (5, 5, 5), (64, 8, 8)])
@pytest.mark.parametrize("parts", [1, 5])
def test_shards_and_windows(spark, size, length, stride, parts):
    lists = [list(range(i, i + n)) for i, n in enumerate([0, 3, 11, 1, 30, 7, 0, 19])]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>").repartition(parts)
    flat = [x for y in lists for x in y]
    want = [flat[i : i + size] for i in range(0, len(flat), size)]
    laid = shards.layout(df, size)
    assert [r["tokens"] for r in laid.orderBy("shard_index").collect()] == want
    wins = [(s, t[a : a + length], t[a + 1 : a + length + 1]) for s, t in enumerate(want) for a in range(0, len(t) - length, stride)]
    for got in (shards.windows(laid, length, stride), shards.windows_of_pieces(shards.pieces(df, size), size, length, stride)):
        assert [(r["shard_index"], r["input"], r["target"]) for r in got.orderBy("shard_index", "win_index").collect()] == wins
    for skip, budget in ((0, 20), (13, None), (13, 40), (-4, None)):
        part = ([None] * -skip + flat[: budget or len(flat)])[max(skip, 0) :]
        want = [[x for x in part[i : i + size] if x is not None] for i in range(0, len(part), size)]
        got = shards.assembled(shards.pieces(df, size, skip, budget)).orderBy("shard_index").collect()
        assert [r["tokens"] for r in got] == [w for w in want if w]


def test_missing_validation_shard_is_an_error(spark):
    df = spark.createDataFrame([(0, [1, 2, 3])], "shard_index long, tokens array<int>")
    with pytest.raises(Exception, match="no shard 9"):
        shards.split(df, 9, True).collect()


def test_running_sum_at_any_partitioning(spark):
    df = spark.range(3000).withColumnRenamed("id", "doc_id").repartition(7)
    rows = ordered.running_before(df, F.col("doc_id"), "s").collect()
    assert all(r["s"] == r["doc_id"] * (r["doc_id"] - 1) // 2 for r in rows)
    assert sorted(ordered.running_before(df, F.col("doc_id"), "s", parts=23).collect()) == sorted(rows)


IDS = {
    "hashed": "xxhash64(n)",
    "text": "'doc-' || md5(cast(n as string))",
    "time": "timestamp_seconds(n * n)",
    "a third alike": "if(n % 3 = 0, 7, n)",
    "a third null": "if(n % 3 = 0, null, n)",
}


@pytest.mark.parametrize("kind", IDS)
def test_ids_of_any_kind(spark, kind):
    """Dense ids, budgets and shards by ids that are sparse, no numbers, alike or missing."""
    d = spark.range(2000).withColumnRenamed("id", "n").select(F.expr(IDS[kind]).alias("doc_id"), F.concat(F.lit("t"), "n").alias("text")).repartition(5)
    want = sorted(((r["doc_id"] is None, r["doc_id"] if r["doc_id"] is not None else 0, r["text"]) for r in d.collect()))
    rows = ordered.running_before(d, F.char_length("text"), "s", then=["text"], parts=16)
    got = sorted((r["s"], r["text"]) for r in rows.collect())
    assert [t for _, t in got] == [t for *_, t in want] and [s for s, _ in got] == [0, *accumulate(len(t) for *_, t in want)][:-1]
    assert [r["text"] for r in documents.dense_ids(d, 0).orderBy("dense_id").collect()] == [t for *_, t in want]
    upto = next(i for i, n in enumerate(accumulate(len(t) for *_, t in want)) if n >= 5000) + 1
    assert sorted(r["text"] for r in documents.char_budget(d, 5000, 0).collect()) == sorted(t for *_, t in want[:upto])
    laid = shards.layout(d.select("doc_id", F.array(F.substring("text", 2, 9).cast("int")).alias("ids")), 300).orderBy("shard_index").collect()
    ids = [int(t[1:]) for *_, t in want]
    assert sorted(x for r in laid for x in r["tokens"]) == sorted(ids) and [len(r["tokens"]) for r in laid] == [300] * 6 + [200]
    if kind not in ("a third alike", "a third null"):
        assert [x for r in laid for x in r["tokens"]] == ids


def test_no_task_gets_most_rows(spark):
    """The partitions of a sum, by rows, where ids are hashed, and where a third of the rows are equal in every column."""
    for d in (spark.range(30_000).select(F.xxhash64("id").alias("k")), spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"))):
        rows = ordered.with_row_numbers(d.withColumn("v", F.lit(1)), "rows")
        by = ordered.sums_before(rows, [F.col("k").asc_nulls_last()], "v", "s", parts=16)
        assert sorted(r["s"] for r in by.collect()) == list(range(30_000))
        dealt = rows.repartitionByRange(16, F.col("k").asc_nulls_last(), F.col(ordered.ROW)).groupBy(F.spark_partition_id()).count().collect()
        assert len(dealt) == 16 and max(r["count"] for r in dealt) < 4 * 30_000 / 16


def test_until_reads_no_further(spark):
    d = spark.createDataFrame([(i, "x" * 10) for i in range(50)] + [(None, "y" * 10)], "doc_id long, text string")
    size = F.char_length("text")
    assert sorted(r[0] for r in ordered.until(d, size, 95).collect()) == list(range(10)) and ordered.until(d, size, 10**6).count() == 51
    assert ordered.until(d, size, 501).count() == 51 and ordered.until(d, size, 0).count() == 0 and ordered.until(d.limit(0), size, 5).count() == 0


def test_null_and_equal_ids_keep_their_rows(spark):
    df = spark.createDataFrame([(None, "b" * 100), (3, "a" * 100), (3, "A" * 100), (None, "a" * 100), (1, None)], "doc_id long, text string")
    rows = documents.dense_ids(df, 0).orderBy("dense_id").collect()
    assert [(r["doc_id"], (r["text"] or "")[:1], r["dense_id"]) for r in rows] == [(1, "", 0), (3, "A", 1), (3, "a", 2), (None, "a", 3), (None, "b", 4)]
    tokens = shards.layout(bpe.encode_documents(df, []), 1000).first()["tokens"]
    assert len(tokens) == 405 and tokens[:3] == [0, 0, 5 + ord("A")]


def test_budget_needs_no_other_documents(spark):
    d = spark.createDataFrame([(i, "the then there " * (i % 5)) for i in range(300)], "doc_id long, text string")
    for budget in (1, 50, 700, 10**6):
        whole = documents.token_budget(bpe.encode_documents(d, MERGES), budget)
        needed = documents.least_tokens(d, budget, 13)
        some = documents.token_budget(bpe.encode_documents(needed, MERGES), budget)
        assert sorted(some.collect()) == sorted(whole.collect())
    assert needed.count() == 300 and documents.least_tokens(d, 50, 13).count() < 60


def test_kernels(spark):
    df = spark.createDataFrame([([1.0, -2.0, 3.0, 4.0],), ([0.0, 0.0, 0.0, 0.0],)], "x array<float>")
    x = F.col("x")
    a, b = (r["y"] for r in df.select(kernels.rms_norm(x).alias("y")).collect())
    assert abs(np.sqrt(np.mean(np.square(a))) - 1) < 1e-4 and b == [0.0] * 4
    back = df.select(kernels.rope(kernels.rope(x, F.lit(7)), F.lit(7), invert=True).alias("y"), kernels.rope(x, F.lit(0)).alias("z")).collect()
    assert np.allclose(back[0]["y"], [1, -2, 3, 4], atol=1e-4) and back[0]["z"] == [1, -2, 3, 4]
    got = {r["name"]: r["p"] for r in kernels.presets(spark).select("name", kernels.param_count().alias("p")).collect()}
    assert got == {"25m": 27_791_872, "125m": 128_994_048, "350m": 316_720_128}


@pytest.mark.parametrize("context,block", [(96, 7), (96, 96), (10, 64)])
def test_attention_by_parts(spark, context, block):
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 8)) * 3
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, x array<double>").repartition(3)
    got = {(y["id"], y["head"]): y["out"] for y in kernels.causal_attention(d, "i", "x", context, 4, 2, block).collect()}
    for i in range(200):
        for h in range(4):
            keys = x[i // context * context : i + 1, h // 2 * 2 : h // 2 * 2 + 2]
            s = keys @ x[i, 2 * h : 2 * h + 2] / np.sqrt(2)
            w = np.exp(s - s.max())
            assert np.allclose(got[i, h], (w[:, None] * keys).sum(0) / w.sum())


def tokens_of(spark, folder):
    return [x for r in npy_shards.read(spark, folder).orderBy("shard_index").collect() for x in r["tokens"]]


def test_npy_shards(spark, tmp_path):
    df = spark.createDataFrame([(0, [1, 2, 32767]), (1, [5])], "shard_index long, tokens array<int>")
    folder = str(tmp_path / "s")
    m = npy_shards.write(df, folder, 3, version="v1")
    assert m["total_tokens"] == 4 and m["total_shards"] == 2 and [r["filename"] for r in m["shards"]] == ["shard_00000.npy", "shard_00001.npy"]
    assert sorted((r[0], r[1]) for r in npy_shards.read(spark, folder).collect()) == [(0, [1, 2, 32767]), (1, [5])]
    first = np.load(tmp_path / "s" / "shard_00000.npy")
    assert first.dtype == np.uint16 and first.tolist() == [1, 2, 32767]
    with pytest.raises(FileExistsError):
        npy_shards.write(df, folder, 3, version="v1")
    bad = spark.createDataFrame([(0, [40000])], "shard_index long, tokens array<int>")
    with pytest.raises(Exception, match="out of range"):
        npy_shards.write(bad, str(tmp_path / "b"), 3, version="v1")
    with pytest.raises(ValueError, match="no tokens"):
        npy_shards.write(df.limit(0), str(tmp_path / "e"), 3)
    os.remove(tmp_path / "s" / "shard_00001.npy")
    with pytest.raises(ValueError, match="lists 2 shards, 1"):
        npy_shards.read(spark, folder)
    assert [(r["shard_index"], r["agrees"]) for r in npy_shards.reconcile(spark, folder).orderBy("shard_index").collect()] == [(0, True), (1, False)]
    assert npy_shards.rebuild_manifest(spark, folder, 3)["total_tokens"] == 3 and npy_shards.existing(spark, folder) == (1, 3)
    with pytest.raises(FileNotFoundError):
        npy_shards.read_manifest(spark, str(tmp_path / "none"))


def test_shards_by_budget_and_resume(spark, tmp_path):
    lists = [list(range(i, i + n)) for i, n in enumerate([3, 11, 1, 30, 7, 19])]
    flat = [x for y in lists for x in y]
    d = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>")
    folder = str(tmp_path / "s")
    assert npy_shards.write_documents(d, folder, 8, token_budget=21)["shards"][-1]["tokens"] == 5
    with pytest.raises(FileExistsError):
        npy_shards.write_documents(d, folder, 8)
    m = npy_shards.write_documents(d, folder, 8, resume=True)
    assert tokens_of(spark, folder) == flat and m["total_tokens"] == len(flat)
    assert [r["tokens"] for r in m["shards"]] == [8, 8, 5, 8, 8, 8, 8, 8, 8, 2] and npy_shards.manifest_table(spark, folder).first()["total_shards"] == 10


def test_large_pieces_are_read_in_parts(spark, tmp_path):
    folder = str(tmp_path / "s")
    npy_shards.write_pieces(npy_shards.synthetic(spark, 2, 5000), folder, 5000)
    whole = tokens_of(spark, folder)
    source = lambda tasks: spark.read.format("token_shards").option("read_tokens", 700).option("tasks", tasks).load(folder)
    for tasks in (1, 3, 50):
        rows = source(tasks).orderBy("shard_index", "low").collect()
        assert [x for r in rows for x in r["piece"]] == whole and max(len(r["piece"]) for r in rows) <= 700
    assert source(1).rdd.getNumPartitions() == 1 and source(50).rdd.getNumPartitions() >= 50
    one = source(50).filter("shard_index = 1")
    assert {r["shard_index"] for r in one.collect()} == {1}
    os.remove(f"{folder}/shard_00000.npy")  # a pruned read opens the other file alone
    assert [x for r in one.orderBy("low").collect() for x in r["piece"]] == whole[5000:] and source(2).filter("shard_index > 0 and shard_index in (1, 2)").count() == 8
    assert len(whole) == 10_000 and 15_000 < np.mean(whole) < 17_500


def test_failed_writes_leave_nothing(spark, tmp_path):
    folder = str(tmp_path / "s")
    good, bad = [1, 2, 3], [40_000]
    d = spark.createDataFrame([(i, 0, bad if i == 5 else good) for i in range(8)], "shard_index long, low long, piece array<int>")
    with pytest.raises(Exception, match="out of range"):
        npy_shards.write_pieces(d, folder, 3)
    assert not os.path.exists(folder) or os.listdir(folder) == []
    npy_shards.write_pieces(d.filter("shard_index < 5"), folder, 3)
    before = {x: (tmp_path / "s" / x).read_bytes() for x in os.listdir(folder)}
    with pytest.raises(Exception, match="out of range"):
        npy_shards.write_pieces(d.filter("shard_index >= 5"), folder, 3, resume=True)
    with pytest.raises(Exception, match="shard_00004"):  # one that is there is not replaced
        npy_shards.write_pieces(d.filter("shard_index in (4, 6)"), folder, 3, resume=True)
    assert {x: (tmp_path / "s" / x).read_bytes() for x in os.listdir(folder)} == before


def test_resume_demands_a_manifest_that_fits(spark, tmp_path):
    d = spark.createDataFrame([(i, list(range(i, i + 9))) for i in range(9)], "doc_id long, ids array<int>")
    flat = [x for i in range(9) for x in range(i, i + 9)]
    folder = str(tmp_path / "s")
    npy_shards.write_documents(d, folder, 20, token_budget=75)
    third = (tmp_path / "s" / "shard_00003.npy").read_bytes()
    os.remove(f"{folder}/shard_00001.npy")
    m = npy_shards.write_documents(d, folder, 20, resume=True)  # the missing shard comes again, the last stays
    assert [r["tokens"] for r in m["shards"]] == [20, 20, 20, 15, 6] and tokens_of(spark, folder) == flat and (tmp_path / "s" / "shard_00003.npy").read_bytes() == third
    np.save(f"{folder}/shard_00007.npy", np.arange(3, dtype=np.uint16))
    with pytest.raises(ValueError, match=r"does not list the shards \[7\]"):
        npy_shards.write_documents(d, folder, 20, resume=True)
    os.remove(f"{folder}/shard_00007.npy")
    np.save(f"{folder}/shard_00002.npy", np.arange(3, dtype=np.uint16))
    with pytest.raises(ValueError, match=r"shards \[2\] have other numbers"):
        npy_shards.write_documents(d, folder, 20, resume=True)
    os.remove(f"{folder}/metadata.json")
    with pytest.raises(ValueError, match="no manifest"):
        npy_shards.write_documents(d, folder, 20, resume=True)


def test_permutations():
    for n in (1, 2, 3, 10, 97, 1000, 65_537):
        for epoch in (0, 1, 5):
            p = permuted(np.arange(n), n, 11, epoch)
            assert sorted(p) == list(range(n)) and (permuted(p, n, 11, epoch, back=True) == np.arange(n)).all()
            assert (permuted(np.arange(n)[n // 2 :], n, 11, epoch) == p[n // 2 :]).all()
    orders = [permuted(np.arange(1000), 1000, s, e) for s in (1, 2) for e in (0, 1)]
    assert len({tuple(x) for x in orders}) == 4 and all(abs(np.corrcoef(x, np.arange(1000))[0, 1]) < 0.2 and (np.diff(x) == 1).sum() < 20 for x in orders)


def test_dataset_over_shards(spark, tmp_path):
    folder, r = str(tmp_path / "s"), random.Random(1)
    tokens = [[r.randrange(32768) for _ in range(n)] for n in (100, 37, 5, 80)]
    npy_shards.write(spark.createDataFrame(list(enumerate(tokens)), "shard_index long, tokens array<int>"), folder, 100)
    data = TokenDataset(spark, folder, 8, stride=4, val_shard=1, batch=4)
    wins = lambda s: [(s, w, tokens[s][4 * w : 4 * w + 8], tokens[s][4 * w + 1 : 4 * w + 9]) for w in range(max(0, (len(tokens[s]) - 9) // 4 + 1))]
    train = wins(0) + wins(2) + wins(3)
    got = lambda df: [tuple(x)[2:] for x in df.orderBy("step").collect()]
    assert len(data) == len(train) and data.metadata["total_tokens"] == 222 and got(data.windows()) == train
    assert got(data.windows("val")) == wins(1) and got(data.windows(steps=7, skip=len(train) - 3)) == train[-3:] + train[:4]
    order = [[train[i] for i in permuted(np.arange(len(train)), len(train), 5, e)] for e in (0, 1, 2)]
    assert got(data.windows(steps=3 * len(train), seed=5)) == order[0] + order[1] + order[2] and order[0] != order[1]
    both = data.train(5, skip_tokens=17, seed=5).orderBy("step").collect()
    assert [(x["batch_id"], x["slot"]) for x in both] == [(i // 4, i % 4) for i in range(20)] and [tuple(x)[2:6] for x in both] == order[0][2:22]
    cycle = data.validation(5).orderBy("step").collect()
    assert [tuple(x)[2:6] for x in cycle] == (wins(1) * 5)[:20]
    with pytest.raises(ValueError, match="no shard 9"):
        TokenDataset(spark, folder, 8, val_shard=9)
    with pytest.raises(FileNotFoundError):
        TokenDataset(spark, str(tmp_path / "none"), 8)
    steps, runs = 2 * len(train) + 3, {}
    for name, stops in (("one", [steps]), ("three", [5, len(train) + 1, steps])):
        for upto in stops:
            out = data.stream(upto, seed=5).writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-c")
            out.trigger(availableNow=True).start().awaitTermination()
        runs[name] = spark.read.parquet(f"{tmp_path}/{name}").orderBy("step").collect()
    assert runs["one"] == runs["three"] and [x["step"] for x in runs["one"]] == list(range(steps)) and [tuple(x)[2:] for x in runs["one"]] == (order[0] + order[1] + order[2])[:steps]


def test_streams_read_no_neighbours(spark, tmp_path):
    one = lambda i: spark.createDataFrame([(i, f"text {i}")], "doc_id long, text string").coalesce(1)
    for name, i in (("documents.parquet", 1), ("documents.parquet.old", 99), ("documents.parqueta", 98)):
        one(i).write.parquet(str(tmp_path / name))
    part = next(p for p in (tmp_path / "documents.parquet").iterdir() if p.name.endswith(".parquet"))
    (tmp_path / "single.parquet").write_bytes(part.read_bytes())
    (tmp_path / "single.parquet2").write_bytes(part.read_bytes())
    for name, ids in (("documents.parquet", [1]), ("documents.parquet/", [1]), ("single.parquet", [1])):
        assert [r["doc_id"] for r in streaming.encode_stream(spark, f"{tmp_path}/{name}", MERGES, f"{tmp_path}/out-{name.strip('/').replace('/', '-')}{len(name)}").collect()] == ids


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    d = docs(spark, ["hello world", "the then", "aaa", "x " * 40, "end", "more"]).coalesce(1)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    d.filter("doc_id < 2").write.parquet(src)
    first = streaming.encode_stream(spark, src, MERGES, out + "1").count()
    parts = streaming.shard_stream(spark, src, MERGES, 7, out + "2", files_per_trigger=1)
    assert first == 2
    for i in range(2, 6):
        d.filter(f"doc_id = {i}").write.mode("append").parquet(src)
        if i in (3, 5):
            parts = streaming.shard_stream(spark, src, MERGES, 7, out + "2", files_per_trigger=1)
    assert streaming.encode_stream(spark, src, MERGES, out + "1").count() == 6
    got = [r["tokens"] for r in shards.assembled(parts).orderBy("shard_index").collect()]
    flat = [x for y in got for x in y]
    one = {r["doc_id"]: r["ids"] for r in bpe.encode_documents(d, MERGES).collect()}
    assert all(len(x) == 7 for x in got[:-1]) and len(flat) == sum(map(len, one.values()))
    assert flat[: len(one[0]) + len(one[1])] == one[0] + one[1]


def test_budget_ends_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    for i in range(6):
        docs(spark, ["x" * 10]).select((F.col("doc_id") + i).alias("doc_id"), "text").coalesce(1).write.mode("append").parquet(src)
    got = streaming.budget_stream(spark, src, 25, 0, str(tmp_path / "out"), files_per_trigger=1).orderBy("chars_before").collect()
    assert [(r["char_count"], r["chars_before"]) for r in got] == [(10, 0), (10, 10), (10, 20)]
    assert len([x for x in os.listdir(tmp_path / "out" / "rows") if x.startswith("batch=")]) == 3


def test_text_corpora(spark, tmp_path):
    d = docs(spark, ["one\ntwo", "  three ", "<|x|>"])
    corpus_text.dump(d, str(tmp_path / "t"))
    assert sorted(r["text"] for r in corpus_text.read_delimited(spark, str(tmp_path / "t")).collect()) == ["  three ", "<|x|>", "one\ntwo"]
    (tmp_path / "raw.txt").write_bytes(b"a<|endoftext|>b\nc")
    assert sorted(r["text"] for r in corpus_text.read_delimited(spark, str(tmp_path / "raw.txt"), "<|endoftext|>").collect()) == ["a", "b\nc"]
    (tmp_path / "bad.txt").write_bytes(b"a\xff<|endoftext|>b")
    with pytest.raises(Exception, match="not valid UTF-8"):
        corpus_text.read_delimited(spark, str(tmp_path / "bad.txt"), "<|endoftext|>").collect()
    with pytest.raises(Exception, match="no text"):
        corpus_text.dump(docs(spark, [None]), str(tmp_path / "n"))
    with pytest.raises(Exception, match="no text at 0"):
        documents.texts(docs(spark, [None]), strict=True).collect()


def test_logs(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1.0, None), (1, float("nan"), 2.0), (2, float("inf"), None), (3, None, 4.0)], "step long, loss double, val_loss double")
    training_log.append(rows, str(tmp_path / "log"))
    training_log.append(spark.createDataFrame([("nan", 1)], "event string, step long"), str(tmp_path / "log"))
    log = training_log.read(spark, str(tmp_path / "log"))
    assert sorted(r["step"] for r in training_log.broken(log).collect()) == [1, 2, 3]
    assert sorted(map(tuple, training_log.evaluations(log).collect())) == [(1, 2.0), (3, 4.0)]
    assert training_log.mean_of_first(training_log.evaluations(log), "val_loss", "step", 1).first()[0] == 2.0
    assert training_log.mean_of_first(rows.limit(0), "val_loss", "step", 1).first()[0] == 0.0


def test_configs(spark):
    got = sorted(map(tuple, configs.models(spark, kernels.PRESET_SCHEMA).collect()))
    assert got == sorted(kernels.PRESETS)
    t = configs.load_training("25m")
    assert t["optim"]["lr_peak"] == 3e-4 and t["train"]["total_steps"] == 9766 and configs.load_model(t["model_name"])["n_layers"] == 4
    with pytest.raises(KeyError):
        configs.load_model("none")
    assert configs.parse("a: 1  # one\n\nb:\n  c: x y\n  d: true\ne: null") == {"a": 1, "b": {"c": "x y", "d": True}, "e": None}


def test_artifact_variants(spark, tmp_path):
    bpe.save(MERGES, str(tmp_path), lossy=True)
    vocab = json.loads((tmp_path / "vocab.json").read_text())
    assert vocab["\ufffd"] and len(vocab) < 261 + len(MERGES) and (tmp_path / "merges.txt").read_text().splitlines()[4] == "{} {}".format(*MERGES[0])
    good = json.loads((tmp_path / "tokenizer.json").read_text())
    for change, match in (({"vocab_size": 999}, "vocab_size"), ({"merges": [[300, 5]], "vocab_size": 262}, "later id"), ({"version": "9.9"}, "version")):
        (tmp_path / "x.json").write_text(json.dumps(good | change))
        with pytest.raises(ValueError, match=match):
            bpe.load(str(tmp_path / "x.json"))
    (tmp_path / "x.json").write_text(json.dumps({k: v for k, v in good.items() if k != "merges"}))
    with pytest.raises(ValueError, match="merges"):
        bpe.load(str(tmp_path / "x.json"))


def test_sql_functions(spark):
    bpe.register(spark, MERGES)
    docs(spark).createOrReplaceTempView("texts")
    for r in spark.sql("select text, pretokenize(text) as p, bpe_decode(bpe_encode(text)) as back from texts").collect():
        assert "".join(r["p"]) == (r["text"] or "") == r["back"]
    t = bpe.Tokenizer(MERGES)
    docs(spark, [*TEXTS, "a<|eos|> <|bos|>"]).createOrReplaceTempView("texts")
    assert all(r["ids"] == t.encode(r["text"] or "") for r in spark.sql("select text, bpe_encode(text) as ids from texts").collect())
    got = spark.sql("select bpe_decode(x) as t from values (array(5 + 255, 5 + 65)), (cast(null as array<int>)), (array(99999, 70)) v(x)").collect()
    assert [r["t"] for r in got] == ["\ufffdA", None, "?A"]


def test_commands(spark, tmp_path, capsys):
    from sparkloom import cli

    docs(spark, ["the then there " * 20, None, "hello world " * 30, "short"]).write.parquet(str(tmp_path / "d"))
    run = lambda *a: cli.main([a[0], *([] if a[0] == "params" else ["--documents", str(tmp_path / "d"), "--output-dir", str(tmp_path / a[0])]), *a[1:]], spark)
    run("train", "--vocab-size", "270")
    run("shards", "--tokenizer", str(tmp_path / "train" / "tokenizer.json"), "--shard-size", "1e2", "--token-budget", "250")
    assert npy_shards.read_manifest(spark, str(tmp_path / "shards"))["total_tokens"] == 250
    run("shards", "--tokenizer", str(tmp_path / "train" / "tokenizer.json"), "--shard-size", "100", "--skip-existing")
    whole = bpe.Tokenizer(bpe.load(str(tmp_path / "train" / "tokenizer.json")))
    assert tokens_of(spark, str(tmp_path / "shards")) == [0, *whole.encode("the then there " * 20), 0, *whole.encode("hello world " * 30)]
    run("dump")
    assert corpus_text.read_delimited(spark, str(tmp_path / "dump")).count() == 2
    run("params")
    assert "tok_emb" in capsys.readouterr().out


TINY = {"n_layers": 2, "d_model": 16, "n_heads": 4, "n_kv_heads": 2, "d_ff": 32, "vocab_size": 300, "theta_base": 10000.0}


def test_forward_pass(spark):
    params = model.init(TINY, 3)
    ids = np.random.default_rng(1).integers(0, 300, (3, 12))
    logits = model.forward(params, TINY, ids)
    assert logits.shape == (3, 12, 300) and abs(model.losses(logits, (ids + 1) % 300).mean() - np.log(300)) < 0.1
    later = ids.copy()
    later[:, 7:] = 5
    assert np.allclose(model.forward(params, TINY, later)[:, :7], logits[:, :7]) and not np.allclose(model.forward(params, TINY, later)[:, 7:], logits[:, 7:])
    assert np.allclose(model.forward(params, TINY, ids[1:2]), logits[1:2])
    # one head and layer written out, place by place
    small = TINY | {"n_layers": 1, "n_heads": 1, "n_kv_heads": 1}
    p = {k: v.astype(float) for k, v in model.init(small, 4, 0.5).items()}
    x = p["tok_emb/embedding"][ids[0]]
    rms = lambda v: v / np.sqrt((v * v).mean() + 1e-6)

    def turned(v, t):
        out = v.copy()
        for i in range(0, 16, 2):
            a = t / 10000 ** (i / 16)
            out[i], out[i + 1] = v[i] * np.cos(a) - v[i + 1] * np.sin(a), v[i] * np.sin(a) + v[i + 1] * np.cos(a)
        return out

    want = []
    for t in range(12):
        q = turned(rms(x[t]) @ p["block_0/attn/wq"], t)
        s = np.array([q @ turned(rms(x[u]) @ p["block_0/attn/wk"], u) / 4 for u in range(t + 1)])
        w = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        y = x[t] + sum(w[u] * (rms(x[u]) @ p["block_0/attn/wv"]) for u in range(t + 1)) @ p["block_0/attn/wo"]
        g = rms(y) @ p["block_0/mlp/w_gate"]
        y = y + (g / (1 + np.exp(-g)) * (rms(y) @ p["block_0/mlp/w_up"])) @ p["block_0/mlp/w_down"]
        want.append(rms(y) @ p["tok_emb/embedding"].T)
    assert np.allclose(model.forward(p, small, ids[:1])[0], want)
    rows = [(0, i, [int(v) for v in r[:-1]], [int(v) for v in r[1:]]) for i, r in enumerate(ids)]
    got = model.evaluate(spark.createDataFrame(rows, "shard_index long, win_index int, input array<int>, target array<int>"), params, TINY, batch=2).orderBy("win_index").collect()
    assert np.allclose([r["loss"] for r in got], model.losses(model.forward(params, TINY, ids[:, :-1]), ids[:, 1:]))
    sizes = kernels.parameters(spark.createDataFrame([("t", 0, 2, 16, 4, 2, 32, 300, 8, 1e4)], kernels.PRESET_SCHEMA)).collect()
    assert {f"{r['module']}/{r['leaf']}": r["rows"] * r["cols"] for r in sizes} == {k: v.size for k, v in params.items()}



def test_attention_looks_at_no_later_blocks(monkeypatch):
    """Numbers that go to exp(), which is most of the time: fewer than all pairs of places. Losses are those of the logits, small or large."""
    ids = np.random.default_rng(5).integers(0, 300, (3, 129))
    params, taken, exp = model.init(TINY, 3), [], np.exp
    monkeypatch.setattr(model.np, "exp", lambda x, *a, **k: (taken.append(np.size(x)), exp(x, *a, **k))[1])
    logits = model.forward(params, TINY, ids[:, :-1])
    pairs, gates = 2 * 3 * 4 * 128 * 128, 2 * 3 * 128 * 32
    assert sum(taken) - gates < 0.65 * pairs
    for scale in (1, 40, 4000):
        p = {k: v.astype(float) * (scale if k == "tok_emb/embedding" or "wq" in k or "wk" in k else 1) for k, v in params.items()}
        logits = model.forward(p, TINY, ids[:, :-1])
        want = model.losses(logits, ids[:, 1:])
        assert np.isfinite(want).all() and np.allclose(model.window_losses(p, TINY, ids[:, :-1], ids[:, 1:]), want, rtol=1e-12)
        monkeypatch.setattr(model, "SAFE", 0.0)
        assert np.allclose(model.forward(p, TINY, ids[:, :-1]), logits, rtol=1e-9) and np.allclose(model.window_losses(p, TINY, ids[:, :-1], ids[:, 1:]), want, rtol=1e-12)
        monkeypatch.setattr(model, "SAFE", 300.0)


def test_tensor_files(spark, tmp_path, monkeypatch):
    params = model.init(TINY, 3) | {"steps": np.array([7], np.int64), "half": np.arange(6, dtype=np.float16).reshape(2, 3)}
    safetensors.export(params, {"vocab_size": 300}, str(tmp_path))
    path = str(tmp_path / "model.safetensors")
    back = safetensors.load(path)
    assert back.keys() == params.keys() and all(np.array_equal(back[k], v) and back[k].dtype == v.dtype for k, v in params.items())
    shapes = {r["name"]: (tuple(r["shape"]), r["size"]) for r in safetensors.scan(spark, path).collect()}
    assert shapes == {k: (v.shape, v.size) for k, v in params.items()}
    monkeypatch.setattr(safetensors, "PART", 100)
    parts = {}
    for r in safetensors.read(spark, path).orderBy("name", "low").collect():
        parts.setdefault(r["name"], []).extend(r["part"])
    assert all(np.allclose(parts[k], v.ravel()) for k, v in params.items())
    assert json.loads((tmp_path / "config.json").read_text()) == {"vocab_size": 300}
    with pytest.raises(FileNotFoundError):
        safetensors.scan(spark, str(tmp_path / "none.safetensors"))


def test_checkpoints(spark, tmp_path):
    folder = str(tmp_path / "ckpt")
    with pytest.raises(FileNotFoundError):
        checkpoints.restore(spark, folder)
    for step in (5, 12):
        checkpoints.save(spark.createDataFrame([(step, 0.5)], "a long, b double"), folder, step)
    checkpoints.save(spark.createDataFrame([(1,)], "a long"), folder, 13, "emergency")
    os.makedirs(f"{folder}/step_0000000099")  # never finished
    assert checkpoints.steps(spark, folder) == [5, 12]
    step, state = checkpoints.restore(spark, folder)
    assert step == 12 and state.columns == ["a", "b"] and state.first()["a"] == 12 and checkpoints.restore(spark, folder, 5)[1].first()["a"] == 5
    with pytest.raises(Exception):
        checkpoints.save(state, folder, 12)
    with pytest.raises(FileNotFoundError):
        checkpoints.restore(spark, folder, 99)
