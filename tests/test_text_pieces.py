"""Pieces of long texts against whole texts: separators, specials and white space at every cut."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.functions.merges import MERGES
from sparkloom.operators import bpe, shards
from sparkloom.sources import corpus_text, text_pieces

SEPARATOR = "\n<|endoftext|>\n"
PARTS = ["a", "it's", " ", "  ", "\n", "\n\n ", "\u3000", "word", "x.y", "'ll", "。", "漢字", "é", "<|eos|>", "<|endoftext|>", "\n<|endoftext|>", SEPARATOR, "_", "1", "!", "\U0001f600"]


def whole(text: str) -> list[str]:
    out = text.split(SEPARATOR)
    return out[:-1] if not out[-1] else out


def put_together(rows) -> list[str]:
    out = []
    for _, _, begins, text in sorted(rows):
        out += [text] if begins else []
        out[-1] += "" if begins else text
    return out


def read_by_hand(path: str, task: int, piece: int) -> list[tuple]:
    reader = text_pieces.PieceReader({"path": path, "task_bytes": task, "piece_bytes": piece})
    return [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40), st.integers(1, 30), st.integers(1, 30))
def test_any_cut_gives_the_same_documents_and_ids(tmp_path_factory, parts, task, piece):
    text = "".join(parts)
    path = str(tmp_path_factory.mktemp("cut") / "t.txt")
    with open(path, "wb") as f:
        f.write(text.encode())
    rows = read_by_hand(path, task, piece)
    assert put_together(rows) == whole(text)
    encode = bpe.Tokenizer(MERGES).encode
    got = []
    for _, _, begins, part in sorted(rows):
        got += [0] if begins else []
        got += encode(part)
    assert got == [i for d in whole(text) for i in [0, *encode(d)]]


def test_pieces_are_small_and_laid_out_as_documents(spark, tmp_path):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["lorem", " ", "ipsum,", "\n", "dolor's", "  ", "7"]) for _ in range(rng.choice([0, 3, 4000]))) for _ in range(40)]
    path = tmp_path / "corpus"
    path.mkdir()
    (path / "part-0.txt").write_text("".join(t + SEPARATOR for t in texts))
    (path / "_SUCCESS").write_text("")
    (path / "empty.txt").write_text("")
    pieces = text_pieces.read_pieces(spark, str(path), task_bytes=20_000, piece_bytes=1000)
    rows = [tuple(r) for r in pieces.collect()]
    assert put_together(rows) == texts
    assert max(len(r[3]) for r in rows) < 1100 and pieces.rdd.getNumPartitions() > 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = shards.layout(bpe.encode_documents(docs, MERGES), 5000)
    got = shards.layout(text_pieces.encode_pieces(pieces, MERGES), 5000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_text_of_many_megabytes_is_encoded_by_several_tasks(spark, tmp_path):
    text = "the quick brown fox doesn't jump,  over it\n" * 150_000  # one document of 6 MB
    (tmp_path / "one.txt").write_text(text)
    pieces = text_pieces.read_pieces(spark, str(tmp_path / "one.txt"), task_bytes=1 << 20, piece_bytes=1 << 18)
    assert pieces.rdd.getNumPartitions() == 7
    (row,) = text_pieces.document_sums(text_pieces.encode_pieces(pieces, MERGES)).collect()
    ids = [0, *bpe.Tokenizer(MERGES).encode(text)]
    assert (row.document, row.tokens, row.checksum) == (0, len(ids), sum(k * i for k, i in enumerate(ids, 1)))


def test_broken_bytes_fail_and_other_separators_work(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"good \xff bad")
    with pytest.raises(Exception, match="(?i)utf-8"):
        text_pieces.read_pieces(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "lines.txt").write_bytes("one two\n\nthree".encode())
    rows = [tuple(r)[1:] for r in text_pieces.read_pieces(spark, str(tmp_path / "lines.txt"), separator="\n", task_bytes=2, piece_bytes=2).collect()]
    assert [r for r in sorted(rows) if r[1]] == [(0, True, "one"), (8, True, ""), (9, True, "three")]
    with pytest.raises(Exception, match="separator"):
        text_pieces.read_pieces(spark, str(tmp_path / "lines.txt"), separator="").collect()


def test_the_dump_of_documents_comes_back(spark, tmp_path):
    docs = spark.createDataFrame([("one two",), ("",), ("  three\n",)], "text string").coalesce(1)
    folder = os.path.join(tmp_path, "dump")
    corpus_text.dump(docs, folder)
    rows = [tuple(r) for r in text_pieces.read_pieces(spark, folder, task_bytes=3, piece_bytes=3).collect()]
    assert sorted(put_together(rows)) == sorted(r.text for r in corpus_text.read_delimited(spark, folder).collect()) == ["", "  three\n", "one two"]
