"""Merges learned on the cluster against the loop on the driver."""

import random

import pytest

from sparkloom.operators import bpe, learning


def _words(seed: int) -> dict[str, int]:
    rng = random.Random(seed)
    return {"".join(rng.choice("abcé") for _ in range(rng.choice([1, 2, 3, 5, 9, 80]))): rng.randint(1, 9) for _ in range(40)}


@pytest.mark.parametrize("kw", [{}, {"step": 3, "head": 5}])
def test_same_merges_as_on_the_driver(spark, kw):
    words = _words(1)
    freq = spark.createDataFrame(list(words.items()), "word string, freq bigint")
    assert learning.learn(freq, 24, 1, **kw) == bpe.learn_merges(words.items(), 24, 1)


def test_runs_of_one_letter_no_words_and_too_few(spark):
    def both(rows, n, least):
        freq = spark.createDataFrame(rows, "word string, freq bigint")
        return learning.learn(freq, n, least), bpe.learn_merges(rows, n, least)

    for rows, n, least in (([("a" * 11, 3), ("aaa", 2), ("aab", 2)], 9, 1), ([("a", 5)], 4, 1), ([("ab", 1)], 4, 2)):
        got, want = both(rows, n, least)
        assert got == want
    assert learning.learn(spark.createDataFrame([], "word string, freq bigint"), 4) == []


def test_independent_merges_are_the_next_ones():
    """Many small tables of words: what independent() takes at once is what one at a time takes."""
    several = 0
    for seed in range(300):
        rng = random.Random(seed)
        words = {"".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))): rng.randint(1, 40) for _ in range(rng.randint(1, 12))}
        counts: dict[tuple[int, int], int] = {}
        for w, n in words.items():
            for a, b in zip(w.encode(), w.encode()[1:], strict=False):
                p = (a + bpe.BYTE_OFFSET, b + bpe.BYTE_OFFSET)
                counts[p] = counts.get(p, 0) + n
        order = sorted(((n, *p) for p, n in counts.items()), reverse=True)
        for known in (len(order), max(1, len(order) // 2)):
            head = {(a, b): n for n, a, b in order[:known]}
            taken = learning.independent(head, (0, 0, 0) if known == len(order) else order[known - 1], 8, 1)
            assert taken and taken == bpe.learn_merges(words.items(), len(taken), 1)
            several += len(taken) > 1
    assert several > 50
