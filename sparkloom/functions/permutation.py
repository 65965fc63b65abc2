"""Seeded permutations of 0 to n - 1 that give each place by itself, forth and back, without a sort or a table.

A place is split into two digits; each round adds a number made of one digit, the seed, the epoch and the round to the other (a Feistel network over digits a and b).
That permutes 0 to a * b - 1, a little more than n; what falls beyond n walks on until it is inside."""

from __future__ import annotations

import math

import numpy as np

PRIME, ROUNDS = 2_147_483_647, 6


def digits(n: int) -> tuple[int, int]:
    """a and b with a * b >= n, the root of n and what it needs beside."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def round_key(seed: int, epoch: int, t: int) -> int:
    return (seed * 69_621 + epoch * 40_692 + t * 52_774 + 1) % PRIME


def _added(x: np.ndarray, key: int) -> np.ndarray:
    x = (x * 48_271 + key) % PRIME
    return x * x % PRIME


def permuted(places: np.ndarray, n: int, seed: int, epoch: int = 0, back: bool = False) -> np.ndarray:
    """Where each of the places 0 to n - 1 goes in the epoch's order; with `back`, where it came from."""
    a, b = digits(n)
    if b >= 1 << 40:
        raise ValueError("too many places")
    x = np.array(places, np.int64)
    left = np.arange(len(x))
    while len(left):
        high, low = x[left] // b, x[left] % b
        for t in reversed(range(ROUNDS)) if back else range(ROUNDS):
            key, sign = round_key(seed, epoch, t), -1 if back else 1
            if t % 2:
                low = (low + sign * _added(high, key)) % b
            else:
                high = (high + sign * _added(low, key)) % a
        x[left] = high * b + low
        left = left[x[left] >= n]
    return x


def permuted_sql(rows: str, n: str, seed: int) -> str:
    """The same in DuckDB: rows has epoch and place; the result adds item, where the place goes."""
    size = f"(select {n} as n, ceil(sqrt({n}))::bigint as a, ({n} + ceil(sqrt({n}))::bigint - 1) // ceil(sqrt({n}))::bigint as b)"

    def once(source: str) -> str:
        q = f"select epoch, place, n, a, b, x // b as hi, x % b as lo from {source}"
        for t in range(ROUNDS):
            to, by, over = ("lo", "hi", "b") if t % 2 else ("hi", "lo", "a")
            key = f"(({seed} * 69621 + epoch * 40692 + {t} * 52774 + 1) % {PRIME})"
            v = f"(({by} * 48271 + {key}) % {PRIME})"
            q = f"select * replace (({to} + ({v} * {v}) % {PRIME}) % {over} as {to}) from ({q})"
        return f"select epoch, place, n, a, b, hi * b + lo as x from ({q})"

    start = f"(select epoch::bigint as epoch, place::bigint as place, n, a, b, place::bigint as x from ({rows}), {size})"
    return f"(with recursive walk(epoch, place, n, a, b, x) as ({once(start)} union all {once('walk where x >= n')}) select epoch, place, x as item from walk where x < n)"
