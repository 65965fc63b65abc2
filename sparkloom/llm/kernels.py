"""Word hashing over Arrow's UTF-8 buffers with numpy: no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes hashed at a time; bounds the 8-byte temporaries.
PIECE = 1 << 21

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**64, 256, dtype=U)
_LANES = _rng.integers(0, 2**64, 64, dtype=U) | U(1)
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE, 1 << (n - 1).bit_length()) + 1
    if size not in _tables:
        _tables.clear()
        _tables[size] = _powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)
    return _tables[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def ascii_lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def not_space_table() -> np.ndarray:
    """True for bytes of the words [^\\x20\\x09-\\x0D]+."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def alnum_table() -> np.ndarray:
    """True for bytes of the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z became a-z: digits, a-z and all of non-ASCII."""
    t = np.ones(256, bool)
    t[0:0x30] = t[0x3A:0x61] = t[0x7B:0x80] = False
    return t


def text_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than there are texts) of a string array; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string()).fill_null("")
    n, start = len(array), array.offset
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[start : start + n + 1] if offsets is not None and n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(inside: np.ndarray, edge: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces that end between words."""
    at, n = 0, len(inside)
    while at < n:
        end = min(n, at + PIECE)
        if end < n:
            back = np.flatnonzero(~inside[at:end] | edge[at:end])
            if len(back) and back[-1] > 0:
                end = at + int(back[-1])
            else:
                ahead = np.flatnonzero(~inside[end:] | edge[end:n])
                end = end + int(ahead[0]) if len(ahead) else n
        yield at, end
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, all texts after one another, and word offsets of the texts (one more than texts).

    A word's bytes b0 b1 ... give sum(random[bi] * base**i) modulo 2**64, plus its length, through a finaliser."""
    n_texts = len(offsets) - 1
    if not len(data):
        return np.zeros(0, U), np.zeros(n_texts + 1, np.int64)
    if lower:
        data = ascii_lower_table()[data]
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    hashes, starts = [], []
    for a, b in _cuts(inside, edge):
        here = inside[a:b]
        first = here.copy()
        first[1:] &= ~here[:-1] | edge[a + 1 : b]
        last = here.copy()
        last[:-1] &= ~here[1:] | edge[a + 1 : b]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(s):
            continue
        up, down = _power_tables(b - a)
        sums = np.zeros(b - a + 1, U)
        np.cumsum(_BYTE[data[a:b]] * up[: b - a], out=sums[1:])
        h = (sums[e] - sums[s]) * down[s] + (e - s).astype(U) * _LANES[63]
        hashes.append(mix(h))
        starts.append(s + a)
    if not hashes:
        return np.zeros(0, U), np.zeros(n_texts + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets).astype(np.int64)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each position; the caller leaves out those that cross texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, k * 0xD6E8FEB86659FD93 % 2**64, U)
    for j in range(k):
        out += hashes[j : j + n] * U(int(_LANES[j % 62]) * (2 * (j // 62) + 1) % 2**64)
    return mix(out)


def gram_positions(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of the k-grams that stay in a text, and their offsets by text."""
    counts = np.maximum(np.diff(offsets) - k + 1, 0)
    by_text = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return np.repeat(offsets[:-1] - by_text[:-1], counts) + np.arange(by_text[-1]), by_text


def batches(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes; a longer text is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = end


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
