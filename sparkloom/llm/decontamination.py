"""Benchmark decontamination by winnowing.

Each text's words are hashed; of every `window - k + 1` neighbouring k-gram hashes the least (the rightmost of
equals) is a fingerprint. A span of `window` words shared by a document and an item holds one such neighbourhood, so
both choose the same fingerprint in it: every shared span of at least `window` words is found. Hits are extended: the
windows around a hit are compared, and those that occur in the benchmark mark their words.

Items of fewer than `window` words, but not none, have one window, of their own length. Winnowing gives no guarantee
for these, so the documents' n-grams of each such length (at most `window` - 1 lengths) are compared in full.

Null texts, and texts without a word, have no words, hits or items. Items with a null id or text are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

WINDOW, GRAM = 10, 5
#: A benchmark of at most so many windows is sent to every task (16 bytes each, and its item lists); a larger one is joined.
BROADCAST_WINDOWS = 2_000_000
RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return K.word_hashes(*K.text_buffers(texts), K.alnum_table())


def fingerprints(hashes: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in all words) of the chosen k-grams, each once, ascending, and their hashes."""
    g = K.grams(hashes, k)
    at, by_text = K.gram_positions(offsets, k)
    span = window - k + 1
    first, _ = K.gram_positions(by_text, span)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, K.U)
    own = g[at]
    best, where = own[first].copy(), first.copy()
    for j in range(1, span):
        now = own[first + j]
        less = now <= best
        best[less] = now[less]
        where[less] = first[less] + j
    where = np.unique(where)
    return at[where], own[where]


def _found(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x in sorted_keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(x), -1)
    i = np.searchsorted(sorted_keys, x)
    i[i == len(sorted_keys)] = 0
    return np.where(sorted_keys[i] == x, i, -1)


def _around(hits: np.ndarray, offsets: np.ndarray, window: int, k: int) -> np.ndarray:
    """Starts of the windows that hold the k-gram at a hit and stay in its text."""
    text = np.searchsorted(offsets, hits, "right") - 1
    starts = (hits[:, None] - np.arange(window - k + 1)[None, :]).ravel()
    text = np.repeat(text, window - k + 1)
    return np.unique(starts[(starts >= offsets[text]) & (starts + window <= offsets[text + 1])])


def _covered(starts: np.ndarray, lengths: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each text in at least one of the spans."""
    delta = np.zeros(int(offsets[-1]) + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(delta[:-1]) > 0)])
    return hit[offsets[1:]] - hit[offsets[:-1]]


def _digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """Rows (kind, hash, item_id): the items' windows by length (kind is the length), and fingerprints (kind 0)."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column("item_id").to_numpy(zero_copy_only=False)
            hashes, offsets = _hashed(part.column("text"))
            kinds, keys, items = [], [], []
            full, _ = K.gram_positions(offsets, window)
            text = np.searchsorted(offsets, full, "right") - 1
            pos, prints = fingerprints(hashes, offsets, window, k)
            for kind, key, of in ((window, K.grams(hashes, window)[full], text), (0, prints, np.searchsorted(offsets, pos, "right") - 1)):
                kinds.append(np.full(len(key), kind, np.int32))
                keys.append(key)
                items.append(ids[of])
            size = np.diff(offsets)
            for n in range(1, window):
                short = np.flatnonzero(size == n)
                kinds.append(np.full(len(short), n, np.int32))
                keys.append(K.grams(hashes, n)[offsets[short]] if len(short) else np.zeros(0, K.U))
                items.append(ids[short])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(items).astype(np.int64))], ["kind", "hash", "item_id"])

    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    named = named.filter("item_id is not null and text is not null")
    return named.mapInArrow(rows, "kind int, hash bigint, item_id bigint").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = GRAM, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per document: doc_id (of any type), n_words, n_hit, n_items, items_sha256, contaminated. See the module's text.

    A benchmark of up to `broadcast_windows` windows goes to the tasks whole, and documents take one pass without a
    shuffle; beyond that fingerprints of documents and benchmark are joined, with the same rows as result."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = benchmark_windows(benchmark, window, k)
    if rows.limit(broadcast_windows + 1).count() <= broadcast_windows:
        return _by_broadcast(docs, rows, window, k)
    return _by_join(docs, rows, window, k)


def _by_broadcast(docs: DataFrame, rows: DataFrame, window: int, k: int) -> DataFrame:
    table = rows.toArrow()  # at most broadcast_windows rows
    kind, key, item = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("kind", "hash", "item_id"))
    lookups = {}
    for n in np.unique(kind):
        pick = np.flatnonzero(kind == n)
        pick = pick[np.lexsort((item[pick], key[pick].view(K.U)))]
        keys, first = np.unique(key[pick].view(K.U), return_index=True)
        lookups[int(n)] = (keys, np.append(first, len(pick)), item[pick])
    shared = docs.sparkSession.sparkContext.broadcast(lookups)

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in parts:
            data, offsets = K.text_buffers(part.column("text"))
            for a, b in K.batches(data, offsets, 4 << 20):
                hashes, words = K.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], K.alnum_table())
                starts, lengths, found = [], [], []
                for n, (keys, first, items) in known.items():
                    if n == 0:
                        continue
                    if n == window:
                        pos, prints = fingerprints(hashes, words, window, k)
                        at = _around(pos[_found(known[0][0], prints) >= 0], words, window, k) if 0 in known else pos[:0]
                        own = K.grams(hashes, n)[at] if len(at) else np.zeros(0, K.U)
                    else:
                        at, _ = K.gram_positions(words, n)
                        own = K.grams(hashes, n)[at] if len(at) else np.zeros(0, K.U)
                    i = _found(keys, own)
                    at, i = at[i >= 0], i[i >= 0]
                    starts.append(at)
                    lengths.append(np.full(len(at), n))
                    text = np.searchsorted(words, at, "right") - 1
                    pairs = np.unique(np.stack([text, i], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
                    found += [(int(t), items[first[j] : first[j + 1]]) for t, j in pairs]
                none = np.zeros(0, np.int64)
                n_hit = _covered(np.concatenate([none, *starts]), np.concatenate([none, *lengths]), words)
                by_text: dict[int, set[int]] = {}
                for t, of in found:
                    by_text.setdefault(t, set()).update(of.tolist())
                empty = _digest([])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").slice(a, b - a),
                        pa.array(np.diff(words)),
                        pa.array(n_hit.astype(np.int64)),
                        pa.array([len(by_text.get(t, ())) for t in range(b - a)], pa.int64()),
                        pa.array([_digest(list(by_text[t])) if t in by_text else empty for t in range(b - a)], pa.string()),
                        pa.array(n_hit > 0),
                    ],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    return docs.mapInArrow(scan, f"doc_id {dict(docs.dtypes)['doc_id']}, {RESULT}")


def _by_join(docs: DataFrame, rows: DataFrame, window: int, k: int) -> DataFrame:
    """The same result where the benchmark is too large to send whole: fingerprints are joined, then windows."""
    from .common import stored

    rows = stored(rows, "decontamination-windows")
    lengths = sorted(r[0] for r in rows.filter(f"kind > 0 and kind < {window}").select("kind").distinct().collect())  # below `window` values

    def prints(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per candidate (kind, hash) the windows it stands for: their starts and hashes. A row for a text's size comes first."""
        for part in parts:
            data, offsets = K.text_buffers(part.column("text"))
            rowids = part.column("row").to_numpy(zero_copy_only=False)
            for a, b in K.batches(data, offsets, 2 << 20):
                hashes, words = K.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], K.alnum_table())
                pos, own = fingerprints(hashes, words, window, k)
                kinds, keys, at = [np.zeros(len(pos), np.int32)], [own], [pos]
                for n in lengths:
                    p, _ = K.gram_positions(words, n)
                    kinds.append(np.full(len(p), n, np.int32))
                    keys.append(K.grams(hashes, n)[p] if len(p) else np.zeros(0, K.U))
                    at.append(p)
                kinds, keys, at = np.concatenate(kinds), np.concatenate(keys), np.concatenate(at)
                text = np.searchsorted(words, at, "right") - 1
                full = K.grams(hashes, window)
                low = np.where(kinds == 0, np.maximum(words[text], at - (window - k)), at)
                high = np.where(kinds == 0, np.minimum(words[text + 1] - window, at), at)
                count = np.maximum(high - low + 1, 0)
                ends = np.concatenate([[0], np.cumsum(count)])
                starts = np.repeat(low - ends[:-1], count) + np.arange(ends[-1])
                of = np.repeat(np.arange(len(at)), count)
                value = np.repeat(keys, count)
                wide = kinds[of] == 0
                value[wide] = full[starts[wide]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rowids[a + text]), pa.array(kinds), pa.array(keys.view(np.int64)), K.list_array((starts - words[text[of]]).astype(np.int64), ends, pa.int64()), K.list_array(value.view(np.int64), ends, pa.int64())],
                    ["row", "kind", "hash", "starts", "windows"],
                )

    def sizes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            _, words = _hashed(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(np.diff(words))], ["row", "doc_id", "n_words"])

    numbered = stored(docs.withColumn("row", F.monotonically_increasing_id()), "decontamination-docs")
    cand = numbered.mapInArrow(prints, "row bigint, kind int, hash bigint, starts array<bigint>, windows array<bigint>")
    met = cand.join(rows.select("kind", "hash").distinct(), ["kind", "hash"], "left_semi")
    spans = met.select("row", F.when(F.col("kind") == 0, window).otherwise(F.col("kind")).alias("kind"), F.explode(F.arrays_zip("starts", "windows")).alias("x"))
    spans = spans.select("row", "kind", F.col("x.starts").alias("at"), F.col("x.windows").alias("hash")).distinct()
    hits = spans.join(rows.filter("kind > 0"), ["kind", "hash"])
    items = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    marked = hits.select("row", "at", "kind").distinct().groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", (F.col("at") + F.col("kind")).alias("end")))).alias("s"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["to"], x["at"]))).alias("n"), F.greatest(acc["to"], x["end"]).alias("to"))
    covered = marked.select("row", F.aggregate("s", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), step)["n"].alias("n_hit"))
    return (
        numbered.mapInArrow(sizes, f"row bigint, doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint")
        .join(covered, "row", "left")
        .join(items, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )
