"""Repeated windows by a depth-limited radix sort of suffixes over bytes.

Suffixes are told apart by their first `threshold` bytes only: a window. Digits are taken from the most significant on, and a bucket that cannot hold windows
of two documents goes no further; buckets of full depth are exactly the repeated windows. What makes it affordable is the order of digits. The first
digit of a window is its gram of least hash, which equal windows have at the same place; neighbouring windows mostly share that occurrence (their
anchor), so a run of them is one row. The next digits are what lies beside the anchor: a pass halves the windows of a run by their distance from it,
and what all windows of a half have in common is longer each time, up to the whole window when a single one is left. Windows never leave
their run before they differ in their buckets.

1. Texts that are equal to one of a smaller id go at once, so only one text of each group of exact copies is sorted.
2. First pass: grams by the number of texts that hold one. What no other text has stays out; a bit table of grams (BITS a gram, fewer from 128 MB
   on) tells that while the texts are read again, so no run is shuffled for it. Grams that a table can't hold at LEAST_BITS go to further tables, and
   the texts are read once for each. What a table takes for shared by mistake goes when runs are counted by gram.
3. A gram all of whose runs are equal is decided: the least id of its runs is that of each of their windows. Other equal runs are counted once, with their least and
   greatest id.
4. Further passes over these, as above. A bucket with a single run, or whose runs agree in all of their windows, is decided as a whole.
5. Runs carry what was decided back to the texts that hold them, where windows of a smaller id become spans.

Every step is a count or a join on a key of which partial sums are made first, or whose rows a skewed join splits; tasks hold a block of
bytes at a time. Comparisons are of bytes, or of 128 bits of digests of them.

Defined results: null texts are empty; a text shorter than the threshold has no window. Rows without an id keep all, and nothing is
removed for their sake. Rows that share an id don't count as smaller than each other, whatever their texts; repeated rows give equal rows. Windows
that overlap within a text count, but only other texts remove anything. Other columns stay, whatever they are called, if they are named in `carry`.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from .common import TABLE_KEYS, Scratch, bit_table, new_folder, possible, stored, without

#: Fixed value: length of a window in bytes.
THRESHOLD = 50
#: Bytes that a task looks at together (some 100 bytes of memory for each).
BLOCK = 1 << 20
#: Bits of a table for each gram, at least so many once it has its largest size, and those that a gram sets, all in one word.
BITS, LEAST_BITS, PROBES = 16, 6, 4
#: Grams of one table (128 MB; tasks hold one table at a time), and the number of tables, beyond which a gram gets fewer bits.
TABLE_GRAMS, TABLES = 178_000_000, 16
#: Words of a table that are put together at once.
CHUNK = 1 << 12
SPANS = ArrayType(StructType().add("start", LongType()).add("end", LongType()))


def halves(threshold: int) -> int:
    """Windows that can share an anchor: a power of two, so that halving ends at single windows; the gram is what is left of a window."""
    n = 1
    while 3 * n <= threshold:
        n *= 2
    return n


# ---- runs of windows with one anchor, by array arithmetic


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def runs(data: np.ndarray, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """Windows of pieces that lie behind one another in data, in runs of one anchor: the piece, the place of the first window, the number of windows, the anchor's
    distance from the first, and the gram's hash. Each window of a piece is in one run."""
    width = halves(threshold)
    gram, n = threshold - width + 1, len(data)
    forth, back = _powers(1 << (n - 1).bit_length() if n > 1 else 2)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forth[:n], out=sums[1:])
    hashes = _mixed((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    least = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(n - gram + 1, dtype=np.uint64)  # of equal hashes the first place
    step = 1
    while step < width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, np.int64)
    lows = np.concatenate([[0], ends[:-1]])
    np.add.at(inside, lows, 1)
    np.add.at(inside, np.minimum(ends - threshold + 1, len(anchor)), -1)
    fits = np.cumsum(inside[:-1]) > 0
    new = fits.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~fits[:-1]
    cuts = np.append(np.flatnonzero(new | ~fits), len(anchor))
    at = np.flatnonzero(new[cuts[:-1]])
    first, after = cuts[at], cuts[at + 1]
    return np.searchsorted(ends, first, side="right"), first, after - first, anchor[first] - first, hashes[anchor[first]].view(np.int64)


def _blocks(texts: pa.Array, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, ends, rows, bases): pieces of the texts, of some BLOCK bytes together; a long text is several pieces, which overlap so that each window is in one."""
    parts, rows, bases, total = [], [], [], 0
    for i, text in enumerate(texts.to_pylist()):
        for low in range(0, len(text or b"") - threshold + 1, BLOCK):
            parts.append(text[low : low + BLOCK + threshold - 1])
            rows.append(i)
            bases.append(low)
            total += len(parts[-1])
            if total >= BLOCK:
                yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([*map(len, parts)]), np.array(rows), np.array(bases, np.int64)
                parts, rows, bases, total = [], [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([*map(len, parts)]), np.array(rows), np.array(bases, np.int64)


# ---- the first pass: grams


def shared_grams(texts: DataFrame, threshold: int) -> DataFrame:
    """(gram): hashes of grams that anchor windows in two texts at least, or in two blocks of one. A block sends a gram once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ends, rows, _ in _blocks(batch.column("bytes"), threshold):
                piece, _, _, _, gram = runs(data, ends, threshold)
                order = np.lexsort((rows[piece], gram))
                g, row = gram[order], rows[piece][order]
                other = np.ones(len(g), bool)
                other[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
                found, n = np.unique(g[other], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.minimum(n, 2), pa.int32())], ["gram", "n"])

    return texts.select("bytes").mapInArrow(run, "gram bigint, n int").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram")


def _word_and_bits(gram: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """A gram's word among so many, from the lower half of its hash (anchors are least by the upper one), and its bits there."""
    h = gram.view(np.uint64)
    bits = np.zeros(len(h), np.uint64)
    for k in range(PROBES):
        bits |= np.uint64(1) << (h >> np.uint64(32 + 6 * k) & np.uint64(63))
    return ((h & np.uint64(0xFFFFFFFF)) * np.uint64(words) >> np.uint64(32)).astype(np.int64), bits


def gram_tables(grams: DataFrame, most: int) -> tuple[int, DataFrame, int]:
    """A Bloom filter over a stored table of grams: the words of one of its tables, (chunk, words) of all of them, stored, and the number of tables. A table
    takes `most` grams at LEAST_BITS."""
    n = grams.count()
    tables = min(TABLES, max(1, -(-n // max(1, most))))
    words = max(1, min(-(-n // tables) * BITS, most * LEAST_BITS) // 64)
    words = -(-words // CHUNK) * CHUNK if words > CHUNK else words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bits = _word_and_bits(batch.column("gram").to_numpy(zero_copy_only=False), words * tables)
            yield pa.RecordBatch.from_arrays([pa.array((word // CHUNK).astype(np.int32)), pa.array((word % CHUNK).astype(np.int32)), pa.array(bits.view(np.int64))], ["chunk", "word", "bits"])

    def packed(chunk: pa.Table) -> pa.Table:
        out = np.zeros(CHUNK, np.int64)
        np.bitwise_or.at(out, chunk.column("word").to_numpy(), chunk.column("bits").to_numpy())
        return pa.table({"chunk": chunk.column("chunk")[:1], "words": pa.array([out.tobytes()], pa.binary())})

    marks = grams.mapInArrow(run, "chunk int, word int, bits bigint")
    return words, stored(marks.groupBy("chunk").applyInArrow(packed, "chunk int, words binary"), "gram-table", few=True), tables


def occurrences(texts: DataFrame, grams: DataFrame, threshold: int, most: int = TABLE_GRAMS) -> DataFrame:
    """The runs of windows whose gram is shared, and a few others: doc_id and h of the text, start (of the first window), left (its distance to the anchor), n (windows), gram, piece
    (all bytes of its windows)."""
    words, chunks, tables = gram_tables(grams, most)
    out = None
    for k in range(tables):
        low = k * words
        table = np.zeros(words, np.int64)
        for row in chunks.filter(F.col("chunk").between(low // CHUNK, (low + words - 1) // CHUNK)).toLocalIterator():  # a few files at a time
            at = row["chunk"] * CHUNK
            a, b = max(at, low), min(at + CHUNK, low + words)
            table[a - low : b - low] = np.frombuffer(row["words"], np.int64)[a - at : b - at]
        part = _occurrences(texts, texts.sparkSession.sparkContext.broadcast(table), low, words * tables, threshold)
        out = part if out is None else out.unionByName(part)
    return out


def _occurrences(texts: DataFrame, held: Broadcast, low: int, words: int, threshold: int) -> DataFrame:
    """Of the runs those whose gram is in this table, which has the words from low on, of so many of all tables."""
    kind = dict(texts.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value.view(np.uint64)
        for batch in batches:
            for data, ends, rows, bases in _blocks(batch.column("bytes"), threshold):
                piece, first, n, left, gram = runs(data, ends, threshold)
                word, bits = _word_and_bits(gram, words)
                own = np.flatnonzero((word >= low) & (word < low + len(table)))
                keep = own[table[word[own] - low] & bits[own] == bits[own]]
                piece, first, n, left, gram = (x[keep] for x in (piece, first, n, left, gram))
                lengths = n + threshold - 1
                upto = np.concatenate([[0], np.cumsum(lengths)])
                own = data[np.repeat(first - upto[:-1], lengths) + np.arange(upto[-1])]
                held_bytes = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(own))])
                row = pa.array(rows[piece])
                start = bases[piece] + first - np.concatenate([[0], ends[:-1]])[piece]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("h").take(row), pa.array(start, pa.int64()), pa.array(left, pa.int32()), pa.array(n, pa.int32()), pa.array(gram), held_bytes], ["doc_id", "h", "start", "left", "n", "gram", "piece"])

    return texts.select("doc_id", "h", "bytes").mapInArrow(run, f"doc_id {kind}, h bigint, start bigint, left int, n int, gram bigint, piece binary")


# ---- further passes


def _of_half(rows: DataFrame, threshold: int) -> DataFrame:
    """rows cut down to those of their windows whose distance from the anchor is low to high, with digests of 128 bits: k1 and k2 of what all windows at these distances have in
    common, s1 and s2 of all bytes that are left of the run."""
    a, b = F.greatest("low", F.col("left") - F.col("n") + 1), F.least("high", "left")
    rows = rows.withColumns({"a": a, "b": b}).filter("a <= b")
    core = F.substring("piece", F.col("left") - F.col("low") + 1, threshold - F.col("high") + F.col("low"))
    span = F.substring("piece", F.col("left") - F.col("b") + 1, threshold + F.col("b") - F.col("a"))
    rows = rows.withColumns({"k1": F.xxhash64("low", core), "k2": F.xxhash64(F.lit(1), "low", core), "piece": span, "left": F.col("b"), "n": F.expr("b - a + 1")}).drop("a", "b")
    return rows.withColumns({"s1": F.xxhash64("left", "piece"), "s2": F.xxhash64(F.lit(1), "left", "piece")})


def _split(rows: DataFrame) -> DataFrame:
    """Each row as two, for the nearer and the farther half of its distances."""
    mid = F.expr("low + (high - low + 1) div 2").cast("int")
    parts = F.array(F.struct(F.col("low").alias("low"), (mid - 1).alias("high")), F.struct(mid.alias("low"), F.col("high").alias("high")))
    return rows.withColumn("part", F.explode(parts)).drop("low", "high").select("*", "part.*").drop("part")


_RUN = ["c1", "c2", "piece", "left", "n", "lo", "hi", "low", "high"]
#: Of a run's windows, those at the distances a to b from the anchor.
_WINDOWS = ["left - n + 1 as a", "left as b"]


def decided(equal: DataFrame, threshold: int, scratch: Scratch) -> list[DataFrame]:
    """(c1, c2, a, b, least): of runs, the least id that has the windows at the distances a to b from the anchor, where two ids have them. equal: stored (c1, c2, piece, left, n, lo,
    hi), a row for each distinct run; it goes when the first pass has read it."""
    width, out, held = halves(threshold), [], equal
    rows, whole = equal.select(*_RUN[:-2], F.lit(0).alias("low"), F.lit(width - 1).alias("high")), width == 1
    while True:
        width = max(1, width // 2)
        halved = _of_half(rows if whole else _split(rows), threshold)
        # a bucket of one run needs no join: a bit table of the others tells it
        several = stored(halved.groupBy("k1").agg(F.count(F.lit(1)).alias("runs")).filter("runs > 1").select("k1"), "buckets", few=True)
        marked = possible(halved, "k1", bit_table(several, "k1", 4 * TABLE_KEYS))
        out.append(scratch.keep(stored(marked.filter("not __possible and lo < hi").selectExpr("c1", "c2", *_WINDOWS, "lo as least"), "runs-decided", few=True)))
        stats = halved.groupBy("k1", "k2").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), *[f(c).alias(f"{c}_{f.__name__}") for c in ("s1", "s2") for f in (F.min, F.max)]).filter("least < most")
        stats = stats.selectExpr("k1", "k2", "least", "s1_min = s1_max and s2_min = s2_max as same")
        last, held = held, _packed(marked.filter("__possible").select(*_RUN, "k1", "k2").join(stats, ["k1", "k2"]).drop("k1", "k2"), "halves")
        scratch.drop(several, last)
        out.append(scratch.keep(stored(held.filter("same").selectExpr("c1", "c2", *_WINDOWS, "least"), "runs-decided", few=True)))
        rows = held.filter("not same").select(*_RUN)
        del halved, marked, stats
        _free(held)
        if width == 1 or rows.isEmpty():
            return out


def _packed(df: DataFrame, name: str) -> DataFrame:
    """stored(), in less space: runs that follow one another overlap."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def _free(df: DataFrame) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def _merged(found: DataFrame, kind: str) -> DataFrame:
    """(doc_id, h, spans): spans that overlap or touch as one, in order. found: (doc_id, h, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for own in batch.column("spans"):
                flat = own.values.flatten()
                low, high = (x.to_numpy(zero_copy_only=False) for x in flat)
                order = np.argsort(low, kind="stable")
                low, reach = low[order], np.maximum.accumulate(high[order])
                new = np.append(True, low[1:] > reach[:-1])
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(low[new], reach[np.append(new[1:], True)], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "h", "spans"])

    return found.mapInArrow(run, f"doc_id {kind}, h bigint, spans {SPANS.simpleString()}")


_KEY = "__key"


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn(_KEY, F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("h").cast("string")))


def repeats(docs: DataFrame, threshold: int = THRESHOLD, carry: list[str] | None = None, id_col: str = "doc_id", text: str = "text", most: int = TABLE_GRAMS) -> DataFrame:
    """A row for each row of docs: the columns of `carry` (by default the id) with n_bytes, spans (what is removed: maximal runs of bytes, end exclusive) and kept (the
    remaining bytes). A byte is removed if a window of `threshold` bytes covers it that also starts in a text of a smaller id."""
    if threshold < 1:
        raise ValueError("threshold must be 1 at least")
    spark = docs.sparkSession
    carry = [id_col] if carry is None else carry
    raw = F.coalesce(F.encode(F.col(text).cast("string"), "UTF-8"), F.lit(b""))
    rows = docs.select(F.struct(*[docs[c] for c in carry]).alias("__row"), F.col(id_col).alias("doc_id"), raw.alias("bytes"))
    rows = _keyed(rows.withColumn("h", F.xxhash64("bytes")))
    kind = dict(rows.dtypes)["doc_id"]
    with Scratch(spark) as scratch:
        long = rows.filter(F.col("doc_id").isNotNull() & (F.length("bytes") >= threshold))
        narrow = stored(long.select("__row", "doc_id", "h", _KEY, F.length("bytes").cast("long").alias("n_bytes"), F.md5("bytes").alias("digest")), "texts", few=True)
        lead = narrow.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
        copies = scratch.keep(stored(narrow.join(lead, "digest").filter("doc_id > first").select("__row", "n_bytes", _KEY), "copies", few=True))
        gone = scratch.keep(stored(copies.select(_KEY).distinct(), "copied-keys", few=True))
        known = scratch.keep(stored(narrow.select(_KEY), "text-keys", few=True))
        texts = without(long, _KEY, gone, known).select("doc_id", "h", "bytes")
        grams = stored(shared_grams(texts, threshold), "grams", few=True)
        _free(grams)
        digests = {"c1": F.xxhash64("piece"), "c2": F.xxhash64(F.lit(1), "piece")}
        found = _packed(occurrences(texts, grams, threshold, most).withColumns(digests), "runs")
        # grams of two ids at least; a gram and c1 are 128 bits, too
        by_gram = found.groupBy("gram").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("c1").alias("x"), F.max("c1").alias("y")).filter("least < most")
        by_gram = stored(by_gram.selectExpr("gram", "least", "x = y as alone"), "gram-runs", few=True)
        several = stored(by_gram.filter("not alone").select("gram"), "grams-of-runs", few=True)
        _free(several)
        marked = possible(found, "gram", bit_table(several, "gram", 4 * TABLE_KEYS))
        some = marked.filter("__possible")
        equal = some.groupBy("c1", "c2").agg(*[F.first(c).alias(c) for c in ("piece", "left", "n")], F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        equal = _packed(equal, "distinct-runs")
        _free(equal)
        # what the table takes for one of several grams by mistake is decided with those; from here on only places are held, no bytes
        place = ["doc_id", "h", "start"]
        alone = marked.filter("not __possible").select(*place, "n", "gram").join(by_gram.filter("alone").select("gram", "least"), "gram").filter("least < doc_id")
        alone = stored(alone.select(*place, (F.col("start") + F.col("n") - 1 + threshold).alias("end")), "spans-alone", few=True)
        places = _packed(some.select(*place, "left", "c1", "c2"), "places")
        del marked, some
        scratch.drop(found, by_gram, several)
        _free(alone)
        parts = decided(equal, threshold, scratch)
        both = parts[0]
        for part in parts[1:]:
            both = both.unionByName(part)
        anchor = F.col("start") + F.col("left")
        hits = places.join(both, ["c1", "c2"]).filter("least < doc_id")
        hits = stored(hits.select("doc_id", "h", (anchor - F.col("b")).alias("start"), (anchor - F.col("a") + threshold).alias("end")), "spans-several", few=True)
        scratch.drop(places, *parts)
        _free(hits)
        spans = hits.unionByName(alone).select("doc_id", "h", F.struct("start", "end").alias("span"))
        by_text = spans.groupBy("doc_id", "h").agg(F.collect_list("span").alias("spans"))  # no more than a text has runs
        by_text = scratch.keep(stored(_keyed(_merged(by_text, kind)).select(_KEY, "spans"), "spans", few=True))
        _free(by_text)
        table = bit_table(by_text, _KEY)
        if table:
            scratch.keep(table[1])
    columns = ["__row", "n_bytes", "spans", "kept"]
    none = F.array().cast(SPANS)
    rest = possible(without(rows, _KEY, gone, known), _KEY, table)
    plain = rest.filter("not __possible").select("__row", F.length("bytes").cast("long").alias("n_bytes"), none.alias("spans"), F.col("bytes").alias("kept"))
    some = rest.filter("__possible").select("__row", _KEY, "bytes").join(by_text, _KEY, "left").select("__row", "bytes", F.coalesce("spans", none).alias("spans"))
    schema = StructType([rows.schema["__row"]]).add("n_bytes", LongType()).add("spans", SPANS).add("kept", BinaryType())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes = [], []
            for text_bytes, own in zip(batch.column("bytes").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                edges = [0, *(x for s in own for x in (s["start"], s["end"])), len(text_bytes)]
                kept.append(b"".join(text_bytes[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                sizes.append(len(text_bytes))
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(sizes, pa.int64()), batch.column("spans"), pa.array(kept, pa.binary())], columns)

    whole = copies.select("__row", "n_bytes", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))).cast(SPANS).alias("spans"), F.lit(b"").alias("kept"))
    out = plain.unionByName(some.mapInArrow(cut, schema)).unionByName(whole)
    return out.select(*[F.col("__row")[c].alias(c) for c in carry if c not in columns], "n_bytes", "spans", "kept")
