"""MinHash near-duplicate detection: SuperMinHash signatures, banding, verification on full shingle sets, union-find.

Each shingle has a random permutation of the signature's slots; at rank j it offers j plus a random fraction to its
j-th slot, and a slot keeps the least offer. Ranks are gone through for all shingles at a time, and a text is done as
soon as no slot holds more than the rank (early stopping).

Texts with the same shingle set are one class, so exact copies meet once. Classes that agree in one of `bands` bands are
candidates; with 32 bands of 4 rows, a pair of similarity 0.8 is none with probability 5e-8. First a bucket compares its
smallest id with all others, which joins a group of copies at once, and small buckets all their pairs. What is then still outside a
larger bucket's main component is compared with a few of its members. What is apart after that
is compared across components, each pair in the first bucket that it shares, but for pairs that cannot reach the similarity: shingles that one open set
alone has are counted, and a set of n with `own` such shingles shares n - own at most with any other; and two sets differ in as
many shingles at least as their bit sketches do in bits. Pairs within a component
are never formed, and nothing is capped.

Links are sought between classes, which a row number names; a doc_id that has several texts links their classes. The components
of classes give each row its smallest doc_id.

Defined results: null texts, and texts without a word, have no shingles and are linked with nothing. Rows that share a
doc_id are one node, whatever their texts. Rows with a null doc_id keep a null component_id, are linked with nothing and kept. Columns
other than doc_id and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, bit_table, possible, stored
from .components import connected_components

BANDS, ROWS = 32, 4
#: Members of a bucket up to which all pairs are compared at once.
SMALL_BUCKET = 8
#: Members of a bucket's main component that all the others are compared with before any pair is.
FEW = 8
#: Bits by which sets that cannot be near are told apart before they are compared in full.
SKETCH_BITS = 2048
#: Shingles whose permutations are held at a time.
_CHUNK = 1 << 17
_FRACTION = 48


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles (a shorter text is one shingle), and their offsets."""
    hashes, words = K.word_hashes(data, offsets, K.not_space_table())
    at, by_text = K.gram_positions(words, k)
    size = np.diff(words)
    own = K.grams(hashes, k)[at] if len(at) else np.zeros(0, K.U)
    text = np.repeat(np.arange(len(size)), np.diff(by_text))
    for n in range(1, k):
        short = np.flatnonzero(size == n)
        if len(short):
            own = np.concatenate([own, K.grams(hashes, n)[words[short]]])
            text = np.concatenate([text, short])
    order = np.lexsort((own, text))
    own, text = own[order], text[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    own, text = own[new], text[new]
    return own, np.searchsorted(text, np.arange(len(size) + 1)).astype(np.int64)


def _random(x: np.ndarray, j: int) -> np.ndarray:
    return K.mix(x + K.U((j + 1) * 0xA24BAED4963EE407 % 2**64))


def signatures(shingles: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """SuperMinHash of each set: size numbers, rank in the upper bits and the random fraction in the lower ones."""
    n_sets = len(offsets) - 1
    sig = np.full((n_sets, size), np.iinfo(np.uint64).max, K.U)
    flat = sig.reshape(-1)
    for a in range(0, len(shingles), _CHUNK):
        x = shingles[a : a + _CHUNK]
        of = np.searchsorted(offsets, np.arange(a, a + len(x)), "right") - 1
        perm = None
        rows = np.arange(len(x))
        for j in range(size):
            u = _random(x, j)
            pick = j + (u >> K.U(_FRACTION)).astype(np.int64) % (size - j)
            offer = (u & K.U((1 << _FRACTION) - 1)) | K.U(j << _FRACTION)
            if perm is None:
                slot = pick
            else:
                slot = perm[rows, pick]
                perm[rows, pick] = perm[rows, j]
                perm[rows, j] = slot
            np.minimum.at(flat, of * size + slot, offer)
            first, last = int(of[0]), int(of[-1]) + 1
            more = sig[first:last].max(1) >= K.U((j + 1) << _FRACTION)
            keep = more[of - first]
            if not keep.any():
                break
            if perm is None:
                x, of, pick = x[keep], of[keep], pick[keep]
                perm = np.broadcast_to(np.arange(size, dtype=np.uint8 if size <= 256 else np.int32), (len(x), size)).copy()
                rows = np.arange(len(x))
                perm[rows, pick] = 0
                perm[:, 0] = pick
            elif not keep.all():
                x, of, rows = x[keep], of[keep], rows[keep]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sig), bands), K.U)
    for b in range(bands):
        acc = np.full(len(sig), b * 0x9E6C63D0676A9A99 % 2**64, K.U)
        for r in range(rows):
            acc = K.mix(acc + sig[:, b * rows + r])
        out[:, b] = acc
    return out


def _signed(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    carried = [c for c in docs.columns if c != "text"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = K.text_buffers(part.column("text"))
            for a, b in K.batches(data, offsets, 1 << 20):
                own, by = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                keys = band_keys(signatures(own, by, bands * rows), bands, rows)
                n = np.diff(by)
                some = n > 0
                d1, d2 = (np.add.reduceat(np.append(K.mix(own + K.U(c)), K.U(0)), by[:-1]) for c in (0x1234567, 0x89ABCDEF012345))
                ends = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).slice(a, b - a) for c in carried), pa.array(n), pa.array(np.where(some, d1, 0).view(np.int64)), pa.array(np.where(some, d2, 0).view(np.int64)), K.list_array(keys[some].reshape(-1).view(np.int64), ends, pa.int64())],
                    [*carried, "n", "d1", "d2", "bands"],
                )

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in carried), "n bigint, d1 bigint, d2 bigint, bands array<bigint>"]))


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = K.text_buffers(part.column("text"))
            for a, b in K.batches(data, offsets, 1 << 20):
                own, by = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                marks = np.zeros((b - a, SKETCH_BITS), np.uint8)
                marks[np.repeat(np.arange(b - a), np.diff(by)), (own % K.U(SKETCH_BITS)).astype(np.int64)] = 1
                sketch = np.packbits(marks, axis=1).view(np.int64)
                at = np.arange(b - a + 1) * (SKETCH_BITS // 64)
                yield pa.RecordBatch.from_arrays([part.column("id").slice(a, b - a), K.list_array(own.view(np.int64), by, pa.int64()), K.list_array(sketch.reshape(-1), at, pa.int64())], ["id", "shingles", "sketch"])

    return docs.mapInArrow(run, "id bigint, shingles array<bigint>, sketch array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (x, y, sizes nx and ny) those, each once, whose sets have that similarity in per cent at least."""
    near = pairs.filter(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = near.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.filter(f"100 * common >= {percent} * (size(sa) + size(sb) - common)").select("a", "b")


def row_key() -> Column:
    """What tells rows apart: doc_id and two hashes of the text, in one string."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))


def classes(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, nameless: bool = True, by_id: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two stored tables for docs (doc_id, text): of each row doc_id, key (see row_key), n (shingles) and d1, d2 (digests of its set);
    of each class of equal sets d1, d2, n and component, a number that linked classes share.

    `nameless`: rows without a doc_id take part. `by_id`: classes that share a doc_id are linked."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", row_key())
    with Scratch(spark) as scratch:
        signed = stored(_signed(docs, shingle_words, bands, rows).withColumn("row", F.monotonically_increasing_id()), "near-signed")
        known = scratch.keep(stored(signed.select("doc_id", "key", "n", "d1", "d2"), "near-rows", few=True))
        usable = "n > 0" if nameless else "n > 0 and doc_id is not null"
        first = F.min_by(F.struct("row", "key", "bands"), "row").alias("first")
        of_class = stored(signed.filter(usable).groupBy("d1", "d2", "n").agg(first).select("d1", "d2", "n", F.col("first.row").alias("id"), "first.key", "first.bands"), "near-classes", few=True)
        scratch.drop(signed)
        keyed = of_class.select("id", "n", F.explode("bands").alias("bucket"))
        shared = keyed.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("bucket")
        members = stored(keyed.join(shared, "bucket").select("bucket", "id", "n"), "near-members", few=True)
        linked = stored(of_class.join(members.select("id").distinct(), "id", "left_semi").select("key", "id"), "near-linked", few=True)
        # only rows that may be of a linked class, each text once, are shuffled
        texts = possible(docs, "key", bit_table(linked, "key")).filter("__possible").dropDuplicates(["key"]).join(linked, "key")
        sets = stored(_sets(texts.select("id", "text"), shingle_words), "near-sets", few=True)

        # first each bucket's smallest id with all others, and all pairs of small buckets
        sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("id", "n")).alias("lead"))
        with_lead = members.join(sizes, "bucket")
        lead = with_lead.filter("lead.id <> id").select(F.col("lead.id").alias("x"), F.col("id").alias("y"), F.col("lead.n").alias("nx"), F.col("n").alias("ny"))
        few = with_lead.filter(f"size <= {SMALL_BUCKET} and lead.id <> id").select("bucket", F.col("id").alias("x"), F.col("n").alias("nx"))
        pairs = few.join(few.select("bucket", F.col("x").alias("y"), F.col("nx").alias("ny")), "bucket").filter("x < y").select("x", "y", "nx", "ny")
        links = _verified(lead.union(pairs), sets, percent)
        if by_id:
            own = known.filter(usable).select("doc_id", "d1", "d2", "n").join(of_class.select("d1", "d2", "n", "id"), ["d1", "d2", "n"])
            least = own.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b")
            links = links.union(own.select("doc_id", F.col("id").alias("b")).join(least.select("doc_id", "a"), "doc_id").filter("a <> b").select("a", "b").distinct())
        labels = stored(connected_components(links), "near-labels", few=True)
        for compare in (_with_few, _across):
            rest = _open(with_lead, labels)
            if rest is None:
                break
            links = compare(rest, sets, percent).union(labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
            labels = stored(connected_components(links), "near-labels", few=True)
        found = of_class.select("d1", "d2", "n", "id").join(labels, "id", "left").select("d1", "d2", "n", F.coalesce("component", "id").alias("component"))
        return known, scratch.keep(stored(found, "near-found", few=True))


def _open(with_lead: DataFrame, labels: DataFrame) -> DataFrame | None:
    """Rows of larger buckets that hold more than one component: bucket, id, n, comp and main, the bucket's largest component. None without any."""
    rest = with_lead.filter(f"size > {SMALL_BUCKET} and lead.id <> id").select("bucket", "id", "n").join(labels, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("comp"))
    counts = rest.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("m"), F.count(F.lit(1)).alias("comps"))
    rest = stored(rest.join(counts.filter("comps > 1").select("bucket", F.col("m.comp").alias("main")), "bucket"), "near-rest", few=True)
    return None if rest.isEmpty() else rest


def _with_few(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of what is outside a bucket's main component with FEW of its members, by hash: most of what belongs to it does so by one of these."""
    picks = F.array(*[F.col(f"p{i}") for i in range(FEW)])
    few = rest.filter("comp = main").groupBy("bucket").agg(*[F.min(F.struct(F.xxhash64(F.lit(i), "id").alias("h"), "id", "n")).alias(f"p{i}") for i in range(FEW)])
    few = few.select("bucket", F.explode(F.array_distinct(F.transform(picks, lambda p: F.struct(p["id"].alias("id"), p["n"].alias("n"))))).alias("p"))
    pairs = rest.filter("comp <> main").join(few, "bucket").select(F.col("id").alias("x"), F.col("p.id").alias("y"), F.col("n").alias("nx"), F.col("p.n").alias("ny"))
    return _verified(pairs, sets, percent)


def _across(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components in the buckets that are still open: each pair that the bounds admit, in the first bucket that it shares."""
    open_ids = rest.groupBy("id").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))  # at most one a band
    tokens = sets.join(open_ids.select("id"), "id", "left_semi").repartition("id").select("id", F.explode("shingles").alias("token"))
    alone = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).filter("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    # a set with `own` shingles that no other open set has shares n - own at most, so its partners have `reach` shingles at most
    reach = (F.col("n") - F.coalesce("own", F.lit(0))) * (100 + percent) / percent - F.col("n") + 1e-6
    rest = stored(rest.join(alone, "id", "left").withColumn("reach", reach).filter("reach > 0").select("bucket", "id", "n", "comp", "main", "reach"), "near-reach", few=True)
    rest = rest.join(sets.select("id", "sketch").join(open_ids, "id"), "id")
    x, y = rest.filter("comp <> main").alias("x"), rest.alias("y")
    # sketches differ in no more bits than sets in shingles
    differ = f"aggregate(zip_with(x.sketch, y.sketch, (a, b) -> bit_count(a ^ b)), 0, (s, v) -> s + v) * {100 + percent} <= (x.n + y.n) * {100 - percent}"
    meet = F.expr(f"x.bucket = y.bucket and x.comp <> y.comp and (y.comp = y.main or x.id < y.id) and y.n <= x.reach and x.n <= y.reach and {differ} and x.bucket = array_min(array_intersect(x.buckets, y.buckets))")
    return _verified(x.join(y, meet).select(F.col("x.id").alias("x"), F.col("y.id").alias("y"), F.col("x.n").alias("nx"), F.col("y.n").alias("ny")), sets, percent)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable over links of `percent` or more),
    kept (doc_id = component_id). See the module's text."""
    with Scratch(docs.sparkSession) as scratch:
        signed, found = classes(docs, shingle_words, percent, bands, rows, nameless=False, by_id=True)
        named = stored(signed.filter("n > 0 and doc_id is not null").select("doc_id", "n", "d1", "d2").join(found, ["d1", "d2", "n"]), "near-named", few=True)
        least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        grouped = stored(named.join(least, "component").select("doc_id", "n", "component_id"), "near-grouped", few=True)
        # a doc_id may have texts without words, too: all its rows are one node
        bare = signed.filter("n = 0 or doc_id is null").select(F.col("doc_id").alias("__id"), F.col("n").alias("__n"))
        ids = grouped.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        alone = bare.join(ids, F.col("__id") == F.col("doc_id"), "left").select(F.col("__id").alias("doc_id"), F.col("__n").alias("n"), F.coalesce("component_id", "__id").alias("component_id"))
        out = grouped.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        return scratch.keep(stored(out, "near-duplicates", few=True))
