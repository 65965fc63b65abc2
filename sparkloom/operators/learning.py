"""Learning merges on the cluster, with an index from pairs to words that grows by deltas.

Three things are kept. The index, a table (code, word, freq) with a row for each pair that a word has had, lies in folders by bucket of the pair and
is sorted by pair within its files, so a merge reads the rows of its own pair and no other word. The counts are a table (code, n) of pairs
and of changes to them. The merges so far are a list; a word's ids are not stored, as encoding the word with these merges gives them.

A step applies several merges at a time, those that provably do not interact (see independent()). Its tasks read the index rows of their pairs, and each
sends the changes of the counts, and index rows for the pairs that have come into being. Pairs made of older ids only get rarer, so
the driver needs only the head of the counts: the commonest pairs, exact and bounded in number, kept up to date by each step's changes. When
they are used up the next head is taken from the table. Changes are folded together in levels, so a row is written again a few times at most.

Words longer than LONG_WORD bytes have no index rows, which would repeat a long word for each of its pairs: every step looks through all of them.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.patterns import FIRST_MERGE
from sparkloom.operators.bpe import WordEncoder, pair_counts, word_ids
from sparkloom.sources.files import Scratch, new_folder, remove, stored

Pair = tuple[int, int]

#: Merges of one step at most, and pairs whose counts the driver holds at most.
STEP, HEAD = 64, 1 << 15
#: Bytes up to which a word is in the index.
LONG_WORD = 64
#: Folders of the index by pair, and tables of a level that are folded into one of the next.
BUCKETS, FOLD = 16, 16
_ID = 1 << 16
_ROWS = "code bigint, word string, freq bigint"


def _code(pair: Pair) -> int:
    return pair[0] * _ID + pair[1]


def _pair(code: int) -> Pair:
    return code // _ID, code % _ID


def _bucket(code: int) -> int:
    return (code // _ID * 31 + code % _ID) % BUCKETS


def independent(head: dict[Pair, int], floor: tuple[int, int, int], most: int, least: int) -> list[Pair]:
    """The next merges, at most `most`, that learning one at a time would choose, one after another, from the counts as they are now.
    head: the counts of all pairs from `floor` (n, a, b) on, in the order (n, a, b).

    A merge (a, b) changes the counts of pairs that end in a or begin with b, and makes pairs that are no more frequent than one of these
    was. So the next pair in order follows for certain as long as no pair that is as frequent, itself included, ends or begins so."""
    order = sorted(((n, *p) for p, n in head.items() if n >= least), reverse=True)
    out: list[Pair] = []
    firsts, seconds = set(), set()
    start = 0
    while start < len(order) and len(out) < most:
        n, end = order[start][0], start
        while end < len(order) and order[end][0] == n:
            end += 1
        for k in range(start, end):
            if len(out) == most:
                break
            # pairs as frequent that lie below the floor are unknown
            if out and (n <= floor[0] or any(b in firsts or a in seconds for _, a, b in order[k:end])):
                return out
            _, a, b = order[k]
            out.append((a, b))
            firsts.add(a)
            seconds.add(b)
            if a == b:
                return out
        start = end
    return out


def _codes(ids: list[int]) -> list[int]:
    return [a * _ID + b for a, b in zip(ids, ids[1:], strict=False)]


def _step(rows: DataFrame, before: list[Pair], merges: list[Pair]) -> DataFrame:
    """(kind, code, word, freq): kind 0 are changes of counts, in freq; kind 1 are new rows of the index. rows: index rows of the
    merges, and long words with a null code. A word that holds several of the pairs counts in the row of the first."""
    new_codes = [_code(p) for p in merges]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old_ids, new_ids, rank = WordEncoder(before), WordEncoder(before + merges), {c: i for i, c in enumerate(new_codes)}
        for part in parts:
            change: Counter = Counter()
            codes, words, freqs = [], [], []
            for code, word, freq in zip(*(part.column(c).to_pylist() for c in ("code", "word", "freq")), strict=True):
                old = _codes(old_ids(word))
                first = min((rank[c] for c in old if c in rank), default=None)
                if first is None or (code is not None and new_codes[first] != code):
                    continue
                new = _codes(new_ids(word))
                for c in old:
                    change[c] -= freq
                for c in new:
                    change[c] += freq
                if code is not None:
                    made = sorted(set(new) - set(old))
                    codes += made
                    words += [word] * len(made)
                    freqs += [freq] * len(made)
            changed = [(c, n) for c, n in change.items() if n]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0] * len(changed) + [1] * len(codes), pa.int32()),
                    pa.array([c for c, _ in changed] + codes, pa.int64()),
                    pa.array([None] * len(changed) + words, pa.string()),
                    pa.array([n for _, n in changed] + freqs, pa.int64()),
                ],
                ["kind", "code", "word", "freq"],
            )

    return rows.mapInArrow(run, f"kind int, {_ROWS}")


class _Levels:
    """Folders of rows by level; FOLD of one level are made one of the next, by `fold`, and removed."""

    def __init__(self, spark: SparkSession, fold) -> None:
        self.spark, self.fold, self.folders = spark, fold, defaultdict(list)

    def add(self, folder: str, level: int = 0) -> None:
        self.folders[level].append(folder)
        if len(self.folders[level]) >= FOLD:
            full, self.folders[level] = self.folders[level], []
            self.add(self.fold(full, level), level + 1)
            for path in full:
                remove(self.spark, path)


class PairIndex:
    """The state of learning over a table (word, freq) of distinct words. Folders lie in the shared folder and go with the surrounding Scratch."""

    def __init__(self, freq: DataFrame, head: int = HEAD) -> None:
        self.spark, self.most = freq.sparkSession, head
        self.merges: list[Pair] = []
        self.head: dict[Pair, int] = {}
        self.floor = (0, 0, 0)
        words = stored(freq.select("word", "freq", word_ids(F.col("word")).alias("ids")).filter("size(ids) > 1"), "bpe-words")
        self.long = stored(words.filter(F.octet_length("word") > LONG_WORD).select(F.lit(None).cast("long").alias("code"), "word", "freq"), "bpe-long-words", few=True)
        pairs = F.transform(F.slice("ids", 1, F.size("ids") - 1), lambda x, i: x.cast("long") * _ID + F.get(F.col("ids"), i + 1))
        self.index = _Levels(self.spark, self._fold_index)
        self.index.folders[1] = [self._sorted(words.filter(F.octet_length("word") <= LONG_WORD).select(F.explode(F.array_distinct(pairs)).alias("code"), "word", "freq"))]
        self.counts = _Levels(self.spark, self._fold_counts)
        self.counts.folders[1] = [stored(pair_counts(words).select((F.col("a").cast("long") * _ID + F.col("b")).alias("code"), F.col("n").alias("freq")), "bpe-counts")._folder]

    def _sorted(self, rows: DataFrame) -> str:
        """Writes index rows in folders by bucket, sorted by pair; a pair that many words hold is split by word."""
        folder = new_folder(self.spark, "bpe-index")
        code = F.col("code")
        dealt = rows.withColumn("bucket", F.pmod(F.floor(code / _ID) * 31 + code % _ID, F.lit(BUCKETS)).cast("int")).repartitionByRange("bucket", "code", "word")
        dealt.sortWithinPartitions("bucket", "code").write.partitionBy("bucket").parquet(folder)
        return folder

    def _read_counts(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.schema("code bigint, freq bigint").parquet(*folders)
        return rows.groupBy("code").agg(F.sum("freq").alias("freq")).filter("freq <> 0")

    def _fold_counts(self, folders: list[str], level: int) -> str:
        return stored(self._read_counts(folders), "bpe-counts", few=True)._folder

    def _fold_index(self, folders: list[str], level: int) -> str:
        return self._sorted(self.spark.read.schema(_ROWS).option("recursiveFileLookup", "true").parquet(*folders))

    def _rows(self, merges: list[Pair]) -> DataFrame:
        """The index rows of the pairs: by bucket from folded folders, by the files' own statistics from all."""
        codes = [_code(p) for p in merges]
        wanted: Column = reduce(lambda x, y: x | y, [F.col("code") == c for c in codes])
        out = self.long
        for level, folders in self.index.folders.items():
            if level:
                for path in folders:
                    own = self.spark.read.schema(f"{_ROWS}, bucket int").parquet(path).filter(F.col("bucket").isin(sorted({_bucket(c) for c in codes})))
                    out = out.unionByName(own.filter(wanted).drop("bucket"))
            elif folders:
                out = out.unionByName(self.spark.read.schema(_ROWS).parquet(*folders).filter(wanted))
        return out

    def _take_head(self) -> None:
        counts = self._read_counts([path for folders in self.counts.folders.values() for path in folders])
        rows = counts.orderBy(F.desc("freq"), F.desc("code")).limit(self.most).collect()
        self.head = {_pair(r["code"]): r["freq"] for r in rows}
        self.floor = (rows[-1]["freq"], *_pair(rows[-1]["code"])) if len(rows) == self.most else (0, 0, 0)

    def _update_head(self, changes: DataFrame, merges: list[Pair], first_new: int) -> None:
        """Brings the head up to date from a step's changes. Pairs that fall below the floor leave it; new ones above it come in."""
        firsts, seconds = {a for a, _ in merges}, {b for _, b in merges}
        touched = [_code(p) for p in self.head if p[1] in firsts or p[0] in seconds or p in set(merges)]
        new = (F.floor(F.col("code") / _ID) >= first_new) | (F.col("code") % _ID >= first_new)
        wanted = changes.groupBy("code").agg(F.sum("freq").alias("freq")).withColumn("new", new).filter((F.col("new") & (F.col("freq") >= max(self.floor[0], 1))) | F.col("code").isin(touched))
        # `touched` and the new pairs are at most `most` each
        rows = wanted.orderBy(F.desc("new"), F.desc("freq"), F.desc("code")).limit(len(touched) + self.most).collect()
        made = [r for r in rows if r["new"]]
        if len(made) >= self.most:
            made = made[: self.most]
            self.floor = max(self.floor, (made[-1]["freq"], *_pair(made[-1]["code"])))
            rows = made + self._read_counts_of(changes, touched)
        for r in rows:
            p = _pair(r["code"])
            self.head[p] = self.head.get(p, 0) + r["freq"]
        self.head = {p: n for p, n in self.head.items() if n > 0 and (n, *p) >= self.floor}

    def _read_counts_of(self, changes: DataFrame, codes: list[int]) -> list:
        return changes.filter(F.col("code").isin(codes)).groupBy("code").agg(F.sum("freq").alias("freq")).collect() if codes else []

    def step(self, most: int, least: int) -> list[Pair]:
        """Learns and applies up to `most` merges of pairs that occur `least` times or more; none if there is no such pair."""
        merges = independent(self.head, self.floor, most, least)
        if not merges:
            self._take_head()
            merges = independent(self.head, self.floor, most, least)
            if not merges:
                return []
        folder = new_folder(self.spark, "bpe-step")
        _step(self._rows(merges), self.merges, merges).write.partitionBy("kind").parquet(folder)
        counts, rows = f"{folder}/kind=0", f"{folder}/kind=1"
        changes = self.spark.read.schema("code bigint, freq bigint").parquet(counts)
        self._update_head(changes, merges, FIRST_MERGE + len(self.merges))
        self.merges += merges
        self.counts.add(counts)
        if self._there(rows):  # words that became one id leave no pair
            self.index.add(rows)
        return merges

    def _there(self, folder: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)


def learn(freq: DataFrame, n_merges: int, min_freq: int = 2, step: int = STEP, head: int = HEAD) -> list[Pair]:
    """The merges of bpe.learn_merges() over a table (word, freq) that stays on the cluster. `step`: merges of one step at most; `head`: counts
    that the driver holds at most. Neither changes the result."""
    with Scratch(freq.sparkSession):
        index = PairIndex(freq, head)
        while len(index.merges) < n_merges and index.step(min(step, n_merges - len(index.merges)), max(min_freq, 1)):
            pass
        return index.merges
