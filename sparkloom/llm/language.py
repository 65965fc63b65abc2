"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled text, at most `chars` letters and single spaces of it. A text is parsed from left
to right into the longest phrases that occur in the language's text; phrases * log2(training length) / text length estimates the
cross entropy in bits a letter, and the language with the least wins (ties: the first name).

Every letter of the training texts has a symbol of its own. Transitions by the `letters` commonest are a dense table, the others a sorted
list of (state, symbol), so alphabets of thousands of letters stay apart. Many places are parsed in step by array look-ups: a text is
cut into blocks of `BLOCK` letters, each is parsed from its first letter on until the phrase that crosses its end is complete, and then
the text's one parse is followed through the blocks: where it enters a block it goes phrase by phrase until it meets a phrase start of the
block's own parse, from which on both agree. The phrases counted are those of the whole text.

Training text is a bounded sample: `docs_per_lang` documents a language with the least hashes of doc_id, and of these texts, joined,
the first `chars` characters. Defined results: `und` with score 0 for null texts, texts without a letter, and where nothing was
learned; case, digits, punctuation and repeated spaces do not count.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHARS, DOCS_PER_LANG, LETTERS, BLOCK, SEED = 20_000, 64, 62, 512, 5
#: Automaton cells in all languages together; more languages get shorter texts each.
CELLS = 40_000_000
#: More languages than that are an error: their counts go to every task, and an automaton would have too little text.
MOST_LANGS = 1000
_LANES = 1 << 14


def letter_table() -> np.ndarray:
    """True for code points that are letters (general category L)."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return _letters


_letters: np.ndarray | None = None


def cleaned(text: Column) -> Column:
    """Lower case, each run of other than letters one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}]+", " "))


class Automaton:
    """Transitions of the automaton of all substrings of a sequence of symbols (numbers from 0 on)."""

    def __init__(self, codes: list[int], dense: int) -> None:
        next_: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes:
            cur = len(next_)
            next_.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in next_[p]:
                next_[p][c] = cur
                p = link[p]
            if p != -1:
                q = next_[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    copy = len(next_)
                    next_.append(dict(next_[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and next_[p].get(c) == q:
                        next_[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        self.width = dense
        table = np.full((len(next_), dense), -1, np.int32)
        rare = []
        for i, moves in enumerate(next_):
            for c, to in moves.items():
                if c < dense:
                    table[i, c] = to
                else:
                    rare.append(((i << 21) | c, to))
        self.flat = table.reshape(-1)
        rare.sort()
        self.keys, self.to = np.array([k for k, _ in rare], np.int64), np.array([t for _, t in rare], np.int32)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        common = code < self.width
        if common.all():
            return self.flat[state * self.width + code]
        out = self.flat[state * self.width + np.where(common, code, 0)]
        at = np.flatnonzero(~common)
        out[at] = -1
        if len(self.keys):
            key = (state[at].astype(np.int64) << 21) | code[at]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[at] = np.where(self.keys[i] == key, self.to[i], -1)
        return out

    def one(self, state: int, code: int) -> int:
        if code < self.width:
            return int(self.flat[state * self.width + code])
        key = (state << 21) | code
        i = int(np.searchsorted(self.keys, key))
        return int(self.to[i]) if i < len(self.keys) and self.keys[i] == key else -1


class Model:
    """Automata by language, and the symbol of every code point: 0 is the space, the commonest letters come first."""

    def __init__(self, texts: dict[str, str], chars: int = CHARS, letters: int = LETTERS) -> None:
        texts = {k: v for k, v in sorted(texts.items()) if v}
        most = min(chars, CELLS // max(1, 2 * (letters + 1) * len(texts)))
        self.texts = {k: v[:most] for k, v in texts.items()}
        common = [c for c, _ in sorted(Counter(c for v in self.texts.values() for c in v if c != " ").items(), key=lambda x: (-x[1], x[0]))]
        self.known = {c: i + 1 for i, c in enumerate(common)}
        self.other = len(common) + 1  # letters that no training text has: no transition leads there
        self.langs = list(self.texts)
        self.tables = [Automaton([self.code(c) for c in self.texts[k]], min(letters, len(common)) + 1) for k in self.langs]
        self.bits = np.array([np.log2(max(2, len(self.texts[k]))) for k in self.langs])

    def code(self, c: str) -> int:
        return 0 if c == " " else self.known.get(c, self.other)


def phrases(table: Automaton, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = BLOCK, lanes: int = _LANES) -> np.ndarray:
    """Phrases of each text codes[start:end]: the longest matches one after another; a letter that the automaton lacks is one."""
    n = -(-(ends - starts) // block)
    text = np.repeat(np.arange(len(starts)), n)
    first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    begin = starts[text] + (np.arange(len(text)) - first[text]) * block
    stop = np.minimum(begin + block, ends[text])
    begins = np.zeros(len(codes) + 1, bool)  # where phrases of the blocks' own parses begin
    leaves = np.zeros(len(text), np.int64)  # the first phrase start at or after a block's end
    for k in range(0, len(text), lanes):
        lane = np.arange(k, min(k + lanes, len(text)))
        state = np.zeros(len(lane), np.int64)
        t = 0
        while len(lane):
            at = begin[lane] + t
            over = at >= ends[text[lane]]
            if over.any():
                leaves[lane[over]] = ends[text[lane[over]]]
                lane, state, at = lane[~over], state[~over], at[~over]
                if not len(lane):
                    break
            c = codes[at]
            to = table.step(state, c)
            fresh = np.flatnonzero((state == 0) | (to < 0))  # a phrase begins here
            if len(fresh):
                done = at[fresh] >= stop[lane[fresh]]
                begins[at[fresh[~done]]] = True
                to[fresh] = np.maximum(table.step(np.zeros(len(fresh), np.int64), c[fresh]), 0)
                if done.any():
                    gone = fresh[done]
                    leaves[lane[gone]] = at[gone]
                    left = np.ones(len(lane), bool)
                    left[gone] = False
                    lane, to = lane[left], to[left]
            state = to.astype(np.int64)
            t += 1
    upto = np.concatenate([[0], np.cumsum(begins[:-1])])
    count = np.zeros(len(starts), np.int64)
    single = n == 1
    count[single] = (upto[ends] - upto[starts])[single]
    for i in np.flatnonzero(n > 1):
        at, end, total = int(starts[i]), int(ends[i]), 0
        while at < end:
            b = int(first[i]) + (at - int(starts[i])) // block
            if begins[at]:
                total += int(upto[stop[b]] - upto[at])
                at = int(leaves[b])
                continue
            state, total = max(table.one(0, int(codes[at])), 0), total + 1
            at += 1
            while state and at < end and (to := table.one(state, int(codes[at]))) >= 0:
                state, at = to, at + 1
        count[i] = total
    return count


def training_text(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, chars: int = CHARS) -> dict[str, str]:
    """Bounded sample of labelled documents, by language. docs: doc_id, text, lang. Texts are cleaned and cut on the executors: at most
    `chars` characters a language come to the driver."""
    own = docs.filter("lang is not null and text is not null").withColumn("h", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)))
    counts = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # about four times the documents that are wanted, by hash, before the rows are ranked
    if counts.limit(MOST_LANGS + 1).count() > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    some = own.join(F.broadcast(counts), "lang").filter(F.col("h") * F.col("n") <= F.lit((1 << 30) * 4 * docs_per_lang))
    best = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))).filter(F.col("r") <= docs_per_lang)
    clean = best.select("lang", "r", cleaned(F.substring("text", 1, 4 * chars)).alias("text")).filter("text <> ''")
    before = F.sum(F.char_length("text") + 1).over(Window.partitionBy("lang").orderBy("r")) - F.char_length("text") - 1
    rows = clean.withColumn("before", before).filter(F.col("before") < chars).select("lang", "r", F.expr(f"substring(text, 1, cast({chars} - before as int))").alias("text")).collect()
    out: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda x: (x["lang"], x["r"])):
        out.setdefault(row["lang"], []).append(row["text"])
    return {k: " ".join(v)[:chars] for k, v in out.items()}


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id and held_out (if any), with lang_pred, score (0 to 1: how far the runner-up's entropy lies above) and bits."""
    carried = [c for c in ("doc_id", "held_out") if c in docs.columns]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.langs, model.tables, model.bits, model.known, model.other))
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in carried), "lang_pred string, score double, bits double"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, tables, bits, known, other = shared.value
        code = np.full(0x110000, other, np.int32)
        for c, symbol in known.items():
            code[ord(c)] = symbol
        isletter = letter_table()
        names = np.array([*langs, "und"], object)
        for part in parts:
            texts = part.column("text").to_pylist()
            for a in range(0, max(1, len(texts)), 256):
                group = texts[a : a + 256]
                if not group:
                    continue
                points = [np.frombuffer((x or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for x in group]
                sizes = np.array([len(x) for x in points])
                allp = np.concatenate(points) if sizes.sum() else np.zeros(0, np.uint32)
                of = np.repeat(np.arange(len(group)), sizes)
                letter = isletter[allp]
                # runs of other characters become one space; none at a text's ends
                keep = letter.copy()
                prev = np.zeros(len(allp), bool)
                prev[1:] = letter[:-1] & (of[1:] == of[:-1])
                keep |= ~letter & prev
                codes = np.where(letter, code[allp], 0)[keep].astype(np.int32)
                of = of[keep]
                ends = np.searchsorted(of, np.arange(len(group)), "right")
                starts = np.searchsorted(of, np.arange(len(group)), "left")
                trailing = (ends > starts) & (codes[np.maximum(ends - 1, 0)] == 0) if len(codes) else np.zeros(len(group), bool)
                ends = ends - trailing
                length = ends - starts
                cost = np.full((len(group), len(langs)), np.inf)
                for j, table in enumerate(tables):
                    cost[:, j] = phrases(table, codes, starts, ends) * bits[j] / np.maximum(length, 1)
                known_text = (length > 0) & (len(langs) > 0)
                best = np.where(known_text, cost.argmin(1) if len(langs) else 0, len(langs))
                low = np.sort(cost, 1)
                least = np.where(known_text, low[:, 0] if len(langs) else 0, 0.0)
                second = low[:, 1] if len(langs) > 1 else np.full(len(group), np.inf)
                score = np.where(known_text, 1 - least / np.maximum(second, 1e-9), 0.0).clip(0, 1)
                yield pa.RecordBatch.from_arrays([*(part.column(c).slice(a, len(group)) for c in carried), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(least)], [*carried, "lang_pred", "score", "bits"])

    return docs.select(*carried, "text").mapInArrow(run, schema)


def identify(docs: DataFrame, folds: int = 5, chars: int = CHARS, docs_per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, bits. Learns from rows that are not held out; a row is held out if
    crc32(doc_id as text) is divisible by `folds`; a null doc_id is held out too."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(True))
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held.alias("held_out"))
    model = Model(training_text(own.filter(~F.col("held_out")), docs_per_lang, chars), chars)
    return predict(own.select("doc_id", "text", "held_out"), model)

