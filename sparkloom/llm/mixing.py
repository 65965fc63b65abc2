"""Mixing sources to target weights by subset-sum budget fitting.

Each source's budget in words is its share of `share` times all words by weight, but `most` times its own words at
most; what is cut off goes to the others by weight. A source is taken whole as often as its budget allows. For the rest,
documents are counted by length: each length gives its proportional number, then lengths by the largest remainder, then
bounded-knapsack dynamic programming over the lengths that are left closes the remaining budget. If words remain, taken
documents are given back, up to BACK_WORDS, and that budget is fitted anew, never worse than before. If words still remain, the whole budget is fitted
anew where that is exact: in units of the lengths' greatest common divisor, up to BACK_WORDS units, or for few documents by the sums of two halves of them,
however long they are. Of each length's documents those with the least seeded hashes are taken.

The dynamic programming sees a source's lengths and their counts, never its documents, and a budget of DP_WORDS at
most, or of BACK_WORDS units where that leaves words. Ranks within a length come from bucket counts: a length that a third of all rows share is split over
tasks, whatever their ids, and rows that are equal in all columns are counted before they are ranked.

Defined results: null texts, and texts without a word, have size 0 and are never taken. A null source is a source, the
last. Repeated rows count as rows of their own. Rows that share doc_id, source and size are told apart by all of their columns, so reruns take the same
ones in any order of the rows; of rows that are equal in every column so many are taken. Without any word all targets are 0. Columns of a type that has no
hash (maps) are an error.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.ordered import ROW, sums_before, with_row_numbers

from .common import Scratch, stored, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE, MOST, SEED = 1.5, 2, 29
#: Budget that dynamic programming covers; the steps before it leave no more wherever the lengths allow.
DP_WORDS = 20_000
#: Budget, in words or in units of the lengths' divisor, up to which taken documents are given back where words remain.
BACK_WORDS = 2_000_000
#: Sums of a half of the documents, where there are few.
HALF_SUMS = 1 << 20
BUCKET_ROWS = 128
#: Sources and lengths that are sent to every task (about 100 bytes each); with more, rows are joined by them.
BROADCAST_LENGTHS = 500_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) with weight and target. Capped targets follow from one level: target = least(cap, level * weight), where
    the level is found along the sources by cap per weight. One row a source goes through the windows."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * float(most)).withColumn("per", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    by_cap = everything.orderBy("per", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.lit(share) * F.sum("source_size").over(everything) - (F.sum("cap").over(by_cap) - F.col("cap"))
    level = left / (F.sum("weight").over(everything) - F.sum("weight").over(by_cap) + F.col("weight"))
    s = s.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") <= F.col("per"), F.struct("per", "level"))).over(everything)["level"])
    return s.select("source", "source_size", "weight", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap").alias("target"))


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that the sum is the largest that is at most the budget (bounded knapsack by powers of two)."""
    taken = np.zeros(len(lengths), np.int64)
    pieces: list[tuple[int, int]] = []
    came_by = np.full(budget + 1, -1, np.int64)
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    for i in np.argsort(-lengths):
        length, left, power = int(lengths[i]), int(counts[i]), 1
        if not 0 < length <= budget:
            continue
        left = min(left, budget // length)
        while left > 0 and not reach[budget]:
            n = min(power, left)
            step = n * length
            fresh = np.zeros(budget + 1, bool)
            fresh[step:] = reach[: budget + 1 - step]
            fresh &= ~reach
            came_by[fresh] = len(pieces)
            reach |= fresh
            pieces.append((i, n))
            left, power = left - n, power * 2
        if reach[budget]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, n = pieces[came_by[at]]
        taken[i] += n
        at -= n * int(lengths[i])
    return taken


def by_halves(lengths: np.ndarray, counts: np.ndarray, budget: int, most: int = HALF_SUMS) -> np.ndarray | None:
    """knapsack() for few documents of any length: all sums of each half of the lengths, of which there may be `most`, and the best that two of
    them make; None if there are more."""
    halves: list[list[int]] = [[], []]
    n = [1, 1]
    for i in np.argsort(-counts, kind="stable"):
        k = int(n[1] < n[0])
        c = min(int(counts[i]), budget // int(lengths[i])) if lengths[i] > 0 else 0
        if n[k] * (c + 1) > most:
            return None
        if c:
            halves[k].append(int(i))
            n[k] *= c + 1
    sums = []
    for own in halves:
        total = np.zeros(1, np.int64)
        for i in own:
            c = min(int(counts[i]), budget // int(lengths[i]))
            total = (total[:, None] + np.arange(c + 1, dtype=np.int64) * int(lengths[i])).ravel()
        sums.append(total)
    order = np.argsort(sums[1], kind="stable")
    ranked = sums[1][order]
    at = np.searchsorted(ranked, budget - sums[0], side="right") - 1
    both = np.where(at >= 0, sums[0] + ranked[np.maximum(at, 0)], -1)
    first = int(both.argmax())
    taken = np.zeros(len(lengths), np.int64)
    for own, left in zip(halves, (first, int(order[at[first]])), strict=True):
        for i in reversed(own):
            left, taken[i] = divmod(left, min(int(counts[i]), budget // int(lengths[i])) + 1)
    return taken


def exact(lengths: np.ndarray, counts: np.ndarray, budget: int, back_words: int = BACK_WORDS) -> np.ndarray | None:
    """How many of each length give the largest sum that is at most the budget, where that can be found: in units of the lengths' divisor, or by halves."""
    unit = math.gcd(*(int(x) for x in lengths[(counts > 0) & (lengths > 0)]))
    if unit and budget // unit <= back_words:
        return knapsack(lengths // unit, np.where(lengths % unit == 0, counts, 0), budget // unit)
    return by_halves(lengths, counts, budget)


def fit(lengths: np.ndarray, counts: np.ndarray, target: float, dp_words: int = DP_WORDS, back_words: int = BACK_WORDS) -> tuple[int, np.ndarray]:
    """How often a source is taken whole, and how many documents of each length once more."""
    total = int((lengths * counts).sum())
    extra = np.zeros(len(lengths), np.int64)
    if total == 0:
        return 0, extra
    goal = round(target)
    whole, rest = divmod(goal, total)
    budget = rest
    usable = np.where(lengths > 0, counts, 0)
    share = usable * (rest / total)
    extra = np.minimum(np.floor(share).astype(np.int64), usable)
    rest -= int((extra * lengths).sum())
    for i in np.argsort(-(share - extra), kind="stable"):
        if rest <= dp_words:
            break
        if extra[i] < usable[i] and 0 < lengths[i] <= rest:
            extra[i] += 1
            rest -= int(lengths[i])
    # whole documents of any length, the longest first, as long as dynamic programming would have too much to do
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= dp_words or lengths[i] <= 0:
            break
        n = min(int(usable[i] - extra[i]), rest // int(lengths[i]), max(1, (rest - dp_words // 2) // int(lengths[i])))
        extra[i] += n
        rest -= n * int(lengths[i])
    if 0 < rest <= dp_words:
        more = knapsack(lengths, usable - extra, rest)
        extra += more
        rest -= int((more * lengths).sum())
    if 0 < rest < back_words and extra.any():
        for i in np.argsort(-lengths, kind="stable"):
            n = min(int(extra[i]), (back_words - rest) // max(1, int(lengths[i])))
            extra[i] -= n
            rest += n * int(lengths[i])
        more = knapsack(lengths, usable - extra, rest)
        extra += more
        rest -= int((more * lengths).sum())
    if rest > 0 and (best := exact(lengths, usable, budget, back_words)) is not None and int((best * lengths).sum()) > budget - rest:
        extra = best
    return whole, extra


def _wrapped(docs: DataFrame) -> DataFrame:
    """The row as a struct beside what the mix needs of it, so that no name clashes."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").cast("long").alias("__size"))


def _hashed(rows: DataFrame, seed: int) -> DataFrame:
    """31 bits that order the rows of a source and length, and the whole hash; rows that differ in any column differ in it."""
    h = F.xxhash64(F.lit(seed), "__id", "__source", "__row")
    return rows.withColumns({"__h": F.shiftrightunsigned(h, 33), "__low": h})


def _places(some: DataFrame) -> DataFrame:
    """(source, size, extra, __h, __low, c, high): distinct hashes with the number of rows c that have them and the rank of the last. some has __bucket, which grows with
    the hash."""
    group = ["source", "size"]
    each = some.groupBy(*group, "extra", "__bucket", "__h", "__low").agg(F.count(F.lit(1)).alias("c"))
    by_bucket = each.groupBy(*group, "__bucket").agg(F.sum("c").alias("n"))
    below = by_bucket.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("__bucket").alias("b"), (F.sum("n").over(Window.partitionBy(*group).orderBy("__bucket")) - F.col("n")).alias("below"))
    both = each.join(below, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("__bucket") == F.col("b")))
    inside = F.sum("c").over(Window.partitionBy(*group, "__bucket").orderBy("__h", "__low"))
    return both.select(*group, "extra", "__h", "__low", "c", (F.col("below") + inside).alias("high"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """docs' columns with source_size, target and taken (words the mix takes of the row: its size times the copies). docs has doc_id,
    source and size (words); columns of docs that are named like these three are replaced.

    Documents are counted, planned and ranked on rows of (source, size, hash); of each source and length the last document that is
    taken once more is found, and the rows themselves meet only these few, so they are not shuffled. Rows that are equal to that last one
    may be taken in part; these alone are numbered."""
    with Scratch(docs.sparkSession) as scratch:
        narrow = stored(_hashed(_wrapped(docs), seed).drop("__row", "__id"), "mixing-sizes", few=True)
        lengths = stored(narrow.groupBy("__source", "__size").agg(F.count(F.lit(1)).alias("n")), "mixing-lengths", few=True)
        goal = targets(lengths.groupBy(F.col("__source").alias("source")).agg(F.sum(F.col("__size") * F.col("n")).alias("source_size")), weights, share, most)
        with_goal = lengths.join(goal, F.col("__source").eqNullSafe(F.col("source"))).select("source", F.col("__size").alias("size"), "n", "source_size", "target")

        def plan(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("size", kind="stable").reset_index(drop=True)
            whole, extra = fit(group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64), float(group["target"].iloc[0]))
            return group.assign(whole=whole, extra=extra)[["source", "size", "n", "source_size", "target", "whole", "extra"]]

        planned = stored(with_goal.groupBy("source").applyInPandas(plan, "source string, size bigint, n bigint, source_size bigint, target double, whole bigint, extra bigint"), "mixing-plan", few=True)
        same = F.col("__source").eqNullSafe(F.col("source")) & (F.col("__size") == F.col("size"))
        split = planned.filter("extra > 0 and extra < n").select("source", "size", "n", "extra")
        # hash dealt to as many buckets as the group's rows ask for, in order; of very large groups buckets grow with the root of the rows
        bucket = F.expr(f"cast(__h * least(ceil(n / {BUCKET_ROWS}.0), greatest(8192, cast(4 * sqrt(n) as bigint))) div 2147483648 as int)")
        some = narrow.join(split, same).withColumn("__bucket", bucket)
        # of the rows that are equal to the last one taken, `ties` of `of` are taken
        ties = _places(some).filter("extra > high - c and extra <= high")
        ties = ties.select(F.col("source").alias("s"), F.col("size").alias("z"), F.struct("__h", "__low").alias("last"), (F.col("extra") - F.col("high") + F.col("c")).alias("ties"), F.col("c").alias("of"))
        full = planned.filter("extra > 0").select("source", "size", "extra").join(ties, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left").drop("s", "z")
        full = scratch.keep(stored(full, "mixing-places", few=True))
        by_source = planned.groupBy(F.col("source").alias("__of")).agg(*[F.first(c).alias(c) for c in ("source_size", "target", "whole")])
        by_source = scratch.keep(stored(by_source, "mixing-sources", few=4))
        partial = full.filter("ties < of").limit(1).count() > 0
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_LENGTHS else df
    here = _hashed(_wrapped(docs), seed).join(few(by_source), F.col("__source").eqNullSafe(F.col("__of"))).join(few(full), same, "left")
    at = F.struct("__h", "__low")
    more = F.when(F.col("extra").isNull(), 0).when(F.col("last").isNull(), 1).when(at < F.col("last"), 1).when((at > F.col("last")) | (F.col("ties") < F.col("of")), 0).otherwise(1)
    cut = (F.col("ties") < F.col("of")) & at.eqNullSafe(F.col("last"))
    out = here.withColumn("__more", more.cast("long"))
    if partial:
        tied = with_row_numbers(here.filter(cut), "mixing-tied")
        at_all = sums_before(tied.select("__source", "__size", ROW, F.lit(1).cast("long").alias("__one")), [F.col("__source").asc_nulls_first(), F.col("__size").asc()], "__one", "__at")
        first = at_all.groupBy(F.col("__source").alias("s"), F.col("__size").alias("z")).agg(F.min("__at").alias("__first"))  # a row a source and length
        nth = at_all.join(first, F.col("__source").eqNullSafe(F.col("s")) & (F.col("__size") == F.col("z"))).select(ROW, (F.col("__at") - F.col("__first")).alias("__nth"))
        some = tied.join(nth, ROW).withColumn("__more", (F.col("__nth") < F.col("ties")).cast("long")).drop(ROW, "__nth")
        out = out.filter(~F.coalesce(cut, F.lit(False))).unionByName(some)
    own = [c for c in docs.columns if c not in ("source_size", "target", "taken")]
    taken = F.col("__size") * (F.col("whole") + F.col("__more"))
    return out.select(*[F.col("__row")[c].alias(c) for c in own], "source_size", "target", taken.alias("taken"))


def sized(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns that mix() needs, those of `carry`, and the word count as size."""
    return docs.select(*[c for c in dict.fromkeys(["doc_id", "source", *carry]) if c != "size"], word_count(F.col("text")).alias("size"))
