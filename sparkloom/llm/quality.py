"""Risk-controlled quality rules, DataFrame functions only.

Every text gets a badness score from 0 to 1: the greatest of its rules' values, each divided by a fixed scale. A stratum
(a language) gets the lowest cutoff whose false rejections are proven rare on its labelled holdout. The labels have no
part in the score, so all labelled rows are holdout. For a cutoff t, of n good holdout rows k score above t; the exact
binomial test rejects "a good row is lost with probability over `risk`" when P(Bin(n, risk) <= k) <= level. The
cutoffs of a stratum are tested in a fixed order, from the highest (which loses least) downwards, and testing stops at
the first that fails, so they share one level; the strata share `error` by Bonferroni's correction. With probability
1 - error, no stratum loses more than `risk` of its good rows by its cutoff. A stratum whose labels prove nothing keeps
all rows that pass the base rules.

Defined results: a null or empty text has no words and fails the base rules. Null strata are a stratum. A document
labelled more than once counts as good if any label says so. Labels without a document, or with a null, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_table, possible, stored, words

RISK, ERROR = 0.02, 0.1
#: Scores and cutoffs go in steps of a hundredth.
STEPS = 100
#: Texts up to this score are clean by definition: no lower cutoff is tried.
FLOOR = 15
#: The rules and the value of each that scores 1.
SCALES = {"symbol_ratio": 0.25, "dup_line_ratio": 1.0, "repeat_ratio": 1.0, "upper_ratio": 1.0, "mark_ratio": 0.5}
SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 8


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of `window` words that the list has twice or more.

    Windows are compared by 64-bit hashes. Lists without a repeat need one hash set; others sort (hash, position), so
    the work stays n log n however often a window repeats."""
    n = F.size(w)

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, n - (window - 1)), lambda _, i: F.xxhash64(*[F.get(h, i + j) for j in range(window)]))

    def marked(s: Column) -> Column:
        same = lambda a, b: F.get(s, a)["h"].eqNullSafe(F.get(s, b)["h"])
        twice = F.filter(F.transform(s, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"])), lambda x: x.isNotNull())
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(window), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(F.sort_array(twice), F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")), step, lambda acc: acc["n"])

    def counted(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bound(by_hash, marked))

    return F.when(n >= window, bound(bound(F.transform(w, lambda x: F.xxhash64(x)), windows), counted)).otherwise(F.lit(0))


def bound(value: Column, body) -> Column:
    """body(x) with x evaluated once: a lambda over an array of one."""
    return F.transform(F.array(value), body)[0]


def features(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the rules' values (double)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    kept = lambda pattern: F.char_length(F.regexp_replace(text, pattern, "")).cast("long")
    step = docs.withColumns({"__w": words(F.col("text")), "__lines": lines})
    step = step.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.char_length(F.array_join("__w", "")).cast("long"),
            "n_symbols": kept(SYMBOLS),
            "__upper": kept("[^\\p{Lu}]+"),
            "__marks": kept("[^!?]+"),
            "__n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("__w")).cast("long"),
        }
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    rules = {"symbol_ratio": ratio("n_symbols", "word_chars"), "dup_line_ratio": ratio("n_dup_lines", "__n_lines"), "repeat_ratio": ratio("n_repeat_words", "n_words"), "upper_ratio": ratio("__upper", "word_chars"), "mark_ratio": ratio("__marks", "word_chars")}
    return step.withColumns(rules).drop("__w", "__lines", "__upper", "__marks", "__n_lines")


def scored(docs: DataFrame) -> DataFrame:
    """features() and the badness score, in steps of 1 / STEPS (a whole number, rounded down)."""
    worst = F.greatest(*[F.least(F.lit(1.0), F.col(c) / s) for c, s in SCALES.items()])
    return features(docs).withColumn("badness", F.floor(worst * STEPS + 1e-9).cast("int")).drop(*SCALES)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact up to rounding: terms from k downwards, each from the one before, in logarithms. 1 where k >= n * p,
    which no level below one half admits."""
    lp, lq = F.log(F.lit(p)), F.log(F.lit(1 - p))
    first = F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda acc, i: acc + F.when(i > 0, F.log((n - i + 1) / i)).otherwise(F.lit(0.0))) + k * lp + (n - k) * lq
    down = lambda acc, i: F.struct((acc["s"] + acc["t"]).alias("s"), (acc["t"] * (k - i) / (n - k + i + 1) * F.lit((1 - p) / p)).alias("t"))
    total = F.aggregate(F.sequence(F.lit(0), k), F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")), down, lambda acc: acc["s"])
    return F.when(k < n * p, F.exp(first) * total).otherwise(F.lit(1.0))


def cutoffs(holdout: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, cutoff, n_good, n_lost) for a table of (stratum, badness, good): rows with badness over the cutoff go.

    Counts per (stratum, badness) are at most STEPS + 1 a stratum; all that follows is on these. Strata without a proven cutoff
    are left out."""
    counts = holdout.groupBy("stratum", "badness").agg(F.sum(F.col("good").cast("long")).alias("good"))
    wide = counts.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("badness", "good"))).alias("by"), F.sum("good").alias("n_good"))
    strata = wide.withColumn("n_strata", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    above = lambda t: F.aggregate(F.map_entries("by"), F.lit(0).cast("long"), lambda acc, e: acc + F.when(e["key"] > t, e["value"]).otherwise(F.lit(0).cast("long")))
    grid = strata.select("stratum", "n_good", "n_strata", F.explode(F.transform(F.sequence(F.lit(FLOOR), F.lit(STEPS - 1)), lambda t: F.struct(t.alias("cutoff"), above(t).alias("n_lost")))).alias("x")).select("stratum", "n_good", "n_strata", "x.*")
    tested = grid.withColumn("passes", binomial_tail(F.col("n_good"), F.col("n_lost"), risk) <= F.lit(error) / F.col("n_strata"))
    in_order = tested.withColumn("sound", F.min("passes").over(Window.partitionBy("stratum").orderBy(F.desc("cutoff"))))
    return in_order.filter("sound").groupBy("stratum").agg(F.min(F.struct("cutoff", "n_good", "n_lost")).alias("m")).select("stratum", "m.*")


def scores(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Narrow rows: doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, badness."""
    return scored(docs.select("doc_id", F.col(stratum).alias("stratum"), F.col("text").cast("string").alias("text"))).drop("text")


def good_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents that a label calls good, once each, with the column good. labels: doc_id, quality (1 good, 0 bad)."""
    return labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") > 0).alias("good")).filter("good")


def limits(scored_rows: DataFrame, good: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, cutoff) from scores() of all rows with an id in good_ids(), and any others; stored, so that its size is known before a join."""
    holdout = scored_rows.select("doc_id", "stratum", "badness").join(good, "doc_id")
    return stored(cutoffs(holdout, risk, error).select("stratum", "cutoff"), "quality-cutoffs", few=4)


def judged(scored_rows: DataFrame, cutoff: DataFrame) -> DataFrame:
    """Adds cutoff, base_failed and kept to rows with stratum and the columns of scores(). A stratum's cutoff is one row, few in all: they are
    broadcast up to 100,000 strata."""
    near = F.broadcast(cutoff) if cutoff.count() <= 100_000 else cutoff
    out = scored_rows.join(near.withColumnRenamed("stratum", "__of"), F.col("stratum").eqNullSafe(F.col("__of")), "left").drop("__of")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("cutoff").isNull() | (F.col("badness") <= F.col("cutoff"))))


#: What quality() adds.
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "badness", "cutoff", "base_failed", "kept")


def quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The documents' columns and ADDED (cutoff null: none proven). `labels` has doc_id and quality (1 good, 0 bad). Columns of docs that
    are named like ADDED are replaced, all others stay as they are. Rows are neither stored nor shuffled: the cutoffs come from scores of those that
    are labelled good, and all are scored when they are judged."""
    good = stored(good_ids(labels), "quality-good", few=True)
    found = limits(scores(possible(docs, "doc_id", bit_table(good, "doc_id")).filter("__possible"), stratum), good, risk, error)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), F.col(stratum).alias("stratum"), F.col("text").cast("string").alias("text"))
    out = judged(scored(rows).drop("text"), found)
    return out.select(*[F.col("__row")[c].alias(c) for c in docs.columns if c not in ADDED], *ADDED)
