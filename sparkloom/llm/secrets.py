"""Secret scans, DataFrame functions only: fixed patterns, and sliding-window entropy of candidate strings.

A candidate is a run of at least `window` characters of one class alphabet (the narrowest that fits: hex digits, else
letters, digits and + / _ -). A window of `window` characters slides over it; the number of each character in the window is
updated for the character that enters and the one that leaves, and so is the sum of n * log2(n), from which the
window's Shannon entropy follows. A candidate whose best window reaches its class's threshold is a span of kind `entropy`,
unless the allow-list knows all of it; windows that touch a placeholder word, a run of one character or a counting sequence do
not count, the others of the candidate do. Fixed patterns give the kinds `assign`, `access` and `hex`, which the allow-list never touches.

Offsets are code points, ends exclusive. Defined results: a null or empty text has no spans; their digest is that of the
empty string. Work is linear in the text; a text's spans are one array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = "(?:(?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_HINT = "(?i:password|passwd|secret|token|api_?key)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"
WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_-]{{{WINDOW},}}"
#: The class alphabets and the bits that a window of 20 characters must reach.
HEX_ALPHABET, HEX_BITS = "0123456789abcdef", 2.9
WIDE_ALPHABET, WIDE_BITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.7
#: Candidates that match one of these are no secrets: words and identifiers without a digit, numbers, UUIDs.
ALLOWED = (
    "^[A-Za-z+/_-]+$",
    "^[0-9+/_-]+$",
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
)
#: Parts of candidates whose windows do not count: placeholders, counting sequences and runs of one character.
PASSED = "(?i:example|sample|dummy|placeholder|changeme|your[_-])|0123456789|1234567890|(?i:abcdefghij)|(.)\\1{5,}"


def bound(value: Column, body) -> Column:
    """body(x) with x evaluated once."""
    return F.transform(F.array(value), body)[0]


def running(sizes: Column, chunk: int = 64, levels: int = 3) -> Column:
    """Running sums of an array of numbers. An array that grows is copied with every element, so it grows to `chunk` elements only: sums are
    taken within chunks, over the chunks' sums in the same way, and added up. Linear for up to chunk ** levels elements."""
    last = lambda s: F.coalesce(F.element_at(s, -1), F.lit(0).cast("long"))
    plain = lambda c: F.aggregate(c, F.array().cast("array<bigint>"), lambda acc, x: F.array_append(acc, F.when(F.size(acc) > 0, last(acc)).otherwise(F.lit(0).cast("long")) + x))
    if levels == 1:
        return plain(sizes)

    def summed(parts: Column) -> Column:
        ends = running(F.transform(parts, last), chunk, levels - 1)
        return bound(ends, lambda e: F.flatten(F.zip_with(parts, e, lambda c, end: F.transform(c, lambda x: x + end - last(c)))))

    cut = lambda s: F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.size(s) - 1) / chunk)), lambda k: plain(F.slice(s, (k * chunk + 1).cast("int"), F.lit(chunk))))
    return bound(sizes, lambda s: F.when(F.size(s) <= chunk, plain(s)).otherwise(bound(cut(s), summed)))


def matches(text: Column, pattern: str, hint: str | None = None) -> Column:
    """Array of (start, end, m), leftmost non-overlapping matches by code points: the gaps between them are the split's parts."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,m:string>>")

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        ends = running(F.zip_with(gaps, found, lambda g, m: (F.char_length(g) + F.char_length(m)).cast("long")))
        return F.zip_with(ends, found, lambda e, m: F.struct((e - F.char_length(m)).alias("start"), e.alias("end"), m.alias("m")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(hint or pattern), bound(found, placed)).otherwise(none)


def best_entropy(candidate: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The greatest Shannon entropy (bits) of any window of the candidate, by incremental counts: a character for each of the alphabet's, whose
    code is the count from "0" on; a step writes the two that change."""
    codes = F.transform(F.split(candidate, ""), lambda c: F.position(c, F.lit(alphabet)))
    leaving = lambda c: F.concat(F.array_repeat(F.lit(0), window), c)
    f = F.array(*[F.lit(n * math.log2(n) if n > 1 else 0.0) for n in range(window + 2)])
    count = lambda n, at: F.ascii(F.substring(n, at, 1)) - 48

    def slide(c: Column) -> Column:
        steps = F.zip_with(c, F.slice(leaving(c), 1, F.size(c)), lambda a, b: F.struct(a.alias("enters"), b.alias("leaves")))
        start = F.struct(F.lit("0" * len(alphabet)).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("i"), F.lit(0.0).alias("best"))

        def step(acc: Column, x: Column) -> Column:
            enters, leaves, n = x["enters"], x["leaves"], acc["n"]
            had = count(n, enters)
            left = F.when(leaves > 0, count(n, leaves) + F.when(leaves == enters, 1).otherwise(0)).otherwise(F.lit(0))
            s = acc["s"] - F.get(f, had) + F.get(f, had + 1) - F.get(f, left) + F.get(f, F.greatest(left - 1, F.lit(0)))
            less = F.when((leaves > 0) & (leaves != enters), F.overlay(n, F.char(left + 47), leaves, F.lit(1))).otherwise(n)
            now = F.when(leaves == enters, n).otherwise(F.overlay(less, F.char(had + 49), enters, F.lit(1)))
            bits = F.lit(math.log2(window)) - s / window
            return F.struct(now.alias("n"), s.alias("s"), (acc["i"] + 1).alias("i"), F.when(acc["i"] + 1 >= window, F.greatest(acc["best"], bits)).otherwise(acc["best"]).alias("best"))

        return F.aggregate(steps, start, step, lambda acc: acc["best"])

    return bound(codes, slide)


def is_entropic(candidate: Column) -> Column:
    is_hex = candidate.rlike("^[0-9a-fA-F]+$")
    allowed = candidate.rlike("|".join(f"(?:{p})" for p in ALLOWED))
    parts = F.filter(F.split(candidate, PASSED, -1), lambda x: F.char_length(x) >= WINDOW)
    reaches = lambda x: F.when(is_hex, best_entropy(F.lower(x), HEX_ALPHABET) >= HEX_BITS).otherwise(best_entropy(x, WIDE_ALPHABET) >= WIDE_BITS)
    return F.when(allowed, F.lit(False)).otherwise(F.exists(parts, reaches))


def secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_entropy, found: array of (start, end, kind, m) by start, then kind in the order
    of KINDS."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", text.alias("text"))
    t = F.col("text")
    ranked = lambda array, k: F.transform(array, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("rank"), x["end"].alias("end"), x["m"].alias("m")))
    by = own.select(
        "doc_id",
        F.filter(matches(t, ASSIGN, ASSIGN_HINT), lambda x: F.char_length(F.regexp_extract(x["m"], ASSIGN, 1)) >= 12).alias("assign"),
        F.filter(matches(t, ACCESS), lambda x: F.char_length(x["m"]) >= 18).alias("access"),
        matches(t, HEX).alias("hex"),
        F.filter(matches(t, CANDIDATE), lambda x: is_entropic(x["m"])).alias("entropy"),
    )
    spans = F.sort_array(F.concat(*[ranked(F.col(k), i) for i, k in enumerate(KINDS)]))
    name = F.array(*map(F.lit, KINDS))
    found = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.get(name, x["rank"]).alias("kind"), x["m"].alias("m")))
    return by.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], found.alias("found"))


def joined(found: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined."""
    own = F.filter(found, lambda x: x["kind"].isin(*kinds)) if kinds else found
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
