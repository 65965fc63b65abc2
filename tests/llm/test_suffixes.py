"""Repeated windows against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import suffixes

SCHEMA = "doc_id long, text string, lang string, spans int, kept string, piece string"


def plain(rows, threshold):
    """(doc_id, n_bytes, spans, kept) by looking at every window."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in raw:
        if i is not None:
            for k in range(len(b) - threshold + 1):
                w = b[k : k + threshold]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        if i is not None:
            for k in range(len(b) - threshold + 1):
                if least[b[k : k + threshold]] < i:
                    gone[k : k + threshold] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int))).tolist()
        spans = list(zip(edges[::2], edges[1::2], strict=True))
        out.append((i, len(b), spans, bytes(b[k] for k in range(len(b)) if not gone[k])))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in df.collect()), key=repr)


def rows_of(seed, letters="ab c", n=40, unit=30):
    """Texts put together from few pieces, so that they share windows of all lengths, at all places."""
    r = random.Random(seed)
    word = lambda k: "".join(r.choice(letters) for _ in range(k))
    pieces = [word(r.randint(1, 3 * unit)) for _ in range(12)]
    texts = ["".join(r.choice(pieces) if r.random() < 0.7 else word(r.randint(1, unit)) for _ in range(r.randint(0, 8))) for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(texts)]
    long = "".join(pieces)
    rows += [(n, None), (n + 1, ""), (None, long), (None, long), (3, long), (3, rows[3][1]), (3, rows[3][1]), (-5, rows[2][1]), (n + 2, long), (n + 3, long), (n + 4, long + "é𝄞" * 20), (n + 5, "x" + long), (n + 6, "a" * 500), (n + 7, "a" * 499)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("threshold,letters", [(50, "ab c"), (50, "abcdefgh é"), (7, "abcdefgh ")])
@pytest.mark.parametrize("most", [16_000_000, 0])
def test_windows(spark, threshold, letters, most, monkeypatch):
    rows = rows_of(threshold, letters)
    monkeypatch.setattr(suffixes, "BLOCK", 97)
    d = spark.createDataFrame([(i, t, "en", 1, "k", "p") for i, t in rows], SCHEMA).repartition(5)
    assert found(suffixes.repeats(d, threshold, most=most)) == plain(rows, threshold)


@pytest.mark.parametrize("tables", [1, 3])
def test_more_grams_than_a_table_holds(spark, tables, monkeypatch):
    """Runs are told apart where the texts are read, however many grams there are: no run is shuffled for it, few come by mistake and none is lost."""
    monkeypatch.setattr(suffixes, "CHUNK", 4, raising=False)
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = [word(300) for _ in range(20)]
    texts = [r.choice(shared) + word(600) for _ in range(80)]
    d = spark.createDataFrame([(i, i, t.encode()) for i, t in enumerate(texts)], "doc_id long, h long, bytes binary")
    grams = suffixes.stored(suffixes.shared_grams(d, 50), "grams")
    known = {g["gram"] for g in grams.collect()}
    runs = suffixes.occurrences(d, grams, 50, most=-(-len(known) // tables))
    assert "Exchange" not in runs._jdf.queryExecution().executedPlan().toString()
    place = lambda df: sorted((x["doc_id"], x["start"], x["n"], x["left"], bytes(x["piece"])) for x in df.collect())
    everything = suffixes.occurrences(d, grams, 50, most=0)
    right = place(everything.filter(F.col("gram").isin(*known)))
    assert right and place(runs.filter(F.col("gram").isin(*known))) == right

    def all_runs(batches):
        for batch in batches:
            for data, ends, _, _ in suffixes._blocks(batch.column("bytes"), 50):
                yield pa.RecordBatch.from_arrays([pa.array(suffixes.runs(data, ends, 50)[4])], ["gram"])

    wrong, others = (x.filter(~F.col("gram").isin(*known)).count() for x in (runs, d.select("doc_id", "h", "bytes").mapInArrow(all_runs, "gram long")))
    assert others > 2000 and wrong < 0.15 * others


@pytest.mark.parametrize("threshold", [1, 2, 3, 20])
def test_short_windows(spark, threshold):
    rows = rows_of(threshold, "abcdefghijklmnopqrstuvwxyz 0123456789", 8, 4)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(suffixes.repeats(d, threshold)) == plain(rows, threshold)


def test_copies_with_edits(spark):
    """Near copies of one text, each with a letter changed somewhere, and a passage that all of them share."""
    r = random.Random(8)
    base = " ".join(f"w{r.randint(0, 400)}" for _ in range(120))
    rows = [(0, base)]
    for i in range(1, 30):
        k = r.randrange(len(base))
        rows.append((i, base[:k] + r.choice("XYZ") + base[k + r.randint(0, 2) :]))
    rows += [(100 + i, f"{r.random()} {base[40:160]} {r.random()}") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert found(suffixes.repeats(d)) == plain(rows, 50)


def test_other_columns_and_empty_tables(spark):
    rows = rows_of(4, n=6)
    d = spark.createDataFrame([(i, t, "en", 1, "k", "p") for i, t in rows], SCHEMA)
    out = suffixes.repeats(d, carry=["doc_id", "lang", "piece", "spans"])
    assert out.columns == ["doc_id", "lang", "piece", "n_bytes", "spans", "kept"] and {r["lang"] for r in out.collect()} == {"en"} and out.count() == len(rows)
    assert suffixes.repeats(d.limit(0)).collect() == [] and suffixes.repeats(d.filter("doc_id is null")).count() == 2
    named = d.select(F.concat(F.lit("id"), F.lpad(F.coalesce(F.col("doc_id"), F.lit(0)).cast("string"), 3, "0")).alias("name"), F.col("text").alias("body"))
    want = plain([(r["name"], r["body"]) for r in named.collect()], 50)
    got = suffixes.repeats(named, id_col="name", text="body").withColumnRenamed("name", "doc_id")
    assert found(got) == want
    with pytest.raises(ValueError):
        suffixes.repeats(d, 0)


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(3)
    for threshold in (1, 2, 5, 50):
        pieces = [r.integers(97, 100, n).astype(np.uint8) for n in (threshold, 300, threshold + 1, 120)]
        pieces.append(pieces[1][10:200].copy() if threshold < 100 else pieces[1])
        data, ends = np.concatenate(pieces), np.cumsum([len(p) for p in pieces])
        piece, first, n, left, gram = suffixes.runs(data, ends, threshold)
        by = {}
        for p, i, k, a, g in zip(piece, first, n, left, gram, strict=True):
            for j in range(k):
                low = ends[p] - len(pieces[p])
                assert low <= i + j and i + j + threshold <= ends[p] and 0 <= a - j < suffixes.halves(threshold)
                by.setdefault(data[i + j : i + j + threshold].tobytes(), set()).add((a - j, g))
        assert all(len(x) == 1 for x in by.values()) and n.sum() == sum(len(p) - threshold + 1 for p in pieces)
