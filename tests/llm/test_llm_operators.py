"""Operators of sparkloom.llm on awkward rows, and against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import decontamination, language, licences, mixing, near_duplicates, personal_data, quality, secrets, sharding, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, size string, bucket int, kept string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def table(spark, empty=False):
    r = random.Random(3)
    prose = lambda n: " ".join(r.choice("the of and to in that near copy word long river stone light".split()) + str(r.randint(0, 99)) for _ in range(n))
    base = prose(200)
    near = " ".join([*base.split()[:195], "these", "few", "words", "are", "new"])
    texts = [None, "", "  \n\t", "one", "a b c", base, base, near, prose(3000), prose(40), "é𝄞 x@y.zz 1.2.3.4 +1 (555) 123-4567 token = \"abcdef123456ghijkl\"", "All rights reserved.", "x" * 50_000]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None][i % 3], 1, "x", 2, "y") for i, t in enumerate(texts)]
    rows += [rows[5], (None, base, "en", "s1", 1, "x", 2, "y")]
    return spark.createDataFrame([] if empty else rows, SCHEMA)


def bench(spark):
    return spark.createDataFrame([(1, "alpha beta gamma"), (2, None), (None, "a b c"), (3, " ".join(f"w{i}" for i in range(14)))], "item_id long, text string")


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_rows(spark, empty):
    d = table(spark, empty)
    rows = d.collect()
    n = len(rows)
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 0), (9, None, 0), (999, 1, 0)], LABELS)
    of = lambda df, *cols: sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    by_text = lambda f: sorted(((r["doc_id"], *f(r["text"])) for r in rows), key=repr)
    judged = quality.quality(d, labels)
    assert of(judged, "doc_id", "n_words", "base_failed") == by_text(lambda t: (len(words(t)), len(words(t)) < 20))
    assert of(judged, "doc_id", "kept", "bucket", "size") == by_text(lambda t: (len(words(t)) >= 20, 2, "x"))
    private = personal_data.personal_data(d, n_examples=600)
    assert of(private, "doc_id", "n_email", "n_ip", "n_card", "n_phone") == by_text(lambda t: (1, 1, 0, 1) if t and "@" in t else (0, 0, 0, 0))
    assert of(licences.licences(d), "doc_id", "licence", "n_matches") == by_text(lambda t: ("Proprietary", 1) if t and "rights" in t else (None, 0))
    assert of(secrets.secrets(d), "doc_id", "n_assign", "n_access", "n_hex") == by_text(lambda t: (int(bool(t and "token =" in t)), 0, 0))
    told = language.identify(d)
    assert of(told.filter("lang_pred = 'und'"), "doc_id", "score") == sorted(((r["doc_id"], 0.0) for r in rows if not any(c.isalpha() for c in r["text"] or "")), key=repr) and told.count() == n
    for limit in (1000, 0):
        clean = decontamination.decontaminate(d, bench(spark), broadcast_windows=limit)
        assert of(clean, "doc_id", "n_hit", "contaminated") == by_text(lambda t: (0, False))
    s = sharding.shard(d, 4).collect()
    assert len(s) == n and (empty or max(Counter(r["shard"] for r in s).values()) - min(Counter(r["shard"] for r in s).values()) <= 1)
    m = mixing.mix(mixing.sized(d, [])).collect()
    assert len(m) == n and all(0 <= r["taken"] <= 2 * r["size"] for r in m)
    near = near_duplicates.near_duplicates(d, 4).collect()
    assert len(near) == n
    if not empty:
        by = {r["doc_id"]: r for r in near}
        assert by[5]["component_id"] == by[6]["component_id"] == by[7]["component_id"] == 5
        assert by[None]["component_id"] is None and by[None]["kept"] and by[0]["component_id"] == 0 and by[0]["n_shingles"] == 0


def test_decontamination_both_ways(spark):
    items = bench(spark).collect()
    rows = [(0, "x " + " ".join(f"W{i}" for i in range(2, 13)) + " y"), (1, "so ALPHA, beta-gamma!"), (2, " ".join(f"w{i}" for i in range(9))), (3, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    want = {}
    for i, t in rows:
        w, hit, ids = cut(t), set(), set()
        for item in items:
            v = cut(item["text"])
            if item["item_id"] is None or not v:
                continue
            k = min(10, len(v))
            grams = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in grams:
                    hit |= set(range(j, j + k))
                    ids.add(item["item_id"])
        want[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit))
    for limit in (1000, 0):
        got = {r["doc_id"]: tuple(r)[1:] for r in decontamination.decontaminate(d, bench(spark), broadcast_windows=limit).collect()}
        assert got == want


def test_repeated_words(spark):
    texts = ["a b c d e f g h a b c d e f g h", "a " * 30, "a b c", " ".join(map(str, range(30))) + " 3 4 5 6 7 8 9 10"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.features(d).collect():
        w = words(r["text"])
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        assert r["n_repeat_words"] == len({j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})


def test_binomial_tail(spark):
    from math import comb

    rows = [(n, k) for n in (10, 300, 5000) for k in (0, 1, 4) if k < n * 0.02] + [(10, 9)]
    for r in spark.createDataFrame(rows, "n long, k long").select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), 0.02).alias("p")).collect():
        exact = sum(comb(r["n"], i) * 0.02**i * 0.98 ** (r["n"] - i) for i in range(r["k"] + 1)) if r["k"] < r["n"] * 0.02 else 1.0
        assert abs(r["p"] - exact) <= 1e-9 + 1e-6 * exact


def test_knapsack():
    import numpy as np

    r = random.Random(1)
    for _ in range(60):
        lengths = np.array(sorted(r.sample(range(1, 30), 4)))
        counts = np.array([r.randint(0, 4) for _ in lengths])
        budget = r.randint(0, 90)
        sums = {0}
        for a, n in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + a * k for s in sums for k in range(n + 1)}
        got = mixing.knapsack(lengths, counts, budget)
        assert (got <= counts).all() and int((got * lengths).sum()) == max(s for s in sums if s <= budget)


def test_fit_gives_documents_back():
    import numpy as np

    lengths = np.array([30_000, 50_000, 70_000])
    whole, extra = mixing.fit(lengths, np.array([1, 1, 1]), 100_000.0)
    assert whole == 0 and extra.tolist() == [1, 0, 1]


def test_entropy(spark):
    from math import log2

    texts = ["Zx9kLm2Qp7Rt5Vw1Bn8Hc3Jf6Ds4Ga0Yu", "ab1" * 12]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in d.select("t", secrets.best_entropy(F.col("t"), secrets.WIDE_ALPHABET).alias("h")).collect():
        best = max(-sum(n / 20 * log2(n / 20) for n in Counter(r["t"][i : i + 20]).values()) for i in range(len(r["t"]) - 19))
        assert abs(r["h"] - best) < 1e-9


def test_spelled_out_addresses():
    models, limits = personal_data.trained()
    spans = lambda text: [text[a:b] for a, k, b in personal_data.spans_of(text, personal_data.base_spans(text), models, limits) if k == 0]
    for form in ("jane.roe at example.com", "jane.roe at example [dot] com", "jane.roe at example (dot) com", "jane.roe [at] example.com", "jane.roe at example dot com", "jane.roe at mail.example.co.uk"):
        for text in (f"Please write to {form} today.", f"You can reach me at {form}. Then wait.", form):
            assert spans(text) == [form]
    for text in ("We met at noon. Then we left.", "Look at this. It is new.", "The train stops at 10.30 and at the station. He waits.", "See more at noon. Call us."):
        assert personal_data.candidates(text) and spans(text) == []


def test_pipeline_rows_without_or_with_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    d = table(spark)
    base, other = d.filter("doc_id = 5").first()["text"], " ".join(f"other{i}" for i in range(60))
    rows = [(None, base), (None, base), (7, base), (7, base + " end"), (7, other), (3, None), (None, ""), (None, ""), (None, "x " + other), (9, other), (1, "alpha beta gamma"), (1, "clean words"), (None, "alpha beta gamma"), (None, "lonely row")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    near = sorted(corpus_pipeline.near_duplicate_stage(spark, d, "").collect(), key=repr)
    assert [(r["doc_id"], r["text"]) for r in near if r["text"] == base or r["text"] == base + " end"] in ([(7, base)], [(7, base + " end")])
    rest = [r for r in near if r["text"] not in (base, base + " end")]
    assert sorted(map(tuple, rest), key=repr) == sorted([(7, other), (3, None), (None, ""), (None, ""), (1, "alpha beta gamma"), (1, "clean words"), (None, "lonely row")], key=repr)
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.decontamination_stage(spark, d, str(tmp_path)).collect()
    assert sorted(map(tuple, clean), key=repr) == sorted((r for r in rows if r[1] != "alpha beta gamma"), key=repr)


def test_secrets_beside_allowed_parts(spark):
    key, r = "Zx9kLm2Qp7Rt5Vw1Bn8Hc3Jf6Ds4Ga0Yu", random.Random(4)
    alphabet = secrets.WIDE_ALPHABET[:62]
    blob = "b3BlbnNzaC1rZXktdjEAAAAABG5vbmUAAAAEbm9uZQAAAAAAAAAB" + "".join(r.choice(alphabet) for _ in range(200))
    found = [f"io/sample/{key}", f"{key}/example", blob, f"1234567890{key}", f"{'x' * 9}{key}", key]
    none = ["your_sample_1_placeholder_2_example", f"{key[:17]}example{key[:17]}", "example1" * 4, "abcdefghij0123456789abcdefghij", "0f" * 3 + "0" * 30, "word/and/word/without/digits", "123e4567-e89b-12d3-a456-426614174000"]
    d = spark.createDataFrame(list(enumerate(found + none)), "doc_id long, text string")
    got = {x["doc_id"]: [(y["start"], y["end"]) for y in x["found"] if y["kind"] == "entropy"] for x in secrets.secrets(d).collect()}
    assert got == {i: [(0, len(t))] if i < len(found) else [] for i, t in enumerate(found + none)}


def wrapped(text, mark, width=72):
    import textwrap

    return "\n".join(f"{mark} {x}".rstrip() for x in textwrap.wrap(text, width - len(mark) - 1))


def test_wrapped_and_embedded_licences(spark):
    mit = [text for name, text in licences.TEMPLATES if name == "MIT" and len(text) > 80]
    gpl = "This work is licensed under the GNU General\nPublic License, version 3."
    prose = "Stones lie in the river and the light is long, so that nobody knows where it ends or when"
    texts = [
        "/*\n * Copyright 2020 Jane\n *\n" + "\n *\n".join(wrapped(x, " *") for x in mit) + "\n */\nint main() { return 0; }",
        "/*\n * Copyright 2020 Jane\n" + "\n".join(wrapped(x, " *") for x in mit) + "\n */\nint main() { return 0; }",
        f"{prose}. {gpl} {prose}.",
        f"{prose}\n{prose} note that {gpl[:-1]} and {prose}",
        f"{prose}. The licence of the river is public and general. {prose}",
        "Released under the MIT License.",
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.licences(d).collect()}
    assert [(got[i]["licence"], got[i]["dice"]) for i in range(6)] == [("MIT", 1.0), ("MIT", 1.0), ("GPL-3.0", 1.0), ("GPL-3.0", 1.0), (None, None), ("MIT", 1.0)]
    assert [got[i]["n_matches"] for i in (0, 1, 2, 3, 5)] == [3, 3, 1, 1, 1]


def test_licences_told_apart(spark):
    gnu = lambda what, name, version: f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    names = "Neither the name of Stone Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    rows = [
        ("GPL-2.0", gnu("program", "General Public License", "2")),
        ("GPL-3.0", gnu("program", "General Public License", "3")),
        ("LGPL-2.1", gnu("library", "Lesser General Public License", "2.1")),
        ("LGPL-3.0", gnu("library", "Lesser General Public License", "3")),
        ("AGPL-3.0", gnu("program", "Affero General Public License", "3")),
        ("BSD-2-Clause", bsd),
        ("BSD-3-Clause", f"{bsd}\n\n{names}"),
        ("GPL-2.0", "This river is licensed under the GNU General Public License, version 2."),
        ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
        ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ]
    d = spark.createDataFrame([(i, x[1]) for i, x in enumerate(rows)] + [(100 + i, wrapped(x[1], " *", 60)) for i, x in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["licence"] for r in licences.licences(d).collect()}
    assert [got[i] for i in range(len(rows))] == [x[0] for x in rows]
    assert [got[100 + i] for i in range(len(rows))] == [x[0] for x in rows]


def test_archives_round_trip(spark):
    big = "<p>é" * 400
    rows = [(1, "http://a/\r\nx", big), (2, None, big), (3, "", None), (None, "u", big), (4, "http://b", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"), (5, "c", "short"), (6, "c", "short")]
    out = {r["page_id"]: r for r in warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: out[i]["record_type"] for i in out} == {1: "revisit", 2: "response", 3: "response", None: "revisit", 4: "response", 5: "response", 6: "response"}
    assert out[1]["refers_to"] == 2 and out[3]["payload_bytes"] == 0
    for i, _, html in rows:
        assert out[i]["payload_digest"] == hashlib.sha1((html or "").encode()).hexdigest()
        assert out[i]["html"] == (html or "") or out[i]["record_type"] == "revisit"
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.identify(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
