"""The queries op1_ to op10_ and the pipeline's stages over whole small tables, each against a plain brute-force version."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from sparkloom.llm import queries

SF = "/root/testdata/sf0.001"
SPACED, BENCH_WORD = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def rows_of(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r for r in rows_of("documents")}


@pytest.fixture
def result(spark):
    return lambda n: [r.asDict() for r in next(q for k, q in queries.queries().items() if k.startswith(f"op{n}_"))(spark, SF).collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_spans(text, kinds):
    found = [(m.start(), i, m.end(), k) for i, (k, pattern, good) in enumerate(kinds) for m in pattern.finditer(text) if good(m)]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m[0])


PRIVATE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(digits(m)) <= 15),
)
SECRET = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)


def shingles(text, k):
    w = SPACED.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def components(texts, k):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def hits(text, items):
    """Number of words, hit positions and items with an occurring window."""
    w = BENCH_WORD.findall((text or "").translate(FOLD))
    where = defaultdict(list)
    for k in {k for k, _ in items.values()}:
        for i in range(len(w) - k + 1):
            where[tuple(w[i : i + k])].append(i)
    hit, ids = set(), set()
    for item, (k, windows) in items.items():
        for g in windows & where.keys():
            ids.add(item)
            hit.update(p for i in where[g] for p in range(i, i + k))
    return len(w), hit, ids


@pytest.fixture(scope="module")
def items():
    out = {}
    for r in rows_of("benchmark"):
        w = BENCH_WORD.findall((r["text"] or "").translate(FOLD))
        if w:
            k = min(10, len(w))
            out[r["item_id"]] = (k, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    return out


def test_quality(result, docs):
    got = result(1)
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        text = docs[r["doc_id"]]["text"] or ""
        w = SPACED.findall(text)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeated = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * len(repeated) > 30 * len(w))
        assert r["kept"] == (not r["base_failed"] and (r["cutoff"] is None or r["badness"] <= r["cutoff"]))


@pytest.mark.parametrize(("n", "kinds"), [(2, PRIVATE), (8, SECRET)])
def test_spans(result, docs, n, kinds):
    got = result(n)
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        want = base_spans(docs[r["doc_id"]]["text"] or "", kinds)
        assert r["base_sha256"] == sha(",".join(want))
        assert [r[f"n_{k}"] for k, _, _ in kinds] == [sum(x.startswith(f"{k}:") for x in want) for k, _, _ in kinds]
        assert set(want) <= set(r["spans"].split(","))


def test_shards(result, docs):
    got = result(3)
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    slots = defaultdict(list)
    for r in got:
        text = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 16, zlib.crc32(text), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[i]) for i in range(40)]
    assert max(counts) - min(counts) <= 1


def test_near_duplicates(result, docs):
    want = components({i: r["text"] for i, r in docs.items()}, 4)
    got = {r["doc_id"]: r for r in result(4)}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_mix(result, docs):
    size = {i: len(SPACED.findall(r["text"] or "")) for i, r in docs.items()}
    by_source = Counter()
    for i, r in docs.items():
        by_source[r["source"]] += size[i]
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, rest, left = {}, 1.5 * sum(by_source.values()), set(order)
    while left:
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * by_source[s]}
        for s in over or left:
            target[s] = 2.0 * by_source[s] if over else share[s]
            rest -= target[s] if over else 0
        left = left - over if over else set()
    got, taken = result(6), Counter()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        source = docs[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], by_source[source]) and r["target"] == pytest.approx(target[source])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    for s in order:  # the best that whole documents allow
        whole, rest = divmod(round(target[s]), by_source[s])
        sums = {0}
        for i in (i for i, r in docs.items() if r["source"] == s):
            sums |= {x + size[i] for x in sums if x + size[i] <= rest}
        assert taken[s] == whole * by_source[s] + max(sums)
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in result(6))


def test_archives(result):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in rows_of("pages")}
    last = {}
    for i, html in pages.items():
        last[html] = max(i, last.get(html, i))
    got = result(7)
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        html = pages[r["page_id"]]
        first = len(html) < 1000 or last[html] == r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), hashlib.sha1(html).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first else ("revisit", last[html]))


def test_language(result, docs):
    learned = {r["lang"] for i, r in docs.items() if r["lang"] is not None and zlib.crc32(str(i).encode()) % 5}
    got = result(9)
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        text = docs[r["doc_id"]]["text"]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in learned if any(c.isalpha() for c in text or "") else r["lang_pred"] == "und"


def test_decontamination(result, docs, items):
    got = result(10)
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        n, hit, ids = hits(docs[r["doc_id"]]["text"], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, len(hit), len(ids), sha(",".join(sorted(map(str, ids)))), bool(hit))


def test_pipeline_stages(spark, docs, items, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    tables = [spark.read.parquet(f"{SF}/documents.parquet")]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, tables[-1], SF).write.parquet(f"{tmp_path}/{i}")
        tables.append(spark.read.parquet(f"{tmp_path}/{i}"))
    ids = [sorted(r["doc_id"] for r in t.select("doc_id").collect()) for t in tables]
    assert all(t.columns == tables[0].columns for t in tables[:-1])
    texts = lambda kept: {i: docs[i]["text"] for i in kept}
    assert set(ids[1]) <= set(ids[0]) and all(len(SPACED.findall(docs[i]["text"] or "")) >= 20 for i in ids[1])
    assert ids[2] == sorted(i for i, (_, c) in components(texts(ids[1]), 5).items() if i == c)
    assert ids[3] == sorted(i for i in ids[2] if not hits(docs[i]["text"], items)[1])
    assert set(ids[4]) <= set(ids[3]) and max(Counter(ids[4]).values()) <= 2
    assert ids[5] == ids[4]
