"""Delta Lloyd and the Merkle manifest against plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import clustering, merkle

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, q int"


def plain_lloyd(rows, k, rounds, dims, scale, seed=1):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "")
    cents = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            if mine := [v for (_, v), o in zip(kept, own, strict=True) if o == j]:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], cents


def vectors(spark, n=400, dims=4, seed=5):
    r = random.Random(seed)
    rows = [(i, [round(r.gauss(3 * (i % 5), 1), 2) for _ in range(dims)]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [1.0] * (dims + 1)), (n + 3, [None] + [1.0] * (dims - 1)), (n + 4, [float("nan")] * dims), (n + 5, [float("inf")] * dims), (None, [0.5] * dims), (3, rows[3][1]), (3, [-1.0] * dims)]
    return rows, spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS).repartition(7)


@pytest.mark.parametrize("k,rounds", [(1, 3), (6, 0), (6, 1), (6, 3), (16, 9), (1000, 2)])
def test_clusters(spark, k, rounds, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 50)
    rows, d = vectors(spark)
    want, cents = plain_lloyd(rows, k, rounds, 4, 64)
    got, found = clustering.delta_lloyd(d, k=k, rounds=rounds, dims=4)
    key = lambda x: repr(x)
    assert found == cents
    assert sorted(((r["__row"]["vec_id"], r["cluster"], r["distance"]) for r in got.collect()), key=key) == sorted(want, key=key)


def test_clusters_keep_columns(spark):
    rows, d = vectors(spark)
    want, cents = plain_lloyd(rows, 6, 3, 4, 64)
    out = clustering.clustered(d, k=6, dims=4).collect()
    by = {j: sum(x[2] for x in want if x[1] == j) for j in range(6)}
    assert out[0].asDict().keys() == {"vec_id", "embedding", "label", "q", *clustering.ADDED}
    assert all(r["cluster_inertia"] == by[r["cluster"]] and r["inertia"] == sum(by.values()) and r["q"] == 2 for r in out)
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, cents[r["cluster"]])).encode()).hexdigest() for r in out)
    assert clustering.centroid_table(d, k=6, dims=4).count() == 6
    assert clustering.clustered(d.limit(0), dims=4).collect() == [] and clustering.clustered(d.filter("size(embedding) = 5"), dims=4).collect() == []
    with pytest.raises(Exception, match="after scaling"):
        clustering.clustered(spark.createDataFrame([(1, [1e9, 1.0])], "vec_id long, embedding array<float>"), dims=2).collect()


def test_large_components_are_exact():
    r = np.random.default_rng(1)
    for size in (1000, clustering.LARGEST):
        x, c = r.integers(-size, size, (20, 64)), r.integers(-size, size, (5, 64))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]
        assert clustering.distances(x, c).tolist() == want


def test_only_what_moved_is_sent(spark):
    rows, d = vectors(spark)
    got, _ = clustering.delta_lloyd(d, k=6, rounds=3, dims=4)
    moved = {j: 0 for j in range(6)}
    for r in got.collect():
        if r["was"] != r["cluster"]:
            moved[r["cluster"]] += 1
            moved[r["was"]] -= 1
    sent = {r["cluster"]: r["n"] for r in clustering.transfers(got, 6, 4).collect()}
    assert {j: n for j, n in moved.items() if n} == {j: n for j, n in sent.items() if n}


# ---- Merkle manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def plain_tree(nodes):
    """(root, a path of left and right siblings for each node)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 3 * 3 : k // 3 * 3 + 3]
            paths[i].append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
        level, at = [h(*level[i : i + 3]) for i in range(0, len(level), 3)], [k // 3 for k in at]
    return level[0], paths


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), plain_leaf(r, r[4]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([leaf for _, leaf, _ in sorted(groups[s], key=lambda x: x[:2])]) for s in order}
    root, tops = plain_tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (_, leaf, r), own in zip(sorted(groups[s], key=lambda x: x[:2]), trees[s][1], strict=True):
            path = own + top
            node = plain_leaf(r, r[4].replace("\n", "") if r[4] is not None else None) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else leaf
            for a, b in path:
                node = h(a, node, b)
            out.append((r[0], leaf, trees[s][0], root, h(*[a + b for a, b in path]), node, node == root))
    return sorted(out, key=repr)


def tree_rows(n=150, sources=("a", "b", "", None, "é", "zz")):
    r = random.Random(2)
    rows = [(i, sources[0] if i % 3 == 0 else r.choice(sources), r.choice(["en", None]), r.choice([None, 5]), r.choice(["x\ny", None, "", "é 𝄞", "a\n\nb" * 50]), "own", 1) for i in range(n)]
    return rows + [rows[4], rows[4], (4, rows[4][1], "en", 1, "other", "own", 1), (None, "a", None, None, None, "own", 1), (None, "a", None, None, "t\n", "own", 1), (-7, "alone", "en", 2, "q\n", "own", 1)]


@pytest.mark.parametrize("levels,top", [(7, 4096), (1, 8), (2, 4), (1, 1), (3, 2)])
def test_manifest(spark, levels, top):
    """Whatever size blocks and the driver's part of the tree have, down to groups' roots being reduced in blocks, too."""
    rows = tree_rows()
    d = spark.createDataFrame(rows, DOCS).repartition(6)
    out = merkle.verified(merkle.manifest(d, also={"tampered": merkle.tampered_leaf()}, levels=levels, top=top), F.coalesce("tampered", "leaf"))
    got = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=repr) == plain_manifest(rows)
    assert any(r["verified"] for r in got) and not all(r["verified"] for r in got)


def test_many_groups(spark):
    rows = tree_rows(60, tuple(f"s{i}" for i in range(40)))
    d = spark.createDataFrame(rows, DOCS)
    for levels, top in ((1, 5), (2, 10)):
        got = merkle.manifest(d, levels=levels, top=top).select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path"))).collect()
        assert sorted(map(tuple, got), key=repr) == sorted((x[:5] for x in plain_manifest(rows)), key=repr)


def test_manifest_of_few_rows(spark):
    d = spark.createDataFrame(tree_rows()[:1], DOCS)
    assert [tuple(r) for r in merkle.manifest(d).select("leaf", "root", F.size("path")).collect()] == [(plain_leaf(tree_rows()[0], tree_rows()[0][4]),) * 2 + (0,)]
    empty = merkle.verified(merkle.manifest(d.limit(0)), F.col("leaf"))
    assert empty.collect() == [] and dict(empty.dtypes)["verified"] == "boolean"
