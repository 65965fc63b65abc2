"""A Merkle manifest of a dataset: a digest for each row, a tree of them for each group, and a tree over the groups, with proofs.

Rows of a group stand in the order of their key; as long as a tree has several nodes, every ARITY neighbours, of which the last run may have fewer,
become one node. Large blocks of BLOCK neighbours are reduced to one node each by their own task, level by level of blocks, until TOP nodes at
most are left. The driver builds the rest of the tree from these, and each of them gets its suffix path, from there to the root. On the way
down, each block finds its nodes' paths within it again and adds the path of the block: a table of TOP rows at most is broadcast,
a longer one is joined by block, whose rows BLOCK bounds. So the last folds, one for each row, are expressions over arrays.

Places within a group come from running sums over ranges of (group, key, digest), so a group with a third of all rows, or a key that many rows share, is dealt to
many tasks.

Defined results: any column may be null, which a digest tells from empty; a null group is a group of its own, the first; rows with a null
key come first in their group; rows that share a key are in the order of their digests, and equal rows are leaves of their own. An empty
table has no rows, and no root. Texts are hashed whole. Other columns take no part."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.ordered import sums_before, with_row_numbers

from .common import Scratch, stored

#: The fields of a leaf, in order, and how many neighbours become one node.
FIELDS, ARITY = ("doc_id", "source", "lang", "n_chars", "text"), 3
#: Levels of a block, whose ARITY ** LEVELS nodes a task reduces at a time.
LEVELS = 7
#: Nodes that the driver builds the rest of the tree from (some kilobytes each with their paths).
TOP = 4096
_PATH = "array<struct<left: string, right: string>>"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field as `-` if null, else its length in UTF-8 bytes, a colon and the value."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*said), 256)


def folded(node: Column, path: Column) -> Column:
    """The root that a node and a path of left and right siblings give."""
    return F.aggregate(path, node, lambda at, x: F.sha2(F.concat(x["left"], at, x["right"]), 256))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, from below and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def _levels(digests: list[str], n: int | None = None) -> list[list[str]]:
    """The levels above the digests: n of them, or as many as lead to a single node."""
    out = [digests]
    while len(out) <= n if n is not None else len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + ARITY])) for i in range(0, len(out[-1]), ARITY)])
    return out


def _paths(levels: list[list[str]]) -> list[list[tuple[str, str]]]:
    """For each node of the lowest level its siblings, left and right, on each level but the last."""
    own: list[list[tuple[str, str]]] = []
    for nodes in levels[:-1]:
        runs = [nodes[i - i % ARITY : i - i % ARITY + ARITY] for i in range(len(nodes))]
        own.append([("".join(run[: i % ARITY]), "".join(run[i % ARITY + 1 :])) for i, run in enumerate(runs)])
    return [[own[k][i // ARITY**k] for k in range(len(own))] for i in range(len(levels[0]))]


def _height(nodes: int, block: int, levels: int) -> int | None:
    """Levels that a block is reduced by: all of them, unless it is the only one of its tree and not full."""
    return levels if block or nodes == ARITY**levels else None


def _reduced(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, digest): a node for each block of neighbours. nodes: (tree, pos, digest)."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        digests = rows.sort_by("pos").column("digest").to_pylist()
        top = _levels(digests, _height(len(digests), key[1].as_py(), levels))[-1]
        return pa.table({"tree": [key[0].as_py()], "pos": pa.array([key[1].as_py()], pa.int64()), "digest": top})

    return nodes.withColumn("block", F.expr(f"pos div {ARITY**levels}")).groupBy("tree", "block").applyInArrow(run, "tree string, pos bigint, digest string")


def _within(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, block, own): each node's path within its block."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        digests = rows.column("digest").to_pylist()
        paths = _paths(_levels(digests, _height(len(digests), key[1].as_py(), levels)))
        own = pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))
        return pa.table({"tree": rows.column("tree"), "pos": rows.column("pos"), "block": pa.array([key[1].as_py()] * len(paths), pa.int64()), "own": own})

    return nodes.withColumn("block", F.expr(f"pos div {ARITY**levels}")).groupBy("tree", "block").applyInArrow(run, f"tree string, pos bigint, block bigint, own {_PATH}")


def _placed(rows: DataFrame) -> DataFrame:
    """rows (tree, digest, key and others) with pos, from 0 within their tree; stored."""
    order = [F.col("tree").asc(), F.col("key").asc_nulls_first(), F.col("digest").asc()]
    placed = sums_before(with_row_numbers(rows.withColumn("__one", F.lit(1).cast("long")), "leaves"), order, "__one", "__at")
    first = placed.groupBy(F.col("tree").alias("__tree")).agg(F.min("__at").alias("__first"))
    return stored(placed.join(first, F.col("tree") == F.col("__tree")).withColumn("pos", F.col("__at") - F.col("__first")).drop("__tree", "__first", "__at", "__one"), "placed-leaves")


def paths(rows: DataFrame, levels: int = LEVELS, top: int = TOP) -> tuple[DataFrame, str | None]:
    """(rows with path and subroot, the root): the whole path of each row to the root, and the root of its group. rows: tree (a text; trees are ordered by it), key, digest and
    others. The result is a plan over stored tables."""
    spark = rows.sparkSession
    with Scratch(spark) as scratch:
        leaves = scratch.keep(_placed(rows))
        steps = [leaves.select("tree", "pos", "digest")]
        kinds = []  # how each step came from the one before: "block", or "trees" where groups' roots became one tree
        while (n := steps[-1].count()) > top:
            many = steps[-1].filter("pos > 0").limit(1).count() > 0
            if many:
                steps.append(scratch.keep(stored(_reduced(steps[-1], levels), "tree-nodes", few=True)))
            else:
                roots = with_row_numbers(steps[-1].select("tree", F.col("digest"), F.lit(1).cast("long").alias("__one")), "group-roots")
                joined = sums_before(roots, [F.col("tree").asc()], "__one", "pos")
                steps.append(scratch.keep(stored(joined.select(F.lit("").alias("tree"), "pos", "digest", F.col("tree").alias("group")), "tree-nodes", few=True)))
            kinds.append("block" if many else "trees")
        if not n:
            return leaves.select("*", F.array().cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot")), None
        by_tree = defaultdict(list)
        for r in steps[-1].orderBy("tree", "pos").collect():  # TOP nodes at most
            by_tree[r["tree"]].append(r["digest"])
        grouped = {t: _levels(x) for t, x in sorted(by_tree.items(), key=lambda x: x[0].encode())}
        one = "trees" in kinds
        upper = _levels([x[-1][0] for x in grouped.values()])
        table = [(t, i, p + above, None if one else x[-1][0]) for (t, x), above in zip(grouped.items(), _paths(upper), strict=True) for i, p in enumerate(_paths(x))]
        found = spark.createDataFrame(table, f"tree string, pos bigint, path {_PATH}, subroot string")
        few = True
        for nodes, kind in zip(reversed(steps[:-1]), reversed(kinds), strict=True):
            above = (F.broadcast(found) if few else found).select(F.col("tree").alias("__t"), F.col("pos").alias("__p"), "path", "subroot")
            if kind == "trees":
                named = steps[len(steps) - 1 - kinds[::-1].index("trees")]
                both = named.join(above, (F.col("tree") == F.col("__t")) & (F.col("pos") == F.col("__p")))
                found = both.select(F.col("group").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"))
            else:
                inside = _within(nodes.select("tree", "pos", "digest"), levels)
                both = inside.join(above, (F.col("tree") == F.col("__t")) & (F.col("block") == F.col("__p")))
                found = both.select("tree", "pos", F.concat("own", "path").alias("path"), "subroot")
            few = False
    here = found.select(F.col("tree").alias("__t"), F.col("pos").alias("__p"), "path", "subroot")
    both = leaves.join(F.broadcast(here) if few else here, (F.col("tree") == F.col("__t")) & (F.col("pos") == F.col("__p")))
    return both.drop("__t", "__p"), upper[-1][0]


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id", also: dict[str, Column] | None = None, levels: int = LEVELS, top: int = TOP) -> DataFrame:
    """(key, group, leaf, subroot, root, path) of each row of docs, with the columns of `also`, expressions over docs that are narrow: what
    should travel with a row, such as a leaf of another reading of it."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    more = also or {}
    rows = docs.select(tree.alias("tree"), F.col(key).alias("key"), leaf([F.col(c) for c in fields]).alias("digest"), F.col(group).alias("__group"), *[c.alias(n) for n, c in more.items()])
    found, root = paths(rows, levels, top)
    return found.select(F.col("key").alias(key), F.col("__group").alias(group), F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), "path", *more)


def verified(manifested: DataFrame, node: Column) -> DataFrame:
    """Adds folded_root, what `node` and the row's path give, and verified: whether that is the root."""
    return manifested.withColumn("folded_root", folded(node, F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_leaf(fields: tuple[str, ...] = FIELDS, key: str = "doc_id", text: str = "text") -> Column:
    """The leaf after line feeds are deleted from the texts of rows for which the CRC-32 of the key is even; null where a row stays as it is."""
    cut = leaf([F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == text else F.col(c) for c in fields])
    return F.when(F.crc32(F.col(key).cast("string")) % 2 == 0, cut)
