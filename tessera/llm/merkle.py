"""Merkle manifest: a tree of digests over every source's rows and one over the sources, with a proof for every row.

Trees are cut into superblocks: FANOUT ** HEIGHT consecutive nodes of a tree. Going up, each superblock is reduced to one
node, and these nodes are the leaves of the next, much smaller table, until every tree is one node. Going down, the nodes of
each superblock and the outer nodes that its proofs need (the siblings on the way from its top to the root: one row) are
cogrouped by superblock; the same task reduces the block, joins the proofs and folds them. No task sees more than a
superblock and one row of siblings, and a source of any size is spread over as many tasks as it has superblocks.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import saved

FANOUT, HEIGHT = 16, 3
#: Nodes of one tree are ranked from 0; `tree` tells the trees of one table apart, size is that of the tree in this table.
_NODE = "tree string, at long, node string, size long"
_PATH = "tree string, at long, before array<string>, after array<string>"
_ROWS = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _field(value: Column) -> Column:
    """Length in bytes, a colon and the value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return F.sha2(F.concat(*(_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), _field(text)), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered_with() -> Column:
    """Whether a document's text is changed between the manifest and its check."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def tree_of(source: Column) -> Column:
    """A source as the name of its tree: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with `at`, their place from 0 within their tree, by order, and the tree's size. One range exchange; rows are
    numbered inside each partition, and each partition's first number comes from counts, a row a tree in a partition."""
    sorted_ = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    put = saved(sorted_.withColumns({"part": F.spark_partition_id(), "line": F.monotonically_increasing_id()}), name)
    counts = put.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("part")) - F.col("n")
    starts = counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    return put.join(starts, ["tree", "part"]).withColumn("at", F.col("line") + F.col("shift")).drop("part", "line", "shift")


def _level(nodes: list[str], fanout: int) -> list[str]:
    return [digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]


def levels_of(nodes: list[str], steps: int, fanout: int) -> list[list[str]]:
    """A block's nodes on its first `steps` levels, and what is left."""
    found = [nodes]
    for _ in range(steps):
        found.append(_level(found[-1], fanout))
    return found


def depth_of(n: int, fanout: int) -> int:
    """How often n nodes are reduced until one is left."""
    return 0 if n <= 1 else 1 + depth_of(-(-n // fanout), fanout)


def _reduced(fanout: int, height: int, group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("at")
    size, block = int(group["size"].iloc[0]), fanout**height
    node = levels_of(list(group["node"]), min(height, depth_of(size, fanout)), fanout)[-1][0]
    return pd.DataFrame({"tree": [group["tree"].iloc[0]], "at": [int(group["at"].iloc[0]) // block], "node": [node], "size": [-(-size // block)]})


def siblings(found: list[list[str]], at: int, fanout: int) -> tuple[list[str], list[str]]:
    """Of levels_of(): what stands before and after the ancestors of node `at`, level by level."""
    before, after = [], []
    for level in found[:-1]:
        first = at - at % fanout
        before.append("".join(level[first:at]))
        after.append("".join(level[at + 1 : first + fanout]))
        at //= fanout
    return before, after


def _opened(fanout: int, height: int, nodes: pd.DataFrame, outer: pd.DataFrame):
    """The nodes of a superblock in order, its levels, the outer siblings."""
    nodes = nodes.sort_values("at", kind="stable")
    steps = min(height, depth_of(int(nodes["size"].iloc[0]), fanout))
    far = (list(outer["before"].iloc[0]), list(outer["after"].iloc[0])) if len(outer) else ([], [])
    return nodes, levels_of(list(nodes["node"]), steps, fanout), far


def _paths(fanout: int, height: int, nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """The way of every node of a superblock to the root: what stands before and after it on each level."""
    if not len(nodes):
        return pd.DataFrame({"tree": [], "at": [], "before": [], "after": []})
    nodes, found, (before, after) = _opened(fanout, height, nodes, outer)
    ways = [siblings(found, i, fanout) for i in range(len(nodes))]
    return pd.DataFrame({"tree": nodes["tree"], "at": nodes["at"], "before": [w[0] + before for w in ways], "after": [w[1] + after for w in ways]})


def fold(node: str, before: list[str], after: list[str]) -> str:
    """The root that a node and its siblings give. A level where a node stands alone is hashed too."""
    for left, right in zip(before, after):
        node = digest(left + node + right)
    return node


def _proved(fanout: int, height: int, with_proof: bool, nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """A superblock of leaves: local reduction, proofs and folds of all its rows."""
    out: dict[str, list] = {"proof_sha256": [], "folded_root": [], **({"before": [], "after": []} if with_proof else {})}
    if not len(nodes):
        return pd.DataFrame({c: [] for c in ("doc_id", "leaf", "subroot", "root", "verified", *out)})
    nodes, found, far = _opened(fanout, height, nodes, outer)
    root, subroot = outer["root"].iloc[0], outer["subroot"].iloc[0]
    for i, (leaf, changed) in enumerate(zip(nodes["node"], nodes["changed"])):
        before, after = (near + rest for near, rest in zip(siblings(found, i, fanout), far))
        out["proof_sha256"].append(digest("".join(left + right for left, right in zip(before, after))))
        out["folded_root"].append(fold(changed or leaf, before, after))
        if with_proof:
            out["before"].append(before)
            out["after"].append(after)
    made = pd.DataFrame({"doc_id": nodes["doc_id"], "leaf": nodes["node"], "subroot": subroot, "root": root} | {k: pd.Series(v, nodes.index) for k, v in out.items()})
    return made.assign(verified=made["folded_root"] == made["root"])


def climb(nodes: DataFrame, fanout: int, height: int, name: str) -> list[DataFrame]:
    """The tables of a forest, each the tops of the superblocks of the one before; the last has one node a tree."""
    tables, block = [nodes], F.floor(F.col("at") / fanout**height).alias("block")
    while tables[-1].where("size > 1").limit(1).count():
        last = tables[-1].select("tree", "at", "node", "size")
        made = last.groupBy("tree", block).applyInPandas(lambda group: _reduced(fanout, height, group), _NODE)
        tables.append(saved(made, name))
    return tables


def descend(tables: list[DataFrame], outer: DataFrame | None, fanout: int, height: int, name: str) -> DataFrame:
    """The ways to the root of all nodes of the first table: from the last table on, each cogrouped with the ways of its
    superblocks. outer: the ways of the trees' roots, by tree; none where these are the root."""
    spark = tables[0].sparkSession
    ways = outer if outer is not None else spark.createDataFrame([], _PATH)
    for nodes in reversed(tables):
        one = nodes.select("tree", "at", "node", "size").groupBy("tree", F.floor(F.col("at") / fanout**height).alias("block"))
        ways = saved(one.cogroup(ways.groupBy("tree", "at")).applyInPandas(lambda a, b: _paths(fanout, height, a, b), _PATH), name)
    return ways


def manifest(docs: DataFrame, fanout: int = FANOUT, height: int = HEIGHT, with_proof: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; with_proof: also the siblings that
    stand before and after its ancestors, level by level.

    Every row of docs is a leaf, repeated ones too: rows of one source with one doc_id stand in the order of their leaves, and
    those without a doc_id first. Nulls in any column have a sign of their own and differ from empty texts. A row whose
    doc_id is null is never tampered with. An empty table has no root and gives no rows. Other columns are not read.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long"), tree_of(F.col("source")).alias("tree"), leaf_of(text).alias("node"),
        F.when(tampered_with() & text.rlike("[A-Z]"), leaf_of(lowered(text))).alias("changed"),
    )
    # written first: the range exchange reads it twice, once for its bounds
    leaves = ranked(saved(rows, "leaves"), ["doc_id", "node"], "ordered")
    tables = climb(leaves, fanout, height, "tops")
    subroots = tables[-1].select("tree", F.col("node").alias("subroot"))
    sources = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("subroot").alias("node")), ["source"], "subroots")
    upper = climb(sources, fanout, height, "upper")
    root = upper[-1].first()
    ways = descend(upper, None, fanout, height, "ways").join(sources.select("tree", "at", "source"), ["tree", "at"])
    outer = ways.select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("at"), "before", "after")
    if len(tables) > 1:
        outer = descend(tables[1:], outer, fanout, height, "ways")
    # one row a superblock of leaves
    outer = outer.join(subroots, "tree").withColumn("root", F.lit(root.node if root else None).cast("string"))
    schema = _ROWS + (", before array<string>, after array<string>" if with_proof else "")
    one = leaves.select("tree", "at", "node", "size", F.col("doc_id").cast("string").alias("doc_id"), "changed")  # as text: pandas has no long with nulls
    proved = one.groupBy("tree", F.floor(F.col("at") / fanout**height).alias("block")).cogroup(outer.groupBy("tree", "at"))
    made = proved.applyInPandas(lambda a, b: _proved(fanout, height, with_proof, a, b), schema)
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))
