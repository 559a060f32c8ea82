"""Merkle manifest of a dataset: a tree of 16-fold hashes for each group, and one over the groups.

Leaves are hashed by native expressions and numbered within their group by one
range sort. From then on only digests travel. Aligned blocks of 4096 leaves each
fit a task whatever the size of a group; their roots are the nodes of the next
round, until a group has one node, its subroot. The subroots, numbered in turn,
make the tree above them in the same way.

Proofs come on the way down, block by block, by fractal traversal: on each level
the existing subtree holds the siblings of the current path, while the desired one,
which the traversal needs next, grows by one leaf for each path handed out. The
path above the block is the same for all its leaves and reaches it as one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialise

#: Nodes hashed together, and levels of a block: 16 ** 3 leaves.
FAN = 16
BLOCK_LEVELS = 3

UPPERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


class Subtree:
    """Grows by one leaf at a time into its ``level``: at most 16 nodes, the children of one node."""

    def __init__(self, level: int):
        self.open: list[list[str]] = [[] for _ in range(level + 1)]

    def add(self, leaf: str) -> None:
        node = leaf
        for k, run in enumerate(self.open):
            run.append(node)
            if len(run) < FAN or k == len(self.open) - 1:
                return
            node = digest(run)
            run.clear()

    def nodes(self) -> list[str]:
        """Its nodes; the last runs may be short."""
        for k in range(len(self.open) - 1):
            if self.open[k]:
                self.open[k + 1].append(digest(self.open[k]))
                self.open[k] = []
        return self.open[-1]


def block_height(leaves: int, first: bool, most: int = BLOCK_LEVELS) -> int:
    """Levels within a block. Only the first block of a tree can be lower than the others: it is the whole tree then."""
    return height(leaves) if first else most


def block_root(leaves: list[str], first: bool, most: int = BLOCK_LEVELS) -> str:
    levels = block_height(len(leaves), first, most)
    if not levels:
        return leaves[0]
    tree = Subtree(levels - 1)
    for leaf in leaves:
        tree.add(leaf)
    return digest(tree.nodes())


def paths(leaves: list[str], first: bool, most: int = BLOCK_LEVELS) -> Iterator[list[tuple[str, str]]]:
    """For each leaf of a block the siblings before and after its path on each level, lowest first.

    The stacked existing subtrees hold at most 16 nodes a level, the desired ones as
    many and their open runs; leaves are read ahead by at most one subtree.
    """
    levels = block_height(len(leaves), first, most)
    existing, desired, ahead = [], [], []
    for level in range(levels):
        span = FAN ** (level + 1)
        tree = Subtree(level)
        for leaf in leaves[:span]:
            tree.add(leaf)
        existing.append(tree.nodes())
        desired.append(Subtree(level))
        ahead.append(min(span, len(leaves)))
    for i in range(len(leaves)):
        path = []
        for level, nodes in enumerate(existing):
            k = (i // FAN**level) % FAN
            path.append(("".join(nodes[:k]), "".join(nodes[k + 1 :])))
        yield path
        for level in range(levels):
            if ahead[level] < len(leaves):
                desired[level].add(leaves[ahead[level]])
                ahead[level] += 1
            if (i + 1) % FAN ** (level + 1) == 0:
                existing[level], desired[level] = desired[level].nodes(), Subtree(level)


def folded(node: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        node = digest((before, node, after))
    return node


def field(col: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = col.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_hash(cols: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, cols)), 256)


def _positions(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with __pos, the place from 0 within the group ``key`` by ``order``; written to the shared folder.

    One range sort; places are counted within each range, and groups that reach over
    several ranges get one offset in each, at most one row for each range.
    """
    rows = rows.withColumn("__tie", F.monotonically_increasing_id())
    ranges = rows.repartitionByRange(key, *order, "__tie").sortWithinPartitions(key, *order, "__tie").drop("__tie")
    at = ranges.columns.index(key)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, n = None, 0
        for b in batches:
            places = []
            for g in b.column(at).to_pylist():
                if g != group:
                    group, n = g, 0
                places.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, pa.int64())], names=[*b.schema.names, "__in"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.schema) + ", __in long"
    ranges = materialise(ranges.mapInArrow(number, schema).withColumn("__range", F.spark_partition_id()))
    counts = ranges.groupBy(key, "__range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.sum("n").over(earlier)).where("__before > 0").select(key, "__range", "__before")
    return ranges.join(F.broadcast(offsets), [key, "__range"], "left").withColumn("__pos", F.col("__in") + F.coalesce("__before", F.lit(0))).drop("__in", "__range", "__before")


def _blocks(batches: Iterator[pa.RecordBatch], cols: list[str]):
    """(key, block, rows) of sorted batches, a row a tuple of ``cols``; one block at a time is held."""
    held, own = [], None
    for b in batches:
        for k, block, *row in zip(b.column("k").to_pylist(), b.column("block").to_pylist(), *(b.column(c).to_pylist() for c in cols)):
            if (k, block) != own:
                if held:
                    yield *own, held
                held, own = [], (k, block)
            held.append(row)
    if held:
        yield *own, held


def _climb(nodes: DataFrame, most: int) -> DataFrame:
    """(k, pos, h) of the roots of the blocks of ``nodes`` (k, pos, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = ((k, block, block_root([h for (h,) in rows], block == 0, most)) for k, block, rows in _blocks(batches, ["h"]))
        return _batches(roots, {"k": pa.string(), "pos": pa.int64(), "h": pa.string()})

    dealt = nodes.select("k", F.shiftright("pos", 4 * most).alias("block"), "pos", "h").repartition("k", "block").sortWithinPartitions("k", "block", "pos")
    return dealt.mapInArrow(run, "k string, pos long, h string")


def _batches(rows: Iterator[tuple], kinds: dict[str, pa.DataType], most: int = 512) -> Iterator[pa.RecordBatch]:
    """``rows`` in batches, from as many blocks as it takes."""
    while held := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.values())], names=list(kinds))


def _rounds(leaves: DataFrame, most: int) -> list[DataFrame]:
    """``leaves`` (k, pos, h) and the block roots of each round above them, the last with one node for each k."""
    out = [leaves]
    while True:
        if len(out) > 1 and not out[-1].where("pos > 0").head(1):
            return out
        out.append(materialise(_climb(out[-1], most)))


#: What stands above a node: its siblings on each level up to the root, and the roots.
_ABOVE = "before array<string>, after array<string>, subroot string, root string"


def _descend(nodes: DataFrame, above: DataFrame, most: int) -> DataFrame:
    """(k, pos, before, after, subroot, root) of ``nodes`` (k, pos, h), from that of their blocks' roots."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for k, block, rows in _blocks(batches, ["pos", "h", "before", "after", "subroot", "root"]):
            (_, _, up_before, up_after, subroot, root), *own = rows  # the row from above sorts first
            for (pos, *_), path in zip(own, paths([r[1] for r in own], block == 0, most)):
                yield k, pos, [a for a, _ in path] + up_before, [b for _, b in path] + up_after, subroot, root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(walk(batches), {"k": pa.string(), "pos": pa.int64(), "before": strings, "after": strings, "subroot": pa.string(), "root": pa.string()})

    strings = pa.list_(pa.string())
    return _dealt(nodes, above, most).mapInArrow(run, f"k string, pos long, {_ABOVE}")


def _dealt(nodes: DataFrame, above: DataFrame, most: int) -> DataFrame:
    """Nodes by block, each block led by the one row that says what stands above it (pos -1)."""
    ups = above.select("k", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "before", "after", "subroot", "root")
    own = nodes.withColumn("block", F.shiftright("pos", 4 * most))
    return own.unionByName(ups, allowMissingColumns=True).repartition("k", "block").sortWithinPartitions("k", "block", "pos")


def merkle_manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", tampered: Column | None = None, proofs: bool = False, most: int = BLOCK_LEVELS) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, leaf, subroot, root, proof_sha256, folded_root, verified; with ``proofs`` also
    before and after, the siblings on either side of the path on each level. ``most``: levels of a block.

    A leaf is the hash of ``fields``; a null field counts as `-`, unlike an empty one. Leaves
    of a group stand by id, nulls first, and equal ids by leaf; rows that repeat in full
    stand beside each other, and each has its own proof. Groups stand by name, a null
    one first and unlike an empty one. ``tampered`` marks rows (null: not) for which folded_root starts
    from a leaf whose text has A-Z lower-cased, all others from their leaf. A very long
    text is hashed whole where it is read and goes no further. Other columns are not
    read. An empty table gives an empty one.
    """
    cols = [docs[c] for c in fields]
    lowered = [F.translate(docs[c], UPPERS, UPPERS.lower()) if c == text_col else docs[c] for c in fields]
    group = docs[group_col].cast("string")
    bad = F.when(tampered, leaf_hash(lowered)) if tampered is not None else F.lit(None).cast("string")
    name = F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group))
    rows = materialise(docs.select(docs[id_col].alias("i"), name.alias("k"), leaf_hash(cols).alias("h"), bad.alias("bad")))  # texts are read once
    leaves = materialise(_positions(rows, "k", "i", "h").withColumnRenamed("__pos", "pos"))

    lower = _rounds(leaves.select("k", "pos", "h"), most)
    subroots = materialise(_positions(lower[-1].select(F.lit("").alias("k"), F.col("k").alias("group"), "h"), "k", "group").withColumnRenamed("__pos", "pos"))
    upper = _rounds(subroots.select("k", "pos", "h"), most)
    none = F.array().cast("array<string>")
    above = upper[-1].select("k", "pos", none.alias("before"), none.alias("after"), F.lit(None).cast("string").alias("subroot"), F.col("h").alias("root"))
    for nodes in upper[-2::-1]:
        above = materialise(_descend(nodes, above, most))
    # from here on each group's single node knows its place in the tree of groups
    named = above.drop("subroot").join(subroots.select("pos", "group", F.col("h").alias("subroot")), "pos")
    above = materialise(named.select(F.col("group").alias("k"), F.lit(0).cast("long").alias("pos"), "before", "after", "subroot", "root"))
    for nodes in lower[-2:0:-1]:
        above = materialise(_descend(nodes, above, most))

    kind, id_type = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    kinds = {"i": id_type} | dict.fromkeys(["leaf", "subroot", "root", "proof_sha256", "folded_root"], pa.string()) | {"verified": pa.bool_()}
    if proofs:
        kinds |= dict.fromkeys(["before", "after"], pa.list_(pa.string()))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, block, rows in _blocks(batches, ["i", "h", "bad", "before", "after", "subroot", "root"]):
            (*_, up_before, up_after, subroot, root), *own = rows
            up = list(zip(up_before, up_after))
            shared = "".join(a + b for a, b in up)
            for (i, leaf, bad, *_), path in zip(own, paths([r[1] for r in own], block == 0, most)):
                proof = digest([*(a + b for a, b in path), shared])
                end = folded(bad or leaf, path + up)
                sides = ([a for a, _ in path + up], [b for _, b in path + up]) if proofs else ()
                yield i, leaf, subroot, root, proof, end, end == root, *sides

    schema = f"i {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", before array<string>, after array<string>" * proofs
    return _dealt(leaves, above, most).mapInArrow(lambda batches: _batches(walk(batches), kinds), schema).withColumnRenamed("i", id_col)


def verify(manifest: DataFrame) -> DataFrame:
    """``manifest`` (made with proofs) with proven: whether its leaf and siblings lead to its root."""

    def fold(leaf: str, before: list[str], after: list[str]) -> str:
        return folded(leaf, list(zip(before, after)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [fold(x, p, q) == r for x, p, q, r in zip(*(b.column(c).to_pylist() for c in ("leaf", "before", "after", "root")))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_())], names=[*b.schema.names, "proven"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in manifest.schema)
    return manifest.mapInArrow(run, f"{schema}, proven boolean")
