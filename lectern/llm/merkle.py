"""A Merkle manifest of a table: trees of leaf digests, a root over the trees, a proof for every leaf.

Leaves get dense positions in their tree; 8 ** 4 consecutive ones are a block. A block is traversed in
one task, and its root is a leaf of the next, shorter tree, until one node is left. On the way back each
block gets the siblings of the nodes above it. Only digests travel, and no task has more than a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import Stash

FAN = 8
#: Levels of nodes in a block.
HEIGHT = 4
PROOF = "array<struct<at:int,siblings:array<string>>>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256, as hex text, of some values: each ``-`` if null, else its UTF-8 bytes' number, ``:`` and the value."""
    values = [c.cast("string") for c in columns]
    told = (F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)
    return F.sha2(F.concat(*told), 256)


def traverse(leaves: list[str], height: int, fan: int = FAN) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """The root of ``height`` levels over some leaves, and for each leaf its place among, and the digests of, its siblings, from below."""
    proofs: list[list[tuple[int, list[str]]]] = [[] for _ in leaves]

    def subtree(lo: int, hi: int, level: int) -> str:
        if level == 0:
            return leaves[lo]
        step = fan ** (level - 1)
        starts = range(lo, hi, step)
        children = [subtree(at, min(at + step, hi), level - 1) for at in starts]
        for i, at in enumerate(starts):
            place = (i, children[:i] + children[i + 1 :])
            for leaf in range(at, min(at + step, hi)):
                proofs[leaf].append(place)
        return digest(*children)

    return subtree(0, len(leaves), height), proofs


def _proofs(proofs: list[list[tuple[int, list[str]]]]) -> pa.Array:
    """PROOF as an Arrow array."""
    levels, places, widths, flat = [0], [], [0], []
    for proof in proofs:
        for at, siblings in proof:
            places.append(at)
            flat += siblings
            widths.append(len(flat))
        levels.append(len(places))
    siblings = pa.ListArray.from_arrays(pa.array(widths, pa.int32()), pa.array(flat, pa.string()))
    return pa.ListArray.from_arrays(pa.array(levels, pa.int32()), pa.StructArray.from_arrays([pa.array(places, pa.int32()), siblings], ["at", "siblings"]))


def _height(n: int) -> int:
    """Levels that a block of a tree of n leaves has: all, or as many as the tree itself."""
    return HEIGHT if n > FAN**HEIGHT else next(h for h in range(HEIGHT + 1) if FAN**h >= n)


def positioned(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` (tree, digest and others) with ``pos``, dense from 0 in each tree by ``order`` and digest, and ``n``, the tree's size.

    Ranges of the order are numbered side by side; a range's start is the sum of those before it.
    """
    order = ["tree", *order, "digest", "__tie"]  # rows that are equal in all else are parted by their place in the input
    ranged = nodes.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = Stash(ranged, "leaves").df
    sizes = ranged.groupBy("tree", "__part").agg(F.count("*").alias("__size"))
    own = Window.partitionBy("tree")
    before = F.coalesce(F.sum("__size").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("tree", "__part", before.alias("__before"), F.sum("__size").over(own).alias("n"))
    nth = F.row_number().over(Window.partitionBy("tree", "__part").orderBy(*order[1:]))
    placed = ranged.withColumn("__nth", nth).join(sizes, ["tree", "__part"])
    return placed.withColumn("pos", F.col("__before") + F.col("__nth") - 1).drop("__part", "__before", "__nth", "__tie")


def _block() -> Column:
    return F.floor(F.col("pos") / FAN**HEIGHT).cast("long").alias("__block")


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """The nodes (tree, pos, n, digest) of every level, block roots above their blocks; the last has one for each tree."""

    def root(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        top, _ = traverse(table.column("digest").to_pylist(), _height(table.column("n")[0].as_py()))
        one = table.slice(0, 1)
        return pa.table([one.column("tree"), one.column("__block"), one.column("n"), pa.array([top])], ["tree", "pos", "n", "digest"])

    levels = [nodes]
    while levels[-1].filter("n > 1").limit(1).count():
        blocks = levels[-1].select("tree", "pos", "n", "digest", _block()).groupBy("tree", "__block").applyInArrow(root, levels[-1].select("tree", "pos", "n", "digest").schema)
        levels.append(Stash(blocks.withColumn("n", F.ceil(F.col("n") / FAN**HEIGHT)), "nodes").df)
    return levels


def _below(names: list[str], given: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What gives the nodes of a block their proofs, and their block root's values."""

    def proofs_of(table: pa.Table, upper: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        above = [(x["at"], x["siblings"]) for x in upper.column("proof")[0].as_py()]
        _, proofs = traverse(table.column("digest").to_pylist(), _height(table.column("n")[0].as_py()))
        for own in proofs:
            own += above
        told = [pa.repeat(upper.column(c)[0], table.num_rows) for c in given]
        return pa.table([*(table.column(c) for c in names), _proofs(proofs), *told], [*names, "proof", *given])

    return proofs_of


def _descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level with the columns of ``tops`` (tree, proof and others): proofs with a block's own siblings before those above it."""
    given = [c for c in tops.columns if c not in ("tree", "proof")]
    above = tops.withColumn("pos", F.lit(0).cast("long"))
    if len(levels) == 1:  # trees of one node each
        return levels[0].join(tops, "tree")
    for nodes in levels[-2::-1]:
        schema = f"{_ddl(nodes)}, proof {PROOF}, {_ddl(tops.select(*given))}"
        blocks = nodes.withColumn("__block", _block()).groupBy("tree", "__block")
        found = blocks.cogroup(above.groupBy("tree", "pos")).applyInArrow(_below(nodes.columns, given), schema)
        above = found if nodes is levels[0] else Stash(found.select("tree", "pos", "proof", *given), "proofs").df
    return above


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def manifest(leaves: DataFrame, tree_col: str, order_col: str) -> DataFrame:
    """``leaves`` (digest, a tree's name, an order in it, any others) with tree, pos, n, subroot, root and proof.

    tree: struct (known, name), so that the tree of null names comes first; trees are ordered by the bytes of
    their names. In a tree leaves ascend by ``order_col``, nulls first, equal ones by digest. While more than one node is
    left, every run of 8 becomes the digest of its own; a lone leaf is its tree's root. The trees' roots make
    the root likewise. proof: from below, a leaf's place in its run and the digests of the others, up to the
    root. Repeated rows are leaves of their own; an empty table gives an empty result. Columns of ``leaves``
    stay as they are, but for those named like these.
    """
    names = [c for c in leaves.columns if c not in ("tree", "pos", "n", "subroot", "root", "proof", "digest", tree_col)]
    tree = F.struct(F.col(tree_col).isNotNull().alias("known"), F.coalesce(F.col(tree_col).cast("string"), F.lit("")).alias("name")).alias("tree")
    nodes = leaves.select(tree, F.col(tree_col), "digest", *names)
    order = [order_col] if order_col != tree_col else []
    levels = _climb(Stash(positioned(nodes, order), "placed").df)
    roots = levels[-1].select(F.struct(F.lit(True).alias("known"), F.lit("").alias("name")).alias("tree"), F.col("tree").alias("own"), "digest")
    upper = _climb(Stash(positioned(roots, ["own"]), "placed").df)
    top = upper[-1].select("tree", F.col("digest").alias("root"), F.array().cast(PROOF).alias("proof"))
    tops = _descend(upper, top).select(F.col("own").alias("tree"), "proof", F.col("digest").alias("subroot"), "root")
    return _descend(levels, Stash(tops, "tops").df)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest gives with a proof."""
    return F.aggregate(
        proof, leaf,
        lambda acc, x: F.sha2(F.array_join(F.concat(F.slice(x["siblings"], 1, x["at"]), F.array(acc), F.slice(x["siblings"], x["at"] + 1, FAN)), ""), 256),
    )


def proof_digest(proof: Column) -> Column:
    """One digest of all siblings of a proof, from below."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda x: x["siblings"])), ""), 256)
