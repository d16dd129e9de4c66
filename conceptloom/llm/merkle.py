"""Merkle manifest of a table: a tree of sha256 digests for each group, and one over the groups' roots.

Leaves are numbered within their group by a range sort and counted offsets, then gathered in blocks of 256. A block is an
array of digests that higher-order functions collapse: sequence numbers the runs of a level, slice cuts them, transform
hashes them and aggregate goes from level to level. The roots of the blocks are the leaves of the next round, so a table
of 10^10 rows takes five rounds, each of a 256th of the rows of the one before. Proofs go the other way, from the root
down, a block at a time; no row meets more than its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Levels of a block, and the nodes it holds. Runs are of two nodes.
LEVELS = 8
BLOCK = 1 << LEVELS
#: Columns of a document that its leaf covers.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(values: list[Column]) -> Column:
    """sha256 (lowercase hex) of values: `-` for a null, else its count of UTF-8 bytes, `:` and the value (numbers as decimals)."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def group_key(c: Column) -> Column:
    """A key that is never null and sorts as c does bytewise, null first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """rows(g, ...) with pos, the row's number within g by order (nulls first), and n, the rows of g.

    Rows are range-sorted by g and order, so a large g is spread over many tasks; a row a task and group tells how many
    rows stand before. rows should be narrow: they are written sorted.
    """
    keys = [F.col("g"), *(F.col(c).asc_nulls_first() for c in order)]
    s = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    s = common.materialize(s.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), label)
    held = common.materialize(s.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("some")), f"{label}-counts")
    # a row for each task that holds a part of the group
    before = held.withColumn("n", F.expr("sum(some) OVER (PARTITION BY g)")).withColumn("skip", F.expr("sum(some) OVER (PARTITION BY g ORDER BY part) - some"))
    out = s.join(before.select("g", "part", "first", "n", "skip"), ["g", "part"])
    return out.select(*(s[c] for c in rows.columns), (F.col("at") - F.col("first") + F.col("skip")).alias("pos"), "n")


def _above(a: str) -> str:
    """The level above a: every run of two nodes, or one at the end, becomes the digest of their texts."""
    return f"transform(sequence(0, (size({a}) - 1) div 2), r -> sha2(array_join(slice({a}, 2 * r + 1, 2), ''), 256))"


#: Levels to go in a block of a group of n nodes: all of the block's, or as many as lead to one node.
_DEPTH = f"if(n > {BLOCK}, {LEVELS}, if(n <= 1, 0, length(bin(n - 1))))"
_STEPS = f"slice(sequence(1, {LEVELS}), 1, {_DEPTH})"
_TOP = f"aggregate({_STEPS}, transform(items, x -> x.digest), (a, s) -> {_above('a')})[0]"
_ALL = f"aggregate({_STEPS}, array(transform(items, x -> x.digest)), (a, s) -> concat(a, array({_above('element_at(a, -1)')})))"
_OWN = """transform(slice(levels, 1, size(levels) - 1), (level, j) ->
    if((shiftright(i, j) ^ 1) >= size(level), '', concat(if(shiftright(i, j) % 2 = 1, 'L', 'R'), get(level, shiftright(i, j) ^ 1))))"""


def climb(nodes: DataFrame, label: str) -> list[DataFrame]:
    """Rounds of blocks (g, block, n, items, top) over nodes(g, pos, n, digest, ...); the last round has one block a group."""
    rounds = []
    while True:
        values = [c for c in nodes.columns if c not in ("g", "pos", "n")]
        item = F.struct((F.col("pos") % BLOCK).cast("int").alias("i"), *values)
        held = nodes.groupBy("g", F.floor(F.col("pos") / F.lit(BLOCK)).alias("block")).agg(F.sort_array(F.collect_list(item)).alias("items"), F.max("n").alias("n"))
        blocks = common.materialize(held.withColumn("top", F.expr(_TOP)), f"{label}-{len(rounds)}")
        rounds.append(blocks)
        if (blocks.agg(F.max("n")).head()[0] or 0) <= BLOCK:
            return rounds
        nodes = blocks.select("g", F.col("block").alias("pos"), F.expr(f"if(n > {BLOCK}, (n + {BLOCK - 1}) div {BLOCK}, 1L)").alias("n"), F.col("top").alias("digest"))


def descend(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """The nodes that climb() began with, each with path and the other columns of top(g, path, ...).

    path holds the sibling of the node and of each node above it: L or R for its side and its digest, or nothing.
    """
    above = top.withColumn("block", F.lit(0).cast("long"))
    carried = [c for c in top.columns if c not in ("g", "path")]
    for k, blocks in reversed(list(enumerate(rounds))):
        d = blocks.select("g", "block", "items", "n").join(above, ["g", "block"])
        # the levels are bound to a name, so that they are made once a block
        nodes = f"transform(array({_ALL}), levels -> transform(items, (x, i) -> struct(x AS item, concat({_OWN}, path) AS path)))[0]"
        d = d.select("g", "block", *carried, F.expr(f"inline({nodes})"))
        if k:
            d = d.select("g", (F.col("block") * BLOCK + F.col("item.i")).alias("block"), "path", *carried)
        above = d
    return above.drop("block")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = COLUMNS, more: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of docs: id_col, leaf, subroot, root, path, and the columns of more, which are computed from docs.

    The leaf is the digest of columns. Leaves of one group ascend by id_col, null first and equal ids by leaf; wholly
    equal rows have places of their own beside each other. Groups ascend bytewise, null first. A group of one row has
    its leaf as subroot, a table of one group its subroot as root; an empty table gives an empty one. Texts are read
    once, hashed and not shuffled, however long; other columns of docs are not read, whatever their names.
    """
    more = more or {}
    leaves = docs.select(group_key(docs[group_col]).alias("g"), docs[id_col].alias("id"), digest([docs[c] for c in columns]).alias("digest"), F.struct(F.lit(0).alias("_"), *(c.alias(k) for k, c in more.items())).alias("more"))
    leaves = common.materialize(leaves, "leaves")
    rounds = climb(numbered(leaves, ["id", "digest"], "sorted"), "tree")
    roots = rounds[-1].select("g", F.col("top").alias("digest"))
    named = roots.select(F.lit("").alias("g"), F.col("g").alias("of"), "digest")
    crown = climb(numbered(named, ["of"], "roots"), "crown")
    start = crown[-1].select("g", F.array().cast("array<string>").alias("path"), F.col("top").alias("root"))
    tops = descend(crown, start).select(F.col("item.of").alias("g"), "path", F.col("item.digest").alias("subroot"), "root")
    out = descend(rounds, common.materialize(tops, "tops"))
    return out.select(F.col("item.id").alias(id_col), F.col("item.digest").alias("leaf"), "subroot", "root", "path", *(F.col(f"item.more.{k}").alias(k) for k in more))


def proof(path: Column) -> Column:
    """sha256 of the siblings of a path, from the leaf's level to the root's."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.substring(x, 2, 64)), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""

    def step(acc: Column, x: Column) -> Column:
        side, sibling = F.substring(x, 1, 1), F.substring(x, 2, 64)
        return F.sha2(F.when(side == "L", F.concat(sibling, acc)).otherwise(F.concat(acc, sibling)), 256)

    return F.aggregate(path, leaf, step)
