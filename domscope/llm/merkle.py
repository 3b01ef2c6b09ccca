"""A Merkle manifest of a data set: a leaf for each row, a tree for each value of a column, and a tree over their roots.

Bottom-up, aligned runs of 2^STEP consecutive nodes meet in one row, which holds the levels within; their tops
are the nodes of the next step, until a tree has one node. Each step is stored. Top-down, the stored runs join the proof
suffix that their top has inherited, and each node prepends its siblings within the run. So a row's proof is put
together where its run is: what is shuffled is leaves (once to sort, once to meet in runs) and one suffix for each run.

Digests are SHA-256 in lower-case hex; a parent's is that of its children's, concatenated as text. Of the nodes of a level, every
two consecutive ones have a parent, and so has the last one if it is alone. A tree of one node is that node.

A field's null is ``-``, other values are their length in UTF-8 bytes, ``:`` and the value as a string, so no two rows that differ in a
field share a leaf. Null trees and null keys come first in their order. Rows that share tree and key are ordered by leaf; equal rows
have equal leaves, each with a proof of its own. Empty texts have length 0; very long ones are hashed whole. An empty
table gives an empty result. Columns beside those asked for are left out, and columns to keep are carried in
a struct, so no name clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, written

#: Levels in a stored run, which has 2^STEP nodes at most: 1024 of 64 characters.
STEP = 10


def field(c: Column) -> Column:
    """A value so written that values and their borders can be told apart."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """The leaf of a row with these values, in this order."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows``, stored, with ``at`` (from 0, within its ``tree``, by ``order``, nulls first) and ``of``, the number of rows of
    the tree. Rows are range-partitioned and sorted over all trees together, so a tree may fill many partitions or a part of one."""
    by = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    kept = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("id", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("id", 33)
    whole = Window.partitionBy(tree)
    parts = kept.groupBy(tree, part.alias("part")).agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    parts = parts.select(F.col(tree).alias("t"), "part", "low", F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.sum("n").over(whole).alias("of"))
    joined = kept.join(parts, F.col(tree).eqNullSafe(F.col("t")) & (part == F.col("part")))
    out = joined.select(*rows.columns, (F.col("id") - F.col("low") + F.coalesce("before", F.lit(0))).alias("at"), "of")
    out.scratch = kept.scratch
    return out


def _digest(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def _levels(nodes: Column, of: Column) -> Column:
    """The levels of a run from its nodes up, each an array: STEP parents' levels, or fewer where one run is the whole tree."""
    up = F.when(of == 1, 0).otherwise(F.least(F.lit(STEP), F.length(F.bin(of - 1))))
    runs = lambda level: F.transform(F.sequence(F.lit(0), F.ceil(F.size(level) / 2).cast("int") - 1), lambda k: _digest(F.slice(level, k * 2 + 1, F.lit(2))))
    steps = F.when(up > 0, F.sequence(F.lit(1), up)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(nodes), lambda levels, _: F.concat(levels, F.array(runs(F.element_at(levels, -1)))))


def _runs(nodes: DataFrame) -> DataFrame:
    """tree, run, of, members array<struct<at, node, kept>>, levels: stored. ``nodes`` has tree, at, of, node, kept."""
    met = nodes.groupBy("tree", F.shiftright("at", STEP).alias("run"), "of").agg(F.array_sort(F.collect_list(F.struct("at", "node", "kept"))).alias("members"))
    return written(met.withColumn("levels", _levels(F.col("members.node"), F.col("of"))), "levels")


def _steps(nodes: DataFrame) -> list[DataFrame]:
    """The stored runs of every step, until each tree is one run. A tree that is one run earlier goes no further."""
    steps = [_runs(nodes)]
    while not (more := steps[-1].where(F.col("of") > 1 << STEP)).isEmpty():
        top = F.element_at(F.element_at("levels", -1), 1)
        steps.append(_runs(more.select("tree", F.col("run").alias("at"), F.ceil(F.col("of") / (1 << STEP)).alias("of"), top.alias("node"), F.lit(None).cast("string").alias("kept"))))
    return steps


def _roots(steps: list[DataFrame]) -> DataFrame:
    """tree, node: what remains of each tree."""
    tops = [s.where(F.col("of") <= 1 << STEP).select("tree", F.element_at(F.element_at("levels", -1), 1).alias("node")) for s in steps]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _siblings() -> Column:
    """Of the member ``m`` of a run: a step for each level, array<struct<node, left>>; node is null where a parent has one child."""
    place = lambda level: F.call_function("shiftright", (F.col("m.at") % (1 << STEP)).cast("int"), level)

    def step(nodes: Column, level: Column) -> Column:
        beside = place(level).bitwiseXOR(F.lit(1))
        return F.struct(F.try_element_at(nodes, beside + 1).alias("node"), (beside < place(level)).alias("left"))

    return F.transform(F.slice("levels", 1, F.size("levels") - 1), step)


def _pushed(runs: DataFrame, suffix: DataFrame, by: Column) -> DataFrame:
    """tree, at, node, kept, proof, above of each member of ``runs``. ``suffix``, joined by ``by``, has the
    columns inherited (a proof) and above (what else comes down)."""
    held = runs.select("tree", "run", "levels", "members").join(suffix, by)
    each = held.select("tree", "run", "levels", "inherited", "above", F.explode("members").alias("m"))
    return each.select("tree", "m.at", "m.node", "m.kept", F.concat(_siblings(), "inherited").alias("proof"), "above")


def _down(steps: list[DataFrame], suffix: DataFrame) -> DataFrame:
    """The members of the first step with their proofs; ``suffix`` has t, inherited, above of each tree's top."""
    one, pushed = F.col("of") <= 1 << STEP, None
    for s in reversed(steps):
        out = _pushed(s.where(one), suffix, F.col("tree").eqNullSafe(F.col("t")))
        if pushed is not None:
            over = pushed.select(F.col("tree").alias("t"), F.col("at").alias("up"), F.col("proof").alias("inherited"), "above")
            out = out.unionByName(_pushed(s.where(~one), over, F.col("tree").eqNullSafe(F.col("t")) & (F.col("run") == F.col("up"))))
        pushed = out
    return pushed


def manifest(docs: DataFrame, leaf: Column, tree: str, key: str, keep: dict[str, Column] | None = None) -> DataFrame:
    """Per row of ``docs`` the columns of ``keep`` (by default the key), leaf, subroot (that of its tree), root and
    proof array<struct<node, left>>, from the leaf up to the root: the sibling beside the path, null where there is
    none, and whether it stands left of the path.

    ``leaf`` is the leaf's digest (see leaf_of()); trees are the values of ``tree``, their leaves are ordered by
    ``key``, and their roots by the tree's value, as binary strings."""
    keep = {key: F.col(f"`{key}`")} if keep is None else keep
    rows = docs.select(F.col(f"`{tree}`").cast("string").alias("tree"), F.col(f"`{key}`").alias("key"), leaf.alias("node"), F.struct(*[v.alias(f"c{k}") for k, v in enumerate(keep.values())]).alias("kept"))
    leaves = numbered(rows, "tree", ["key", "node"])
    steps = _steps(leaves.drop("key"))
    roots = numbered(_roots(steps).select(F.lit("").alias("all"), "tree", "node"), "all", ["tree"])
    top = _steps(roots.select(F.col("all").alias("tree"), "at", "of", "node", F.col("tree").alias("kept")))
    root = _roots(top).select("tree", F.col("node").alias("root"))
    start = root.select(F.col("tree").alias("t"), F.array().cast("array<struct<node: string, left: boolean>>").alias("inherited"), F.struct("root", F.col("root").alias("subroot")).alias("above"))
    trees = _down(top, start).select(F.col("kept").alias("t"), F.col("proof").alias("inherited"), F.struct("above.root", F.col("node").alias("subroot")).alias("above"))
    trees = written(trees, "trees")
    forget(leaves, roots, *top)
    out = _down(steps, trees)
    kept = [F.col(f"kept.c{k}").alias(name) for k, name in enumerate(keep)]
    return out.select(*kept, F.col("node").alias("leaf"), "above.subroot", "above.root", "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and ``proof`` give."""

    def up(node: Column, step: Column) -> Column:
        beside = F.coalesce(step["node"], F.lit(""))
        return F.sha2(F.when(step["left"], F.concat(beside, node)).otherwise(F.concat(node, beside)), 256)

    return F.aggregate(proof, leaf, up)


def siblings_digest(proof: Column) -> Column:
    """The digest of a proof's siblings, from the leaf up."""
    return F.sha2(F.array_join(proof["node"], ""), 256)
