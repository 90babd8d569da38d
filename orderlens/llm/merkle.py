"""Merkle manifest: one digest for a whole dataset, and for every row a proof that it is in it.

Every row is a leaf.  The leaves of a group stand in order, and every two consecutive
nodes are hashed into their parent until one is left, the group's root; the groups'
roots are hashed together in the same way.

The place of a leaf in its group, as a binary number, says which nodes are above it.
Leaves are dealt to blocks of 2 ** ``BLOCK_LEVELS`` consecutive places.  Inside a block
the last digit of the place is grouped away again and again: nodes that differ in it
only become one row that holds their structs, so a block ends as one row with its nodes
nested in it.  Blocks are the leaves of the next, far smaller round.  Proofs go back
down: a transform over the nested structs adds each node's siblings to what
the block was handed from above, and explode turns the leaves into rows.  A block meets
what it was handed by grouping, not by a join, so that null groups need no care.

No task ever holds more than one block, whatever the size of a group.  Null groups and
null order keys come first; rows with equal order keys follow their digests, fully
equal rows get places next to each other.  An empty table has no rows and no root.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import stage
from orderlens.operators.joins import null_safe_join

#: A block holds 2 ** BLOCK_LEVELS nodes at most.
BLOCK_LEVELS = 8


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length, so that no two lists of values are written alike; null is ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*(field(v) for v in values))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, start, lambda h, s: digest(s["before"], h, s["after"]))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, from the leaf upwards and left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(rows: DataFrame, leaf_digest: Column, group: str, order: str, carry: dict[str, Column]) -> DataFrame:
    """``carry`` of every row with ``leaf``, ``subroot`` (its group's root), ``root`` and ``proof``.

    ``proof`` is an array of (before, after) from the leaf up to the root: the digests
    that stand before and after the node in its run, empty where there is none.
    """
    nodes = rows.select(
        F.col(group).alias("group"),
        F.col(order).alias("order"),
        leaf_digest.alias("digest"),
        F.struct(*(c.alias(n) for n, c in carry.items())).alias("item"),
    )
    nests, subroots = _grow(_placed(nodes, ["group"], ["order", "digest"]), ["group"])
    tops = subroots.select("digest", F.col("group").alias("order"), F.struct("group", "digest").alias("item"))
    upper, root = _grow(_placed(tops, [], ["order"]), [])

    handed = root.select(_none().alias("proof"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    of_groups = _descend(upper, [], handed)
    handed = of_groups.select(
        F.col("item.group").alias("group"), "proof", F.col("item.digest").alias("subroot"), "root"
    )
    out = _descend(nests, ["group"], handed)
    return out.select(*(F.col(f"item.{n}").alias(n) for n in carry), F.col("digest").alias("leaf"), "subroot", "root", "proof")


def _none() -> Column:
    return F.array().cast("array<struct<before:string,after:string>>")


def _placed(nodes: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """Nodes with ``at``, their place in their group from 0, and ``height``, the levels above them.

    Rows are dealt to ranges and written; numbers inside a range are shifted by the
    counts of the ranges before it, so a group may fill any number of tasks.
    """
    mixed = nodes.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    ranged = mixed.repartitionByRange(*groups, *order, "tie").withColumn("part", F.spark_partition_id())
    ranged = stage(ranged, "ranged")
    counts = ranged.groupBy(*groups, "part").agg(F.count("*").alias("own"))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        *groups, "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("shift"), F.sum("own").over(whole).alias("n")
    )
    inside = Window.partitionBy(*groups, "part").orderBy(*order, "tie")
    numbered = ranged.withColumn("nth", F.row_number().over(inside) - 1)
    placed = null_safe_join(numbered, shifts, [*groups, "part"])
    # the least number of halvings, rounding up, from n to 1
    height = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    return placed.select(*groups, (F.col("nth") + F.col("shift")).alias("at"), height.alias("height"), "digest", "item")


def _nested(nodes: DataFrame, groups: list[str]) -> DataFrame:
    """One row a block, with the digest of its top and its nodes nested in ``kids``.

    Rows are shuffled by block once; every grouping after that stays in its task.
    """
    leaf_node = F.struct("at", "digest", "item")
    keys = [*groups, "block", "height"]
    rows = nodes.select(*groups, F.shiftright("at", BLOCK_LEVELS).alias("block"), "height", "at", leaf_node.alias("node"))
    rows = rows.repartition(*groups, "block")
    for level in range(BLOCK_LEVELS):
        rows = rows.groupBy(*keys, F.shiftright("at", 1).alias("at")).agg(F.sort_array(F.collect_list("node")).alias("kids"))
        joined = F.sha2(F.array_join(F.transform("kids", lambda k: k["digest"]), ""), 256)
        top = F.when(F.col("height") > level, joined).otherwise(F.col("kids")[0]["digest"])
        rows = rows.withColumn("digest", top)
        if level < BLOCK_LEVELS - 1:
            rows = rows.select(*keys, "at", F.struct("at", "digest", "kids").alias("node"))
    return rows.select(*keys, "digest", "kids")


def _grow(nodes: DataFrame, groups: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every round, from the leaves up, and the last digest of each group."""
    highest, rounds = None, []
    while True:
        blocks = stage(_nested(nodes, groups), "nested")
        if highest is None:
            highest = blocks.agg(F.max("height")).first()[0] or 0
        rounds.append(blocks)
        if highest <= BLOCK_LEVELS * len(rounds):
            return rounds, blocks.select(*groups, "digest")
        left = F.greatest(F.col("height") - BLOCK_LEVELS, F.lit(0))
        nodes = blocks.select(*groups, F.col("block").alias("at"), left.alias("height"), "digest", F.struct("block").alias("item"))


def _proofs(kids: Column, height: Column, above: Column) -> Column:
    """(digest, item, proof) of all leaves nested in ``kids``, the run of nodes below a block's top.

    Goes down a level at a time; every node takes the proof of the one above it along.
    """
    runs = F.array(F.struct(kids.alias("kids"), above.alias("proof")))
    for level in range(BLOCK_LEVELS - 1, -1, -1):
        below = ["digest", "item"] if level == 0 else ["kids"]
        runs = F.flatten(F.transform(runs, _step(height > level, below)))
    return runs


def _step(hashed: Column, below: list[str]) -> Callable[[Column], Column]:
    """From a run to its nodes, each with its proof; a level at which nothing is hashed adds none."""
    return lambda run: _nodes(run, hashed, below)


def _nodes(run: Column, hashed: Column, below: list[str]) -> Column:

    def digests(side: Callable[[Column], Column]) -> Column:
        return F.array_join(F.transform(F.filter(run["kids"], side), lambda k: k["digest"]), "")

    def one(node: Column) -> Column:
        step = F.struct(
            digests(lambda k: k["at"] < node["at"]).alias("before"),
            digests(lambda k: k["at"] > node["at"]).alias("after"),
        )
        steps = F.when(hashed, F.array(step)).otherwise(_none())
        return F.struct(*(node[b].alias(b) for b in below), F.concat(steps, run["proof"]).alias("proof"))

    return F.transform(run["kids"], one)


def _descend(rounds: list[DataFrame], groups: list[str], handed: DataFrame) -> DataFrame:
    """(groups, item, digest, subroot, root, proof) of all leaves, from what each group was handed."""
    rest = ["proof", "subroot", "root"]
    handed = handed.select(*groups, F.lit(0).cast("long").alias("block"), *rest)
    for i, blocks in reversed(list(enumerate(rounds))):
        nest = blocks.select(*groups, "block", F.struct("height", "kids").alias("nest"))
        to = handed.select(*groups, "block", F.struct(*rest).alias("way"))
        both = nest.unionByName(to, allowMissingColumns=True).groupBy(*groups, "block")
        met = both.agg(F.first("nest", True).alias("nest"), F.first("way", True).alias("way"))
        each = F.explode(_proofs(F.col("nest.kids"), F.col("nest.height"), F.col("way.proof"))).alias("one")
        found = met.select(*groups, "way.subroot", "way.root", each)
        found = found.select(*groups, "one.item", "one.digest", "subroot", "root", "one.proof")
        if i == 0:
            return found
        handed = found.select(*groups, F.col("item.block").alias("block"), *rest)
    raise AssertionError("a tree has one round at least")
