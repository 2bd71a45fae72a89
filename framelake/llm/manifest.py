"""Operator 13: a Merkle manifest of a table, level by level with windows over runs of siblings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.shared import cut, lookup_side

#: Siblings before and after a node in its run, as hex digests one after another.
STEP = "array<struct<before:string,after:string>>"
#: A constant that the tables of nodes hold for every node: its group's size, its place, its digest.
NODE = ("g", "n", "i", "node")


def field(c: Column) -> Column:
    """A value as the leaf hashes it: `-` if null, else its length in UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(*values: Column) -> Column:
    """Lowercase hex sha256 of the fields, one after another."""
    return F.sha2(F.concat(*map(field, values)), 256)


def group_key(c: Column) -> Column:
    """A group's name that is never null and sorts like the group: null first, then by UTF-8 bytes."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), s))


def numbered(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """df written with n, the rows of each row's group, and i, its place there from 0 by `order`; a hot group is spread over tasks.

    Rows are sorted by ranges over all groups at once. A group's rows in one task are consecutive, so that a
    place is the distance from the first of them, and the rows of the group in the tasks before.
    """
    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = cut(ranged.withColumns({"_at": F.monotonically_increasing_id(), "_task": F.spark_partition_id()}))
    held = placed.groupBy(F.col(group).alias("_g"), F.col("_task").alias("_t")).agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    w = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_c").over(w.orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = cut(held.select("_g", "_t", "_first", before.alias("_before"), F.sum("_c").over(w).alias("n")))
    j = placed.join(lookup_side(held), (F.col(group) == F.col("_g")) & (F.col("_task") == F.col("_t")))
    return j.withColumn("i", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_task", "_g", "_t", "_first", "_before")


def _runs(nodes: DataFrame, fanout: int) -> DataFrame:
    """nodes of groups that have more than one, with `up`, the place of the parent, and `run`, the digests of all siblings in order."""
    w = Window.partitionBy("g", "up").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.where("n > 1").withColumn("up", F.floor(F.col("i") / fanout)).withColumn("run", F.collect_list("node").over(w))


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """The level above: each run's digest, once."""
    up = _runs(nodes, fanout).select("g", F.ceil(F.col("n") / fanout).alias("n"), F.col("up").alias("i"), F.sha2(F.array_join("run", ""), 256).alias("node"))
    return up.dropDuplicates(["g", "i"])


def _levels(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """The nodes themselves and every level above them, each written, until every group has one node."""
    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        out.append(cut(_parents(out[-1].select(*NODE), fanout)))
        most = -(-most // fanout)
    return out


def _roots(levels: list[DataFrame]) -> DataFrame:
    """(g, node): the one node that remains of each group."""
    out = levels[0].where("n = 1").select("g", "node")
    for up in levels[1:]:
        out = out.unionByName(up.where("n = 1").select("g", "node"))
    return out


def _paths(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """levels[0] with `proof`, its siblings level by level up to its group's root and on as tops (g, and what else they carry, with `proof`) say.

    Proofs come down from the top: a node takes its parent's behind its own siblings. A parent has at most
    `fanout` children, and a group's top is one row, so no join has a hot key.
    """
    carried = [c for c in tops.columns if c not in ("g", "proof")]
    above = None
    for level, nodes in reversed(list(enumerate(levels))):
        kept = [c for c in nodes.columns if c not in NODE] if level == 0 else []
        end = nodes.where("n = 1").join(tops, "g").select("g", "i", "node", *kept, *carried, "proof")
        if above is not None:
            own = F.struct(*(F.array_join(part, "").alias(name) for name, part in (
                ("before", F.slice("run", 1, (F.col("i") % fanout).cast("int"))), ("after", F.slice("run", (F.col("i") % fanout + 2).cast("int"), fanout)))))
            upper = above.select("g", F.col("i").alias("up"), *carried, F.col("proof").alias("_rest"))
            inner = _runs(nodes, fanout).join(upper, ["g", "up"]).select("g", "i", "node", *kept, *carried, F.concat(F.array(own), "_rest").alias("proof"))
            end = end.unionByName(inner)
        above = end if level == 0 else cut(end)
    return above


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """Lowercase hex sha256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def merkle_manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), order: str = "doc_id", group: str = "source",
                    carry: dict[str, Column] | None = None, fanout: int = 16) -> DataFrame:
    """(order, leaf, subroot, root, proof, carried): a Merkle tree over each group's rows, and one over the groups' roots.

    A leaf hashes the row's columns. A group's leaves ascend by `order`, rows that share it by their digests; runs of
    `fanout` become their digest, level by level, until one node remains, the group's subroot (a lone leaf is
    its own). Subroots, ordered by group (null first, then by UTF-8 bytes), give the root likewise. `proof` holds
    the siblings before and after the node at each level, via the subroot to the root; folded() checks it.
    carry names more columns, made of docs where the texts are still there. Texts are read once; what is
    shuffled are digests.

    Nulls hash as `-` in any column, so a null text and an empty one differ; a null order comes first, a null
    group is a group of its own. Repeated rows are leaves of their own with equal digests. A table of one row has
    one leaf for a root and an empty proof; an empty table gives an empty result. Other columns of docs, whatever
    their names, take no part.
    """
    carry = carry or {}
    rows = cut(docs.select(F.col(order).alias("_order"), group_key(F.col(group)).alias("g"), leaf(*map(F.col, columns)).alias("node"), F.struct(
        F.lit(0).alias("_"), *(c.alias(n) for n, c in carry.items())).alias("_carry")))
    leaves = cut(numbered(rows, "g", ["_order", "node"]))
    levels = _levels(leaves, fanout)
    subroots = numbered(cut(_roots(levels).select(F.lit("").alias("_all"), F.col("g").alias("_group"), "node")), "_all", ["_group"])
    upper = _levels(cut(subroots.select(F.col("_all").alias("g"), "n", "i", "node", "_group")), fanout)
    root = _roots(upper).select("g", F.col("node").alias("root"), F.array().cast(STEP).alias("proof"))
    tops = cut(_paths(upper, root, fanout).select(F.col("_group").alias("g"), F.col("node").alias("subroot"), "root", "proof"))
    out = _paths(levels, tops, fanout)
    return out.select(F.col("_order").alias(order), F.col("node").alias("leaf"), "subroot", "root", "proof", *(F.col(f"_carry.{n}").alias(n) for n in carry))
