"""Structural validation of records in wire form: a code for the first thing that is wrong, else null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.model import Obj, Type, Union, Vec
from lamella.tables import scratch, table


def first_error(t: Type, c: Column) -> Column:
    """Code of the first structural error below a value: BadOffset for a dictionary without keys or values,
    BadUnionTag for a tag the model doesn't know or whose record is missing; null when all is well."""
    if isinstance(t, Vec):
        if not isinstance(t.element, Obj | Union | Vec):
            return F.lit(None).cast("string")
        return F.get(F.filter(F.transform(c, lambda x: F.when(x.isNotNull(), first_error(t.element, x))), lambda e: e.isNotNull()), 0)
    if isinstance(t, Union):
        known = F.lit(None).cast("string")
        bad = F.lit(True)
        for m in t.members:
            mine = c["tag"] == t.tag_of(m.name)
            bad = bad & ~(mine & c[m.name].isNotNull())
            known = F.coalesce(known, F.when(mine & c[m.name].isNotNull(), first_error(m, c[m.name])))
        return F.when(c.isNotNull(), F.when(F.coalesce(bad, F.lit(True)), F.lit("BadUnionTag")).otherwise(known))
    if isinstance(t, Obj):
        found = [F.when(c["keys"].isNull() | c["values"].isNull(), F.lit("BadOffset"))] if t.dictionary else []
        found += [first_error(m.type, c[m.name]) for m in t.all_members if isinstance(m.type, Obj | Union | Vec)]
        return F.when(c.isNotNull(), F.coalesce(*found, F.lit(None).cast("string")))
    return F.lit(None).cast("string")


def depths(edges: DataFrame, *, node: str = "node", parent: str = "parent", max_depth: int = 128) -> DataFrame:
    """Depth of every node below the roots (parent null: depth 0) of an adjacency table, and its error: TooDeep beyond
    ``max_depth`` or in a cycle, which has no root. Of several ways to a node the shortest counts.

    Roots spread downwards: a node's distance to an ancestor doubles each round, so rounds grow with the logarithm of
    the depth. Each round is a join of written tables; no group is gathered, no level is worked out twice."""
    e = edges.select(F.col(node).alias("n"), F.col(parent).alias("p"))
    with scratch() as kept:
        # (n, a, d): n stands d below a; a is null where that is a root's own place above all
        hops = table(e.select("n", F.col("p").alias("a"), F.when(F.col("p").isNull(), 0).otherwise(1).alias("d")).distinct(), "hops")
        reach = 1
        while reach <= max_depth:
            upper = hops.select(F.col("n").alias("a"), F.col("a").alias("above"), F.col("d").alias("more"))
            longer = hops.join(upper, "a").select("n", F.col("above").alias("a"), (F.col("d") + F.col("more")).alias("d"))
            # Those that have arrived stay; of ways to one ancestor the shortest is enough.
            hops = table(hops.where("a is null").union(longer).where(F.col("d") <= max_depth).groupBy("n", "a").agg(F.min("d").alias("d")), "hops")
            reach *= 2
        found = table(hops.where("a is null").groupBy("n").agg(F.min("d").alias("depth")), "depths")
        kept.append(found)
    out = e.select("n").distinct().join(found, "n", "left")
    return out.select(F.col("n").alias(node), "depth", F.when(F.col("depth").isNull(), F.lit("TooDeep")).alias("error"))
