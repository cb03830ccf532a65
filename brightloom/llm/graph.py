"""Connected components by alternating large and small stars, all on the executors."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _fresh(key: str):
    """The key as an expression that hides its partitioning: the join then deals both sides anew, and adaptive
    execution can split a hot key."""
    return F.col(key).bitwiseXOR(F.lit(0).cast("long"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Large: every node hangs its larger neighbours on the least of its neighbours and itself. Small:
    every node hangs its smaller neighbours and itself on the least of them."""
    low, high = F.least("u", "v"), F.greatest("u", "v")
    ends = [F.struct(high.alias("n"), low.alias("o"))] + ([F.struct(low.alias("n"), high.alias("o"))] if large else [])
    sides = edges.select(F.explode(F.array(*ends)).alias("e")).select("e.n", "e.o")
    least = sides.groupBy("n").agg(F.min("o").alias("m")).select(_fresh("n").alias("k"), F.least("m", _fresh("n")).alias("m"))
    met = sides.join(least.hint("merge"), F.col("n") == F.col("k"))
    if large:
        out = met.filter("o > n").select(F.col("o").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.explode(F.array("n", "o")).alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v")


def components(work: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for every node in the edges (u, v: long); component is the least node reachable.

    Edges with a null end are ignored, loops and repeats are allowed. The number of rounds grows with the logarithm
    of the longest path and is not limited: every round but the last brings an edge nearer to its root. Each round writes its edges to the shared folder."""
    seen = None
    now = work.save(
        edges.filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}0")
    for k in count(1):
        wide = work.save(_star(now, True), f"{name}{k}w")
        new = work.save(_star(wide, False), f"{name}{k}")
        work.drop(f"{name}{k - 1}", f"{name}{k}w")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = new
        if mark == seen:
            break
        seen = mark
    roots = now.groupBy("v").agg(F.lit(1).alias("one")).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
