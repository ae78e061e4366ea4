"""Connected components of an edge table, with DataFrame operations only.

Alternating large-star and small-star rounds: every vertex links its larger (or its smaller and
equal) neighbours to the least vertex it sees, until nothing changes.  The number of rounds grows
with the logarithm of the largest component's size.  A hub is never gathered: its minimum is a partial
aggregate that is joined back on a wrapped key, so both sides of the join come straight from an exchange
and adaptive execution can split a hub's edges (``operators.small.join_per_key``).  Every round is a stored
table, so a lost executor costs one round.  The search ends when the edges are stars: no node has two roots, and
no root has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelspark.llm.scratch import stored
from panelspark.operators.small import join_per_key


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round; edges are (u, v) with u > v.  The large star may repeat edges."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        # v > u is linked to u's least neighbour; the edge's larger end is v, so join on the smaller end
        linked = join_per_key(edges.select(F.col("v").alias("c"), F.col("u").alias("x")), least, "c")
        return linked.select(F.col("x").alias("u"), F.col("m").alias("v")).where("u > v")
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = join_per_key(edges, least, "u").select("u", "v", "m")
    to = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
    return linked.select(to).select("e.u", "e.v").where("u > v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node of the distinct edges (u, v) has one root v, and no root has one itself."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")
    seen = edges.select(ends).groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("root"))
    return seen.where("ups > 1 or (ups = 1 and root = 0)").isEmpty()


def components(edges: DataFrame, a: str, b: str, contract=None) -> DataFrame:
    """(node, root) for every node of an edge (a, b); root is the component's least node.

    ``contract``: a function for ``mapInArrow`` that replaces a task's edges (u, v) by stars around the least node of
    each of their components; it saves rounds and exchanges nothing.  Self-loops and NULL ends are left out;
    an empty edge table gives an empty result."""
    def contracted(df: DataFrame) -> DataFrame:
        return df.mapInArrow(contract, df.schema) if contract else df

    now = stored(contracted(edges.where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`")
                            .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))).distinct(), "edges")
    while not _stars(now):
        now = stored(_star(stored(_star(contracted(now), True), "large"), False), "small")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
