"""Connected components over an edge table, by alternating large and small stars.

Each round replaces an edge table by a smaller-depth one with the same components: first every node hangs its larger
neighbours on its smallest one, then every node hangs its smaller neighbours there. Minima are partial aggregates, and
what a node with very many edges hangs them on is sent to every task, so that its edges are not gathered anywhere; each
table is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlore.llm.shared import drop, lookup, save

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b), a saved table; the component is its smallest node. Loops, repeated and reversed edges are fine; nodes without an edge to another one have no row."""
    spark = edges.sparkSession
    e = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(ROUNDS):
        state = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if not state[0] or state == before:
            break
        before = state
        both = e.union(e.select("v", "u"))
        low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"), F.count("*").alias("n")).select("k", F.least("k", "m").alias("m"), "n")
        # u > v: v hangs its larger neighbours u on its own minimum; a smallest node keeps them, and every node keeps its smallest neighbour
        large = lookup(e.select("u", F.col("v").alias("k")), low, ["k"], 2 * state[0]).select("u", "m").union(low.where("m < k").select("k", "m"))
        large = save(large.toDF("u", "v").distinct(), "edges")
        least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = lookup(large.select(F.col("u").alias("k"), "v"), least, ["k"], 2 * state[0]).where("v <> m").select("v", "m").union(least.select("k", "m"))
        after = save(small.toDF("u", "v").where("u <> v").distinct(), "edges")
        drop(spark, e, large)
        e = after
    else:
        raise RuntimeError(f"no components after {ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())


def joined_by(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after more links (a, b) between nodes, old or new, as a saved table. Only labels that the links touch are joined."""
    spark = found.sparkSession
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found.select("node"), "node", "left_anti")
    whole = save(found.union(ends.select("node", F.col("node").alias("component"))), "components")
    label = lambda of, to: whole.select(F.col("node").alias(of), F.col("component").alias(to))
    touched = save(components(links.join(label("a", "x"), "a").join(label("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))), "components")
    size = whole.groupBy("component").agg(F.count("*").alias("n"))
    new = size.join(touched.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").withColumn("to", F.coalesce("to", "component"))
    out = save(lookup(whole, new, ["component"], whole.count()).select("node", F.col("to").alias("component")), "components")
    drop(spark, whole, touched)
    return out
