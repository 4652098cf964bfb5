"""Cutting lineage: checkpoints in the folder that the session names, and connected components that need them."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlore.functions import nearby

#: Rounds at most; edges that one task joins.
ROUNDS, FEW = 60, 1_000_000


def checkpoints(spark: SparkSession) -> str:
    """The checkpoint folder: the one that is set, else what spark.checkpoint.dir names, else, where all runs on this machine (tests), a local one."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not named and not jsc.isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or f"file://{tempfile.gettempdir()}/checkpoints")
    return jsc.getCheckpointDir().get()


def once(df: DataFrame) -> DataFrame:
    """df computed now and read back from a checkpoint from now on."""
    checkpoints(df.sparkSession)
    return df.checkpoint()


def _joined(batches):
    """Components of all edges of a task."""
    rows = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not rows:
        return
    u, v = (np.concatenate(x) for x in zip(*rows, strict=True))
    nodes, component = nearby.joined(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(component)], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b): each node that has an edge to another one, with the smallest node of its component.

    Stars by turns: every node passes its smallest neighbour on to the larger ones, then its own smallest to the rest, so
    that paths halve and the rounds grow with the logarithm of the longest.
    """
    e = once(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if e.count() <= FEW:
        kind = e.schema["u"].dataType.simpleString()
        return once(e.repartition(1).mapInArrow(_joined, f"node {kind}, component {kind}"))
    before = None
    for _ in range(ROUNDS):
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if not now[0] or now == before:
            break
        before = now
        low = e.union(e.select("v", "u")).groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = e.join(low, F.col("v") == F.col("k")).select("u", "m").union(low.where("m < k")).toDF("u", "v").distinct()
        least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("k")).where("v <> m").select("v", "m").union(least)
        e = once(small.toDF("u", "v").where("u <> v").distinct())
    else:
        raise RuntimeError(f"no components after {ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
