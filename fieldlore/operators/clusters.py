"""Clusters (id, label) over distances (i, j, d), i < j, and occurrences (id, n): shapes, occurrences, links, splits.

Label -1 is noise and left out unless said otherwise. Inside a cluster, ties go to the smaller id.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlore.operators import pairwise as P


def sizes(labels: DataFrame) -> DataFrame:
    """(label, size, share): members of each cluster, noise first, and their share of all."""
    n = labels.groupBy("label").agg(F.count("*").alias("size"))
    return n.withColumn("share", F.col("size") / F.sum("size").over(Window.partitionBy(F.lit(0)))).orderBy("label")


def inside(d: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, i, j, d) of pairs inside a cluster."""
    a, b = labels.where("label <> -1").select(F.col("id").alias("i"), "label"), labels.select(F.col("id").alias("j"), F.col("label").alias("_l"))
    return d.join(a, "i").join(b, "j").where("label = _l").select("label", "i", "j", "d")


def nearest(d: DataFrame) -> DataFrame:
    """(i, j, d): each value's nearest other one."""
    best = P.symmetric(d).groupBy("i").agg(F.min(F.struct("d", "j")).alias("m"))
    return best.select("i", "m.j", "m.d")


def adjusted_eps(eps: float, y: float) -> float:
    """A density radius corrected by the last maximum of the difference curve."""
    return eps * (16 * y * y - 10 * y + 1.8)


def regular(labels: DataFrame, least: int = 3) -> DataFrame:
    """(label, values, regular): a cluster of more than least distinct values is regular."""
    return labels.where("label <> -1").groupBy("label").agg(F.count_distinct("id").alias("values")).withColumn("regular", F.col("values") > least)


def occurrences(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, values, total, rank, spread): values, occurrences in all, the percentile rank of the logarithm of that among the values' occurrences, and their deviation.

    The rank is the mean of the shares below and up to the logarithm.
    """
    x = labels.where("label <> -1").join(counts, "id")
    x = x.withColumn("ln", F.log(F.sum("n").over(Window.partitionBy("label"))))
    below = F.avg((F.col("n") < F.col("ln")).cast("double") + (F.col("n") <= F.col("ln")).cast("double")) * 50
    return x.groupBy("label").agg(F.count("*").alias("values"), F.sum("n").alias("total"), below.alias("rank"), F.stddev_pop("n").alias("spread"))


def split_by_occurrence(labels: DataFrame, counts: DataFrame, rank: float = 95) -> DataFrame:
    """(id, label, often): clusters with a high rank and a deviation over the logarithm of their occurrences are cut at that logarithm."""
    o = occurrences(labels, counts).withColumn("cut", (F.col("rank") > rank) & (F.col("spread") > F.log("total"))).select("label", "cut", "total")
    x = labels.where("label <> -1").join(counts, "id").join(o, "label")
    return x.select("id", "label", (F.col("cut") & (F.col("n") > F.log("total"))).alias("often"))


def remotest(d: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, a, c): the member with the largest sum of distances, and the one farthest from it."""
    s = _both(inside(d, labels))
    sums = s.groupBy("label", "i").agg(F.round(F.sum("d"), 9).alias("s"))
    a = sums.groupBy("label").agg(F.min(F.struct((-F.col("s")).alias("s"), "i")).alias("m")).select("label", F.col("m.i").alias("a"))
    far = s.join(a, "label").where("i = a").groupBy("label", "a").agg(F.min(F.struct((-F.col("d")).alias("d"), "j")).alias("m"))
    return far.select("label", "a", F.col("m.j").alias("c"))


def _both(x: DataFrame) -> DataFrame:
    return x.union(x.select("label", F.col("j").alias("i"), F.col("i").alias("j"), "d"))


def detours(d: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, b, detour): what the way between the remotest pair grows by over each other member."""
    s = _both(inside(d, labels))
    r = remotest(d, labels)
    ac = s.join(r, "label").where("i = a AND j = c").select("label", F.col("d").alias("ac"))
    ab = s.join(r, "label").where("i = a AND j <> c").select("label", F.col("j").alias("b"), F.col("d").alias("ab"))
    bc = s.join(r, "label").where("j = c AND i <> a").select("label", F.col("i").alias("b"), F.col("d").alias("bc"))
    return ab.join(bc, ["label", "b"]).join(ac, "label").select("label", "b", (F.col("ab") + F.col("bc") - F.col("ac")).alias("detour"))


def trace_means(d: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, step, mean): members in order of distance from one end of the remotest pair; mean distance of members step places apart."""
    s = _both(inside(d, labels))
    r = remotest(d, labels)
    start = r.select("label", F.col("a").alias("id"), F.lit(0.0).alias("d"))
    rest = s.join(r, "label").where("i = a").select("label", F.col("j").alias("id"), "d")
    place = start.union(rest).withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("d", "id"))).drop("d")
    x = inside(d, labels).join(place.select("label", F.col("id").alias("i"), F.col("r").alias("ri")), ["label", "i"])
    x = x.join(place.select("label", F.col("id").alias("j"), F.col("r").alias("rj")), ["label", "j"])
    return x.groupBy("label", F.abs(F.col("ri") - F.col("rj")).alias("step")).agg(F.avg("d").alias("mean"))


def links(d: DataFrame, labels: DataFrame) -> DataFrame:
    """(p, q, least, most, mean) of distances between two clusters, p < q."""
    a = labels.where("label <> -1")
    x = d.join(a.select(F.col("id").alias("i"), F.col("label").alias("li")), "i").join(a.select(F.col("id").alias("j"), F.col("label").alias("lj")), "j").where("li <> lj")
    return x.groupBy(F.least("li", "lj").alias("p"), F.greatest("li", "lj").alias("q")).agg(F.min("d").alias("least"), F.max("d").alias("most"), F.avg("d").alias("mean"))


def ecdf(d: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, d, share): the share of a cluster's distances up to each."""
    n = inside(d, labels).groupBy("label", "d").agg(F.count("*").alias("n"))
    w = Window.partitionBy("label")
    return n.select("label", "d", (F.sum("n").over(w.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w)).alias("share"))


def type_counts(df: DataFrame, cluster: str, kind: str) -> DataFrame:
    """(cluster, kind, n, share) of each type in each cluster."""
    n = df.groupBy(cluster, kind).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(cluster)))


def template_label(df: DataFrame, cluster: str, kind: str) -> DataFrame:
    """(cluster, name): the type that all members have, [mixed] for several, [unknown] where none is given."""
    t = df.groupBy(cluster).agg(F.min(kind).alias("a"), F.max(kind).alias("z"))
    return t.select(cluster, F.when(F.col("a").isNull(), "[unknown]").when(F.col("a") == F.col("z"), F.col("a")).otherwise("[mixed]").alias("name"))


def least_size(labels: DataFrame, messages: int) -> DataFrame:
    """(id, label): clusters of fewer members than the logarithm of the number of messages become noise."""
    n = labels.groupBy("label").agg(F.count("*").alias("_n"))
    return labels.join(n, "label").select("id", F.when(F.col("_n") < math.log(max(messages, 1)), -1).otherwise(F.col("label")).alias("label"))


def columns(aligned: DataFrame) -> DataFrame:
    """(label, col, values, gaps, kind, bytes) of aligned messages (label, msg_id, col, bytes; null for a gap).

    A column with one value is static, with several dynamic, with none a gap.
    """
    g = aligned.groupBy("label", "col").agg(F.count_distinct("bytes").alias("values"), F.count(F.when(F.col("bytes").isNull(), 1)).alias("gaps"), F.min("bytes").alias("bytes"))
    kind = F.when(F.col("values") == 1, "static").when(F.col("values") > 1, "dynamic").otherwise("gap")
    return g.select("label", "col", "values", "gaps", kind.alias("kind"), F.when(F.col("values") == 1, F.col("bytes")).alias("bytes"))


def discriminators(aligned: DataFrame) -> DataFrame:
    """Static columns without gaps whose value differs between clusters."""
    s = columns(aligned).where("kind = 'static' AND gaps = 0")
    several = s.groupBy("col").agg(F.count_distinct("bytes").alias("_n")).where("_n > 1").select("col")
    return s.join(several, "col", "left_semi").select("label", "col", "bytes")
