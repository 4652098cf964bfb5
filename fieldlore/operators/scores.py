"""Validation: inferred bounds against true ones, clusters against types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def field_ends(fields: DataFrame) -> DataFrame:
    """(msg_id, end) from fields (msg_id, pos, len): running sums of lengths."""
    w = Window.partitionBy("msg_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return fields.select("msg_id", "pos", F.sum("len").over(w).alias("end"))


def format_match(true_ends: DataFrame, inferred_ends: DataFrame) -> DataFrame:
    """The format match score of each message, from ends (msg_id, end) that include the message's own end.

    A true end inside the message is exact if it was inferred, else near if an inferred end lies in its scope, which reaches half-way
    to its neighbours; the score is the share of exact ends and of near ones damped by their deviation, times
    a penalty for too many or too few ends. Messages with one field have no score.
    """
    by = Window.partitionBy("msg_id").orderBy("end")
    last = Window.partitionBy("msg_id")
    t = true_ends.select("msg_id", "end").distinct()
    t = t.withColumn("size", F.max("end").over(last)).withColumn("l", F.lag("end").over(by)).withColumn("r", F.lead("end").over(by)).where("end < size")
    t = t.withColumn("l", F.coalesce("l", "end"))
    low = F.expr("CASE WHEN end - l <= 1 THEN end ELSE l + (end - l) DIV 2 END")
    high = F.expr("CASE WHEN r - end <= 1 THEN end ELSE end - 1 + (r - end) DIV 2 END")
    t = t.withColumn("low", low).withColumn("high", high)
    sizes = t.groupBy("msg_id").agg(F.max("size").alias("s"), F.count("*").alias("true_count"))
    i = inferred_ends.select("msg_id", F.col("end").alias("e")).distinct().join(sizes.select("msg_id", "s"), "msg_id").where("e > 0 AND e < s")
    counts = i.groupBy("msg_id").agg(F.count("*").alias("inferred_count"))
    exact = t.join(i.select("msg_id", F.col("e").alias("end")), ["msg_id", "end"], "left_semi")
    rest = t.join(i.select("msg_id", F.col("e").alias("end")), ["msg_id", "end"], "left_anti").where("low < high")
    near = rest.join(i, "msg_id").where("e BETWEEN low AND high").groupBy("msg_id", "end").agg(F.min(F.col("e") - F.col("end")).alias("off"))
    gain = near.groupBy("msg_id").agg(F.count("*").alias("near_count"), F.sum(F.exp(-F.pow(F.col("off") / 2.0, 2))).alias("near_gain"))
    out = sizes.join(counts, "msg_id", "left").join(exact.groupBy("msg_id").agg(F.count("*").alias("exact_count")), "msg_id", "left").join(gain, "msg_id", "left").fillna(0)
    score = F.exp(-F.pow((F.col("true_count") - F.col("inferred_count")) / F.col("true_count"), 2)) * (F.col("exact_count") + F.col("near_gain")) / F.col("true_count")
    return out.select("msg_id", "true_count", "inferred_count", "exact_count", "near_count", score.alias("score"))


def cluster_quality(df: DataFrame, cluster: str, kind: str) -> DataFrame:
    """For each cluster its most frequent type (ties: the first by name), precision and recall."""
    n = df.groupBy(cluster, kind).agg(F.count("*").alias("n"))
    of_kind = df.groupBy(kind).agg(F.count("*").alias("kind_total"))
    top = n.groupBy(cluster).agg(F.sum("n").alias("size"), F.min_by(F.struct(F.col(kind), F.col("n")), F.struct(-F.col("n"), F.col(kind))).alias("t"))
    top = top.select(cluster, "size", F.col(f"t.{kind}").alias(kind), F.col("t.n").alias("n"))
    return top.join(of_kind, kind).select(cluster, kind, "size", (F.col("n") / F.col("size")).alias("precision"), (F.col("n") / F.col("kind_total")).alias("recall"))


def pair_counts(df: DataFrame, cluster: str, kind: str, noise=None) -> DataFrame:
    """Pair-counting precision and recall; pairs with a noise element count as missed."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    real = df.where(F.col(cluster) != noise) if noise is not None else df
    a = real.groupBy(cluster).agg(F.count("*").alias("n")).agg(pairs("n").alias("found"))
    b = real.groupBy(cluster, kind).agg(F.count("*").alias("n")).agg(pairs("n").alias("tp"))
    c = df.groupBy(kind).agg(F.count("*").alias("n")).agg(pairs("n").alias("wanted"))
    row = a.crossJoin(b).crossJoin(c)  # one row each
    return row.select("tp", "found", "wanted", (F.col("tp") / F.col("found")).alias("precision"), (F.col("tp") / F.col("wanted")).alias("recall"))


def formats(fields: DataFrame) -> DataFrame:
    """(format, n, msg_id): each sequence of field lengths, how many messages have it, and the first of them."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct("pos", "len"))), lambda s: s["len"])
    f = fields.groupBy("msg_id").agg(F.array_join(seq.cast("array<string>"), ",").alias("format"))
    return f.groupBy("format").agg(F.count("*").alias("n"), F.min("msg_id").alias("msg_id"))


def overlays(true_fields: DataFrame, inferred_ends: DataFrame) -> DataFrame:
    """(msg_id, pos, code) of true fields (msg_id, pos, offset, length) against ends (msg_id, end).

    0 where both bounds were inferred and none between, k > 0 where k bounds lie inside, -1 where none does and a bound is missed.
    Every message starts with a bound.
    """
    ends = inferred_ends.select("msg_id", "end").union(true_fields.select("msg_id", F.lit(0).cast("bigint"))).distinct()
    t = true_fields.withColumn("z", F.col("offset") + F.col("length"))
    x = t.join(ends, "msg_id", "left").groupBy("msg_id", "pos").agg(F.count(F.when((F.col("end") > F.col("offset")) & (F.col("end") < F.col("z")), 1)).alias("k"), F.count(F.when((F.col("end") == F.col("offset")) | (F.col("end") == F.col("z")), 1)).alias("edges"))
    return x.select("msg_id", "pos", F.when(F.col("k") > 0, F.col("k")).when(F.col("edges") == 2, 0).otherwise(-1).cast("int").alias("code"))


def statistics(scores: DataFrame, by: str | None = None) -> DataFrame:
    """(least, centre, most, median, mean, spread, n) of scores (score); centre is the score nearest the mean, the smaller on ties."""
    key = [by] if by else []
    mean = scores.where("score IS NOT NULL").groupBy(*key).agg(F.round(F.avg("score"), 9).alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"), F.median("score").alias("median"), F.stddev_pop("score").alias("spread"), F.count("*").alias("n"))
    x = scores.where("score IS NOT NULL").select(*key, "score").distinct()
    x = x.join(mean.select(*key, "mean"), by) if by else x.join(mean.select("mean"))
    near = x.groupBy(*key).agg(F.min(F.struct(F.abs(F.col("score") - F.col("mean")).alias("off"), "score")).alias("m")).select(*key, F.col("m.score").alias("centre"))
    return mean.join(near, by) if by else mean.join(near)


def by_score(scores: DataFrame, digits: int = 3) -> DataFrame:
    """(score, n, msg_id): messages of each rounded score and the first of them."""
    return scores.groupBy(F.round("score", digits).alias("score")).agg(F.count("*").alias("n"), F.min("msg_id").alias("msg_id"))
