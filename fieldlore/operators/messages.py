"""Trace preparation: row-level filters and counts over messages (msg_id, seq, data)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlore.functions import series as S


def deduplicate(df: DataFrame, limit: int | None = None) -> DataFrame:
    """The last message of each payload, in the order in which payloads first came: (msg_id, seq, data, first_seq)."""
    out = df.groupBy("data").agg(F.max_by("msg_id", "seq").alias("msg_id"), F.max("seq").alias("seq"), F.min("seq").alias("first_seq"))
    out = out.select("msg_id", "seq", "data", "first_seq")
    return out.orderBy("first_seq").limit(limit) if limit else out


def lengths(df: DataFrame) -> DataFrame:
    """Longest payload and bytes in all."""
    return df.agg(F.max(F.octet_length("data")).alias("longest"), F.sum(F.octet_length("data")).alias("total"))


def byte_frequency(df: DataFrame) -> DataFrame:
    return df.select(F.explode(S.values(F.col("data"))).alias("byte")).groupBy("byte").agg(F.count("*").alias("n"))


def mean_byte_difference(df: DataFrame) -> DataFrame:
    """Mean over messages of the mean difference of neighbouring bytes, which is (last - first) / (n - 1)."""
    v = S.values(F.col("data"))
    return df.where(F.octet_length("data") > 1).agg(F.avg((F.element_at(v, -1) - F.element_at(v, 1)) / (F.size(v) - 1)).alias("mean_difference"))


def useful_segments(segments: DataFrame) -> DataFrame:
    """Distinct values of segments of three bytes or more that aren't all zero, with their first message."""
    v = S.values(F.col("bytes"))
    return segments.where((F.col("length") > 2) & F.exists(v, lambda x: x != 0)).groupBy("bytes", "length").agg(F.min("msg_id").alias("msg_id"), F.count("*").alias("n"))


def containing(df: DataFrame, pattern: bytes, column: str = "data") -> DataFrame:
    return df.where(F.position(F.lit(pattern), F.col(column)) > 0)


def commonality(segments: DataFrame) -> DataFrame:
    """For each message the median of how often its segments' values occur in all."""
    counts = segments.groupBy("bytes").agg(F.count("*").alias("n"))
    return segments.join(counts, "bytes").groupBy("msg_id").agg(F.median("n").alias("commonality"))


def common_values(segments: DataFrame, messages: int, share: float = 0.1) -> DataFrame:
    """Values of two bytes or more in over share of the messages' number, not all zero, that hold no other such value."""
    n = segments.groupBy("bytes").agg(F.count("*").alias("n"), F.max("length").alias("length"))
    often = n.where((F.col("n") > share * messages) & (F.col("length") >= 2) & F.exists(S.values(F.col("bytes")), lambda x: x != 0))
    # who holds another one is found by the runs of bytes of each length that occurs
    lengths = sorted(r[0] for r in often.select("length").distinct().collect())
    if len(lengths) < 2:
        return often.select("bytes", "n")
    from fieldlore.operators.segmentation import substrings

    held = often.select(F.col("bytes").alias("outer"), F.inline(substrings(lengths))).where(F.col("outer") != F.col("value"))
    outer = held.join(often.select(F.col("bytes").alias("value")), "value", "left_semi").select(F.col("outer").alias("bytes")).distinct()
    return often.select("bytes", "n").join(outer, "bytes", "left_anti")


def with_series(df: DataFrame, series: Column, name: str = "value") -> DataFrame:
    """One row for each place of a series."""
    return df.select("msg_id", F.posexplode(series).alias("pos", name))


def relevant(segments: DataFrame) -> DataFrame:
    """Segments of two bytes or more that aren't all zero."""
    return segments.where((F.col("length") > 1) & F.exists(S.values(F.col("bytes")), lambda x: x != 0))


def value_distances(df: DataFrame) -> DataFrame:
    """(msg_id, byte, least, most, mean) of the gaps between equal bytes of a message; null for a byte that occurs once."""
    w = Window.partitionBy("msg_id", "byte").orderBy("pos")
    gaps = with_series(df, S.values(F.col("data")), "byte").withColumn("gap", F.col("pos") - F.lag("pos").over(w))
    return gaps.groupBy("msg_id", "byte").agg(F.min("gap").alias("least"), F.max("gap").alias("most"), F.avg("gap").alias("mean"))


def ecdf(df: DataFrame) -> DataFrame:
    """(x, y): the share of values (x) up to each distinct one. Values are counted first, so that only distinct ones are put in order."""
    n = df.where("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("n"))
    upto = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return n.select("x", (F.sum("n").over(upto) / F.sum("n").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("y"))


def counts_before_after(before: DataFrame, kept: DataFrame, kind: str) -> DataFrame:
    """Messages of each kind before a filter, and those (msg_id) that it kept."""
    k = kept.select("msg_id", F.lit(1).alias("_kept"))
    return before.join(k, "msg_id", "left").groupBy(kind).agg(F.count("*").alias("before"), F.count("_kept").alias("after"))


def parts(df: DataFrame, sizes: list[int]) -> DataFrame:
    """Consecutive parts of given sizes, by seq: (…, part). Only the first sum(sizes) rows are put in order in one task."""
    first = df.orderBy("seq").limit(sum(sizes))
    rank = F.row_number().over(Window.orderBy("seq"))
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    out = F.lit(len(sizes) - 1)
    for k in reversed(range(len(sizes) - 1)):
        out = F.when(F.col("_r") <= ends[k], k).otherwise(out)
    return first.withColumn("_r", rank).withColumn("part", out).drop("_r")


def mean_cosine(segments: DataFrame, keep: int | None = None) -> DataFrame:
    """(msg_id, mean): mean over all messages of the cosine similarity of two messages' values, weighted by how often each occurs in all.

    The sum over all messages of a value's normed weights is formed once a value, so that no pairs of messages are made.
    """
    n = segments.groupBy("bytes").agg(F.count("*").alias("n"))
    x = segments.select("msg_id", "bytes").distinct().join(n, "bytes")
    norm = x.groupBy("msg_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("w"))
    x = x.join(norm, "msg_id").select("msg_id", "bytes", (F.col("n") / F.col("w")).alias("u"))
    total = x.groupBy("bytes").agg(F.sum("u").alias("s"))
    messages = norm.count()
    out = x.join(total, "bytes").groupBy("msg_id").agg(F.round(F.sum(F.col("u") * F.col("s")) / messages, 9).alias("mean"))
    return out.orderBy(F.desc("mean"), "msg_id").limit(keep) if keep else out
