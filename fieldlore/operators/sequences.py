"""Frequent byte sequences, grown one byte at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequent(df: DataFrame, share: float = 0.6, drop: float = 0.6) -> DataFrame:
    """(h, length, n, rest) of sequences in messages (msg_id, data), as hex.

    A sequence is frequent if it occurs share times the number of messages or more; a longer one must also keep drop of the
    occurrences of the sequence it extends by its last byte. rest counts the occurrences that no frequent sequence one byte
    longer covers. A sequence of k bytes is looked for only where both its parts of k - 1 bytes are frequent. Each round is
    a checkpoint; there are as many as the longest frequent sequence has bytes. Empty messages count among the number of messages.
    """
    least = share * df.count()
    size = F.octet_length("data")
    at = df.where(size > 0).select("msg_id", F.explode(F.sequence(F.lit(1), size)).alias("o"), F.hex("data").alias("whole"))
    occ = at.select("msg_id", "o", F.expr("substring(whole, 2 * o - 1, 2)").alias("h"))
    counts = occ.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # a set of at most (bytes / least) sequences
    occ, out, k = occ.join(counts.select("h"), "h").select("msg_id", "o", "h").checkpoint(), [], 1
    while not occ.isEmpty():
        counts = occ.groupBy("h").agg(F.count("*").alias("n"))
        after = occ.select("msg_id", (F.col("o") - 1).alias("o"), F.expr("right(h, 2)").alias("last"))
        longer = occ.join(after, ["msg_id", "o"]).select("msg_id", "o", "h", F.concat("h", "last").alias("g"))
        kept = longer.groupBy("h", "g").agg(F.count("*").alias("m")).where(F.col("m") >= least).join(counts, "h").where(F.col("m") >= drop * F.col("n")).select("g")
        grown = longer.join(kept, "g").select("msg_id", "o", F.col("g").alias("h")).checkpoint()
        covered = grown.select("msg_id", F.explode(F.array("o", F.col("o") + 1)).alias("o")).distinct().withColumn("_c", F.lit(1))
        rest = occ.join(covered, ["msg_id", "o"], "left").groupBy("h").agg(F.count("*").alias("n"), F.count(F.when(F.col("_c").isNull(), 1)).alias("rest"))
        out.append(rest.select("h", F.lit(k).alias("length"), "n", "rest"))
        occ, k = grown, k + 1
    return reduce(DataFrame.unionByName, out) if out else df.sparkSession.createDataFrame([], "h string, length int, n bigint, rest bigint")


def support(counts: DataFrame, percentile: float = 0.8) -> float | None:
    """The count that a share percentile of sequences (n) don't exceed, as a dynamic support."""
    return counts.agg(F.percentile("n", F.lit(percentile))).first()[0]


def most_frequent(found: DataFrame, start: int = 1) -> DataFrame:
    """(h, length, n) of frequent sequences of start bytes or more with occurrences that no longer one covers, without the longest ones."""
    top = found.agg(F.max("length")).first()[0] or 0
    return found.where((F.col("length") >= start) & (F.col("length") < top) & (F.col("rest") > 0)).select("h", "length", F.col("rest").alias("n"))
