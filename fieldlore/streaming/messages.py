"""Streaming forms: per-message operators are stateless and run as they are; de-duplication keeps state behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame


def deduplicate(messages: DataFrame, within: str = "1 hour", time: str = "ts") -> DataFrame:
    """The first message of each payload among those that come within that delay.

    The batch form keeps the last one of a payload, which a stream only knows when it ends; ``last_of_window`` keeps the last one of each window.
    """
    return messages.withWatermark(time, within).dropDuplicatesWithinWatermark(["data"])


def last_of_window(messages: DataFrame, within: str = "1 hour", time: str = "ts") -> DataFrame:
    """(window, data, msg_id, seq): the last message of each payload in each window of event time, as the batch form has it; late ones go."""
    from pyspark.sql import functions as F

    w = messages.withWatermark(time, within).groupBy(F.window(time, within), "data")
    return w.agg(F.max_by("msg_id", "seq").alias("msg_id"), F.max("seq").alias("seq"))
