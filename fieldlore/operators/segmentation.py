"""Segmentation: from messages to ordered, gap-free segments (msg_id, seg_no, offset, length, bytes).

What cuts messages works on batches of them (``cuts``); the rest is expressed on columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlore.operators import cuts as C

SEGMENTS = "msg_id bigint, seg_no int, offset int, length int, bytes binary"


def segmented(df: DataFrame, cut: Callable[[C.Batch], np.ndarray]) -> DataFrame:
    """Segments of (msg_id, data) by the mask that cut gives a batch of messages. Null and empty messages have none; repeated rows each get theirs."""

    def run(parts):
        for part in parts:
            ids, messages = part.column(0), part.column(1).to_pylist()
            for a, z in C.in_chunks([len(m) if m else 0 for m in messages]):
                b = C.Batch(messages[a:z])
                if len(b.data):
                    yield C.as_rows(ids.slice(a, z - a), b, cut(b))

    return df.select(F.col("msg_id").cast("bigint").alias("msg_id"), "data").mapInArrow(run, SEGMENTS)


def congruence(df: DataFrame, sigma: float = 0.6, little_endian: bool = False, refined: bool = False) -> DataFrame:
    """Bit-congruence segmentation of (msg_id, data); messages of three bytes or fewer are one segment, empty ones have none. refined merges and pulls text afterwards."""
    rise = lambda b: C.steepest_rises(b, sigma)
    cut = (lambda b: C.backwards(b, rise)) if little_endian else rise
    return segmented(df, (lambda b: C.refine(b, cut(b), ["text", "pull"])) if refined else cut)


def fixed(df: DataFrame, n: int = 4) -> DataFrame:
    """Chunks of n bytes; the last may be shorter."""
    size = F.octet_length("data")
    rows = df.where(size > 0).select("msg_id", "data", F.posexplode(F.sequence(F.lit(0), size - 1, F.lit(n))).alias("seg_no", "offset"))
    return rows.select("msg_id", "seg_no", "offset", F.least(F.lit(n), F.octet_length("data") - F.col("offset")).alias("length"), F.substring("data", F.col("offset") + 1, F.lit(n)).alias("bytes"))


def islands(segments: DataFrame, same) -> DataFrame:
    """Merges runs of neighbours while same(bytes before, bytes) holds for each original pair."""
    w = Window.partitionBy("msg_id").orderBy("seg_no")
    marked = segments.withColumn("_prev", F.lag("bytes").over(w))
    marked = marked.withColumn("_new", F.when(F.col("_prev").isNull(), F.lit(True)).otherwise(~same(F.col("_prev"), F.col("bytes"))).cast("int"))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy("msg_id", "_run").agg(F.min("offset").alias("offset"), F.sum("length").cast("int").alias("length"), F.array_sort(F.collect_list(F.struct("seg_no", F.hex("bytes").alias("h")))).alias("p"))
    return runs.select("msg_id", (F.col("_run") - 1).cast("int").alias("seg_no"), "offset", "length", F.unhex(F.array_join("p.h", "")).alias("bytes"))


def refined(df: DataFrame, steps: list[str], sigma: float = 0.6) -> DataFrame:
    """Bit-congruence segmentation and steps (names of ``cuts.STEPS``) after it."""
    return segmented(df, lambda b: C.refine(b, C.steepest_rises(b, sigma), steps))


def again(segments: DataFrame, steps: list[str]) -> DataFrame:
    """Steps (names of ``cuts.STEPS``) on segments that there are; those of a message are brought together first."""
    parts = F.array_sort(F.collect_list(F.struct("seg_no", "bytes"))).alias("p")
    rows = segments.where(F.octet_length("bytes") > 0).groupBy("msg_id").agg(parts).select("msg_id", F.col("p.bytes").alias("parts"))

    def run(batches):
        for part in batches:
            ids, lists = part.column(0), part.column(1).to_pylist()
            messages = [b"".join(x) for x in lists]
            for a, z in C.in_chunks([len(m) for m in messages]):
                b = C.Batch(messages[a:z])
                mask, at = np.zeros(len(b.data), bool), 0
                for x in lists[a:z]:
                    ends = at + np.cumsum([0, *map(len, x)])
                    mask[ends[:-1]] = True
                    at = ends[-1]
                yield C.as_rows(ids.slice(a, z - a), b, C.refine(b, mask, steps))

    return rows.mapInArrow(run, SEGMENTS)


def minima(df: DataFrame, sigma: float = 1.5, horizon: bool = False) -> DataFrame:
    return segmented(df, lambda b: C.lows_between(b, sigma, horizon))


def variance(df: DataFrame, steepness: int = 200) -> DataFrame:
    return segmented(df, lambda b: C.steep_changes(b, steepness))


def falls(df: DataFrame, share: float = 0.3) -> DataFrame:
    return segmented(df, lambda b: C.falls(b, share))


def zeros(df: DataFrame, little_endian: bool = False, fields: bool = True) -> DataFrame:
    """Zero slices of whole messages, then recognised text (or text stretches without zeros)."""
    return segmented(df, lambda b: C.refine(b, b.whole(), ["zeros_le" if little_endian else "zeros", "crop_fields" if fields else "crop_text"]))


def whole(df: DataFrame) -> DataFrame:
    """Each message that isn't empty as one segment."""
    n = F.octet_length("data")
    return df.where(n > 0).select("msg_id", F.lit(0).alias("seg_no"), F.lit(0).alias("offset"), n.alias("length"), F.col("data").alias("bytes"))


def random(df: DataFrame, seed: int = 42, share: float = 0.25) -> DataFrame:
    """Cuts between bytes, each with a chance of share, drawn by a hash of seed, message and place: a retried task cuts alike."""
    n = F.octet_length("data")
    drawn = lambda i: F.pmod(F.xxhash64(F.lit(seed), "msg_id", i), F.lit(1_000_000)) < int(share * 1_000_000)
    inner = F.when(n > 1, F.filter(F.sequence(F.lit(1), n - 1), drawn)).otherwise(F.array().cast("array<int>"))
    bounds = F.concat(F.array(F.lit(0)), inner, F.array(n)).alias("b")
    cut = df.where(n > 0).select("msg_id", "data", bounds)
    rows = cut.select("msg_id", "data", F.posexplode(F.arrays_zip(F.expr("slice(b, 1, size(b) - 1)").alias("a"), F.expr("slice(b, 2, size(b) - 1)").alias("z"))).alias("seg_no", "s"))
    size = F.col("s.z") - F.col("s.a")
    return rows.select("msg_id", "seg_no", F.col("s.a").alias("offset"), size.alias("length"), F.substring("data", F.col("s.a") + 1, size).alias("bytes"))


def from_lengths(df: DataFrame, fields: DataFrame) -> DataFrame:
    """Segments of given lengths (msg_id, pos, len), as dissected fields have them."""
    w = Window.partitionBy("msg_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    f = fields.withColumn("offset", (F.sum("len").over(w) - F.col("len")).cast("int"))
    return f.join(df.select("msg_id", "data"), "msg_id").select("msg_id", F.col("pos").cast("int").alias("seg_no"), "offset", F.col("len").cast("int").alias("length"), F.substring("data", F.col("offset") + 1, F.col("len")).alias("bytes"))


def fill_gaps(df: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments, and new ones for the bytes before, between and after them; messages without any are one segment."""
    size = df.where(F.octet_length("data") > 0).select("msg_id", F.octet_length("data").alias("offset"), F.lit(0).alias("length"))
    w = Window.partitionBy("msg_id").orderBy("offset", "length")
    ends = segments.select("msg_id", "offset", "length").union(size)
    at = F.coalesce(F.lag(F.col("offset") + F.col("length")).over(w), F.lit(0))
    gaps = ends.withColumn("from", at).where(F.col("from") < F.col("offset")).select("msg_id", F.col("from").alias("offset"), (F.col("offset") - F.col("from")).alias("length"))
    every = segments.select("msg_id", "offset", "length").union(gaps).join(df.select("msg_id", "data"), "msg_id")
    number = (F.row_number().over(Window.partitionBy("msg_id").orderBy("offset")) - 1).alias("seg_no")
    return every.select("msg_id", number, "offset", "length", F.substring("data", F.col("offset") + 1, F.col("length")).alias("bytes"))


def wobble(df: DataFrame, segments: DataFrame) -> DataFrame:
    """Each segment, and forms of it that start one byte earlier and one later, within the message and not empty."""
    s = segments.select("msg_id", F.explode(F.array(*(F.struct((F.col("offset") + k).alias("offset"), (F.col("length") - k).alias("length")) for k in (-1, 0, 1)))).alias("s"))
    s = s.select("msg_id", "s.offset", "s.length").where("offset >= 0 AND length > 0").join(df.select("msg_id", "data"), "msg_id")
    return s.select("msg_id", "offset", "length", F.substring("data", F.col("offset") + 1, F.col("length")).alias("bytes"))


def split_segment(segments: DataFrame, number: int = 0, size: int = 1) -> DataFrame:
    """Chops the segment of that number into chunks of size bytes."""
    hit = F.col("seg_no") == number
    steps = F.when(hit, F.sequence(F.lit(0), F.col("length") - 1, F.lit(size))).otherwise(F.array(F.lit(0)))
    rows = segments.where("length > 0").select("*", F.explode(steps).alias("k"))
    length = F.when(hit, F.least(F.lit(size), F.col("length") - F.col("k"))).otherwise(F.col("length"))
    rows = rows.select("msg_id", (F.col("offset") + F.col("k")).alias("offset"), length.alias("length"), F.substring("bytes", F.col("k") + 1, length).alias("bytes"))
    return rows.select("msg_id", (F.row_number().over(Window.partitionBy("msg_id").orderBy("offset")) - 1).alias("seg_no"), "offset", "length", "bytes")


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """(msg_id, left_no, right_no, shared): pairs of segments of one message whose ranges meet, and by how many bytes."""
    a = left.select("msg_id", F.col("seg_no").alias("left_no"), F.col("offset").alias("a"), (F.col("offset") + F.col("length")).alias("z"))
    b = right.select("msg_id", F.col("seg_no").alias("right_no"), F.col("offset").alias("c"), (F.col("offset") + F.col("length")).alias("y"))
    return a.join(b, "msg_id").where("a < y AND c < z").select("msg_id", "left_no", "right_no", (F.least("z", "y") - F.greatest("a", "c")).alias("shared"))


def substrings(lengths: list[int], column: str = "bytes") -> Column:
    """All runs of the given numbers of bytes, as (value, at), at from 1."""
    size = F.octet_length(column)
    of = lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda p: F.struct(F.substring(F.col(column), p, n).alias("value"), p.alias("at")))
    return F.flatten(F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= size), of))


def crop_common(segments: DataFrame, messages: DataFrame | int, share: float = 0.1) -> DataFrame:
    """Cuts the most frequent common value that a segment holds, at its first place, out of it; ties in frequency go by the bytes.

    messages are the messages, or how many there are. Segments should be a saved table: they are read twice. Values and segments meet by equality of
    the value with the runs of bytes of its length, so that nothing is sent to every task.
    """
    from fieldlore.operators import messages as M

    n = messages if isinstance(messages, int) else messages.count()
    common = M.common_values(segments, n, share).select(F.col("bytes").alias("value"), F.col("n").alias("often"))
    # one number for each length that a common value has
    lengths = sorted(r[0] for r in common.select(F.octet_length("value")).distinct().collect())
    if not lengths:
        return segments
    key = ["msg_id", "offset"]
    grams = segments.where(F.col("length") >= lengths[0]).select(*key, F.inline(substrings(lengths)))
    first = grams.join(common, "value").groupBy(*key).agg(F.max(F.struct("often", "value", (-F.col("at")).alias("at"))).alias("m"))
    s = segments.join(first.select(*key, F.octet_length("m.value").alias("size"), (-F.col("m.at") - 1).alias("at")), key, "left")
    s = s.fillna(0, ["at"]).withColumn("size", F.coalesce("size", "length"))
    part = lambda a, n: F.struct((F.col("offset") + a).alias("offset"), n.alias("length"), F.substring("bytes", a + 1, n).alias("bytes"))
    after = F.col("at") + F.col("size")
    s = s.select("msg_id", F.explode(F.array(part(F.lit(0), F.col("at")), part(F.col("at"), F.col("size")), part(after, F.col("length") - after))).alias("s"))
    s = s.select("msg_id", "s.*").where("length > 0")
    return s.select("msg_id", (F.row_number().over(Window.partitionBy("msg_id").orderBy("offset")) - 1).alias("seg_no"), "offset", "length", "bytes")


def from_cells(cells: DataFrame) -> DataFrame:
    """Segments of messages given as cells (msg_id, cells), null or empty ones left out."""
    some = F.filter("cells", lambda c: c.isNotNull() & (F.octet_length(c) > 0))
    x = cells.select("msg_id", F.posexplode(some).alias("seg_no", "bytes")).withColumn("length", F.octet_length("bytes"))
    w = Window.partitionBy("msg_id").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, 0)
    return x.select("msg_id", "seg_no", (F.sum("length").over(w) - F.col("length")).cast("int").alias("offset"), "length", "bytes")


def with_feature(segments: DataFrame, series: DataFrame) -> DataFrame:
    """Segments with the part of another series (msg_id, values) of their messages that begins in them."""
    return segments.join(series.select("msg_id", F.col("values").alias("_s")), "msg_id").select("*", F.slice("_s", F.col("offset") + 1, F.col("length")).alias("values")).drop("_s")


def merge_on_rise(segments: DataFrame, little_endian: bool = False) -> DataFrame:
    """Neighbours merged unless the second value is more frequent, among all segments, than what is left of the frequencies before.

    A frequency that falls is held and lessened by a quarter of the fall, rounded down; for little endian messages are read from their end.
    """
    n = segments.groupBy("bytes").agg(F.count("*").alias("n"))
    x = segments.join(n, "bytes").groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct("seg_no", "offset", F.hex("bytes").alias("h"), "n"))).alias("p"))
    order = F.reverse("p") if little_endian else F.col("p")
    held = lambda last, now: F.when(now >= last, now).otherwise(last - F.floor((last - now) / 4))
    # the held frequency of each segment, grown from the left
    step = lambda acc, s: F.concat(acc, F.array(held(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("bigint")), s["n"])))
    peaks = F.aggregate(order, F.array().cast("array<bigint>"), step)
    size = F.size("p")
    joins = (lambda k, i: F.get(k, i - 1) <= F.get(k, i)) if little_endian else (lambda k, i: F.get(k, i - 1) >= F.get(k, i))
    # the frequencies are evaluated once a message, not once a segment
    starts = F.element_at(F.transform(F.array(F.reverse(peaks) if little_endian else peaks), lambda k: F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | ~F.coalesce(joins(k, i), F.lit(False)))), 1)
    x = x.select("msg_id", "p", F.inline(F.array(F.struct(starts.alias("s"))))).select("msg_id", "p", "s", F.posexplode("s").alias("seg_no", "a"))
    end = F.coalesce(F.get("s", F.col("seg_no") + 1), F.size("p"))
    h = F.array_join(F.transform(F.slice("p", F.col("a") + 1, end - F.col("a")), lambda q: q["h"]), "")
    return x.select("msg_id", "seg_no", F.get("p", F.col("a"))["offset"].alias("offset"), (F.length(h) / 2).cast("int").alias("length"), F.unhex(h).alias("bytes"))


def at_rarest_pairs(segments: DataFrame, messages: DataFrame) -> DataFrame:
    """Bounds moved by a byte to the rarest pair of bytes: what lies across a bound, before it and after it is counted over all bounds.

    A bound stays if the pair across it is rarest, else it moves before the pair before it, or after the first byte of the one after it; two bytes are needed on each side. Bounds that
    meet are one.
    """
    m = messages.select("msg_id", "data", F.octet_length("data").alias("size"))
    at = lambda k: F.substring("data", F.col("offset") + k, F.lit(2))
    b = segments.select("msg_id", "offset").join(m, "msg_id").where("offset >= 2 AND offset + 2 <= size")
    b = b.select("msg_id", "offset", at(0).alias("across"), at(-1).alias("before"), at(1).alias("after"))
    n = b.select(F.explode(F.array("across", "before", "after")).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    of = lambda name: n.select(F.col("g").alias(name), F.col("n").alias(f"n_{name}"))
    b = b.join(of("across"), "across").join(of("before"), "before").join(of("after"), "after")
    stay = (F.col("n_across") <= F.col("n_before")) & (F.col("n_across") <= F.col("n_after"))
    shift = F.when(stay, 0).when(F.col("n_before") <= F.col("n_after"), -1).otherwise(1)
    moved = segments.select("msg_id", "offset").join(b.select("msg_id", "offset", shift.alias("s")), ["msg_id", "offset"], "left")
    x = moved.select("msg_id", (F.col("offset") + F.coalesce("s", F.lit(0))).cast("int").alias("offset")).distinct().join(m, "msg_id").where("offset < size")
    w = Window.partitionBy("msg_id").orderBy("offset")
    length = (F.coalesce(F.lead("offset").over(w), F.col("size")) - F.col("offset")).cast("int")
    x = x.select("msg_id", (F.row_number().over(w) - 1).alias("seg_no"), "offset", length.alias("length"), "data")
    return x.select("msg_id", "seg_no", "offset", "length", F.substring("data", F.col("offset") + 1, F.col("length")).alias("bytes"))
