"""Inferred bounds and clusters against the truth, beside ``scores``: matches, scopes, overlaps, typed segments, reports' numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlore.operators import scores as V


def inner_ends(ends: DataFrame) -> DataFrame:
    """Distinct ends (msg_id, end) but each message's last."""
    e = ends.select("msg_id", "end").distinct()
    return e.withColumn("size", F.max("end").over(Window.partitionBy("msg_id"))).where("end < size").select("msg_id", "end")


def exact(true_ends: DataFrame, inferred: DataFrame) -> DataFrame:
    """(msg_id, end): true ends inside a message that were inferred."""
    return inner_ends(true_ends).join(inferred.select("msg_id", "end").distinct(), ["msg_id", "end"], "left_semi")


def scopes(true_ends: DataFrame, inferred: DataFrame | None = None) -> DataFrame:
    """(msg_id, end, low, high): half-way to the neighbours of each true end inside a message, where there is room; with inferred ends only for those that weren't inferred.

    The first end has itself for a left neighbour.
    """
    w = Window.partitionBy("msg_id").orderBy("end")
    t = true_ends.select("msg_id", "end").distinct().withColumn("l", F.coalesce(F.lag("end").over(w), "end")).withColumn("r", F.lead("end").over(w)).where("r IS NOT NULL")
    low, high = F.expr("IF(end - l <= 1, end, l + (end - l) DIV 2)"), F.expr("IF(r - end <= 1, end, end - 1 + (r - end) DIV 2)")
    t = t.select("msg_id", "end", low.cast("bigint").alias("low"), high.cast("bigint").alias("high")).where("low < high")
    return t if inferred is None else t.join(inferred.select("msg_id", "end").distinct(), ["msg_id", "end"], "left_anti")


def in_scope(true_ends: DataFrame, inferred: DataFrame) -> DataFrame:
    """(msg_id, end, inferred, off): all inferred ends in the scope of each true end that wasn't inferred, and how far they are off."""
    i = inferred.select("msg_id", F.col("end").alias("inferred")).distinct()
    return scopes(true_ends, inferred).join(i, "msg_id").where("inferred BETWEEN low AND high").select("msg_id", "end", "inferred", (F.col("inferred") - F.col("end")).alias("off"))


def near(true_ends: DataFrame, inferred: DataFrame) -> DataFrame:
    """(msg_id, end, inferred): the nearest inferred end in each scope, the first of two."""
    g = in_scope(true_ends, inferred).groupBy("msg_id", "end").agg(F.min(F.struct(F.abs("off").alias("a"), "inferred")).alias("m"))
    return g.select("msg_id", "end", "m.inferred")


def format_match_by(true_ends: DataFrame, inferred: DataFrame, key: str) -> DataFrame:
    """Format match scores of each message for each value of a key (a threshold, say) of inferred ends (key, msg_id, end)."""
    each = inferred.select(key).distinct()
    both = F.struct("key", "msg_id")
    tag = lambda d: d.withColumn("key", F.col(key)).withColumn("msg_id", both)
    out = V.format_match(tag(true_ends.join(F.broadcast(each))).select("msg_id", "end"), tag(inferred).select("msg_id", "end"))  # a handful of keys
    return out.select(F.col("msg_id.key").alias(key), F.col("msg_id.msg_id").alias("msg_id"), *out.columns[1:])


def overlaps(segments: DataFrame, true_ends: DataFrame) -> DataFrame:
    """(msg_id, offset, ratio, pos, from, to): the true field that each segment (msg_id, offset, length) covers most of, by the segment's longest piece between true ends.

    If half or more of that piece's field lies outside at the segment's start or end, there is none: ratio 0, the rest null. pos counts the message's fields; the first of
    equally long pieces counts.
    """
    s = segments.select("msg_id", F.col("offset").cast("bigint").alias("a"), (F.col("offset") + F.col("length")).cast("bigint").alias("z"))
    ends = true_ends.select("msg_id", F.col("end").cast("bigint").alias("e")).distinct().groupBy("msg_id").agg(F.array_sort(F.collect_list("e")).alias("ends"))
    x = s.join(ends, "msg_id", "left").withColumn("ends", F.coalesce("ends", F.array().cast("array<bigint>")))
    inner = F.filter("ends", lambda e: (e > F.col("a")) & (e < F.col("z")))
    x = x.withColumn("cuts", F.concat(F.array("a"), inner, F.array("z")))
    x = x.withColumn("p", F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: F.struct((F.element_at("cuts", i) - F.element_at("cuts", i + 1)).alias("n"), F.element_at("cuts", i).alias("from"), F.element_at("cuts", i + 1).alias("to"))))
    x = x.withColumn("m", F.array_min("p"))
    x = x.select("msg_id", "a", "z", "ends", F.col("m.from").alias("from"), F.col("m.to").alias("to"))
    size = F.col("to") - F.col("from")
    before = F.coalesce(F.array_max(F.filter("ends", lambda e: e <= F.col("a"))), F.lit(0))
    after = F.coalesce(F.array_min(F.filter("ends", lambda e: e >= F.col("z"))), F.array_max("ends"))
    poor = ((F.col("from") == F.col("a")) & ((size / (F.col("to") - before)) <= 0.5)) | ((F.col("to") == F.col("z")) & ((size / (after - F.col("from"))) <= 0.5))
    end = F.when(F.col("to") == F.col("z"), after).otherwise(F.col("to"))
    pos = F.array_position("ends", end) - 1
    fits = ~F.coalesce(poor, F.lit(True)) & (F.size("ends") > 0)
    return x.select("msg_id", F.col("a").cast("int").alias("offset"), F.when(fits, size / (F.col("z") - F.col("a"))).otherwise(0.0).alias("ratio"), F.when(fits, pos).cast("int").alias("pos"), F.when(fits, F.col("from")).cast("int").alias("from"), F.when(fits, F.col("to")).cast("int").alias("to"))


def typed_segments(segments: DataFrame, fields: DataFrame) -> DataFrame:
    """Segments (msg_id, offset, length, bytes) with name, type and ratio of the true field (msg_id, pos, len, name, type) that each covers most of; null names where there is none."""
    ends = V.field_ends(fields)
    o = overlaps(segments, ends).select("msg_id", "offset", "ratio", "pos")
    t = fields.select("msg_id", "pos", "name", "type")
    return segments.select("msg_id", "offset", "length", "bytes").join(o, ["msg_id", "offset"]).join(t, ["msg_id", "pos"], "left").select("msg_id", "offset", "length", "bytes", "name", "type", "ratio")


def types_of_values(typed: DataFrame, least: float = 0.5) -> DataFrame:
    """(bytes, n, type, ratio): the one type of all segments of a value, if their mean ratio exceeds least; [unknown] with ratio -1 where one has none, with ratio 0 where they have several."""
    g = typed.groupBy("bytes").agg(F.count("*").alias("n"), F.count("type").alias("k"), F.min("type").alias("a"), F.max("type").alias("z"), F.avg("ratio").alias("mean"))
    ratio = F.when(F.col("k") < F.col("n"), -1.0).when(F.col("a") != F.col("z"), 0.0).otherwise(F.col("mean"))
    return g.select("bytes", "n", F.when(ratio > least, F.col("a")).otherwise("[unknown]").alias("type"), ratio.alias("ratio"))


def format_examples(fields: DataFrame) -> DataFrame:
    """(format, msg_id): the first message of each sequence of field lengths."""
    return V.formats(fields).select("format", "msg_id")


def bytes_of_bits(lengths: DataFrame) -> DataFrame:
    """(msg_id, pos, len) in bytes from lengths in bits: fields that end within one byte become one, which ends with it."""
    w = Window.partitionBy("msg_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = lengths.withColumn("end", F.ceil(F.sum("bits").over(w) / 8).cast("bigint")).select("msg_id", "end").distinct()
    by = Window.partitionBy("msg_id").orderBy("end")
    return ends.select("msg_id", (F.row_number().over(by) - 1).alias("pos"), (F.col("end") - F.coalesce(F.lag("end").over(by), F.lit(0))).alias("len"))


def run_scores(clusters: DataFrame) -> DataFrame:
    """(run, least, type, recall): least precision of each run's clusters (run, label, type, precision, recall; noise is labelled NOISE), and the sum of recalls by their most frequent type."""
    least = clusters.where("label <> 'NOISE'").groupBy("run").agg(F.min("precision").alias("least"))
    kind = F.when(F.col("label") == "NOISE", "NOISE").otherwise(F.substring_index("type", ":", 1))
    sums = clusters.select("run", kind.alias("type"), "recall").groupBy("run", "type").agg(F.sum("recall").alias("recall"))
    return sums.join(least, "run", "left").select("run", "least", "type", "recall")


def score_table(clusters: DataFrame, types: list[str]) -> DataFrame:
    """One row for each run: its least precision, and a column of summed recalls for each type."""
    return run_scores(clusters).groupBy("run", "least").pivot("type", types).agg(F.first("recall"))


def few_labels(labels: DataFrame, diameters: DataFrame, most: int = 20) -> DataFrame:
    """(id, name): labels, where clusters without extent (label, most) share one name, and of the rest only the most largest keep theirs; ties by name."""
    x = labels.join(diameters.select("label", F.col("most").alias("_m")), "label", "left")
    flat = F.coalesce(F.col("_m") == 0, F.lit(False))
    x = x.select("id", F.when(flat, "one without extent").otherwise(F.col("label").cast("string")).alias("name"))
    n = x.groupBy("name").agg(F.count("*").alias("n"))
    top = n.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("n"), "name"))).where(F.col("_r") <= most).select("name")  # one row a cluster
    return x.join(top.withColumn("_k", F.lit(True)), "name", "left").select("id", F.when(F.col("_k"), F.col("name")).otherwise("one of the smallest").alias("name"))


def members(templates: DataFrame, segments: DataFrame) -> DataFrame:
    """(label, msg_id, offset): the segments (msg_id, offset, bytes) that stand behind each template's values (label, bytes)."""
    return segments.join(templates, "bytes").select("label", "msg_id", "offset")


def deviation_counts(true_ends: DataFrame, inferred: DataFrame) -> DataFrame:
    """(off, n): how often an inferred end is so far off the true end in whose scope it lies, 0 for exact ones."""
    off = in_scope(true_ends, inferred).select("off").union(exact(true_ends, inferred).select(F.lit(0).cast("bigint")))
    return off.groupBy("off").agg(F.count("*").alias("n"))


def end_counts(ends: DataFrame) -> DataFrame:
    """(end, n): in how many messages a field ends at each place."""
    return ends.select("msg_id", "end").distinct().groupBy("end").agg(F.count("*").alias("n"))


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """(msg_id, x, y) of two sets of numbers (msg_id, x) and (msg_id, y): equal ones in one row, null where the other has none."""
    a, b = a.select("msg_id", "x").distinct(), b.select("msg_id", "y").distinct()
    right = b.select(F.col("msg_id").alias("_m"), "y")
    return a.join(right, (F.col("msg_id") == F.col("_m")) & (F.col("x") == F.col("y")), "full_outer").select(F.coalesce("msg_id", "_m").alias("msg_id"), "x", "y")


def separation(d: DataFrame, types: DataFrame, bins: int = 20) -> DataFrame:
    """(match, bin, n): histogram of distances (i, j, d) between values of one type (id, type) and of two, in bins from 0 to 1."""
    x = d.join(types.select(F.col("id").alias("i"), F.col("type").alias("a")), "i").join(types.select(F.col("id").alias("j"), F.col("type").alias("b")), "j")
    return x.groupBy((F.col("a") == F.col("b")).alias("match"), F.least(F.floor(F.col("d") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def every_kth(labels: DataFrame, most: int = 2000, aim: int = 1000) -> DataFrame:
    """labels, or of more than most members every k-th of each cluster in the order of ids, k being their number over aim, rounded down."""
    n = labels.count()
    if n <= most:
        return labels
    return labels.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1).where(F.col("_r") % (n // aim) == 0).drop("_r")


def layout(d: DataFrame, ids: DataFrame, most: int = 2000) -> DataFrame:
    """(id, x, y): places in the plane whose distances are like those of values, by the two greatest components of the doubly centred squares; for most values at most, which the driver holds."""
    import numpy as np

    at = {r.id: k for k, r in enumerate(ids.orderBy("id").limit(most + 1).collect())}
    if len(at) > most:
        raise ValueError(f"more than {most} values: take a subsample first")
    m = np.zeros((len(at), len(at)))
    for r in d.collect():
        if r.i in at and r.j in at:
            m[at[r.i], at[r.j]] = m[at[r.j], at[r.i]] = r.d
    c = np.eye(len(at)) - 1 / max(len(at), 1)
    w, v = np.linalg.eigh(-0.5 * c @ (m**2) @ c) if len(at) else (np.zeros(0), np.zeros((0, 0)))
    v = v[:, np.argsort(-w)][:, :2] * np.sqrt(np.maximum(np.sort(w)[::-1][:2], 0))
    v = np.pad(v, ((0, 0), (0, max(0, 2 - v.shape[1]))))
    # a column's sign is that of its largest entry
    v = v * np.sign(v[np.abs(v).argmax(0), [0, 1]]) if len(at) else v
    return ids.sparkSession.createDataFrame([(i, float(v[k, 0]), float(v[k, 1])) for i, k in at.items()], "id bigint, x double, y double")
