"""Message types from aligned clusters: clusters are split by fields with few, frequent values, and merged where their fields agree.

Aligned messages are (label, msg_id, col, bytes), bytes null for a gap. What is decided by cluster or by pair of clusters works on their columns, not on
their messages.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlore.functions import embeddings as E
from fieldlore.functions import series as S
from fieldlore.operators import alignment as A
from fieldlore.operators.lineage import components

#: Columns that split a cluster at most; weights of distances between fields; nearness of values; share of gaps; share of all clusters.
PIVOTS, SAME, MIXED, ZERO, NEAR, FAR, GAPS, ALL = 2, 0.4, 0.6, 0.1, 0.2, 0.7, 0.4, 0.66
#: Distinct values at most among which joined neighbours are looked for; every task gets them.
KNOWN = 1_000_000
#: Scores of a gap, a mismatch and a match between fields of two clusters.
FIELD_SCORES = (0.0, -1.0, 5.0)


def column_values(aligned: DataFrame) -> DataFrame:
    """(label, col, bytes, n) of values that aren't gaps."""
    return aligned.where("bytes IS NOT NULL").groupBy("label", "col", "bytes").agg(F.count("*").alias("n"))


def pivot_columns(aligned: DataFrame, longest: int = 6, relaxed: bool = True) -> DataFrame:
    """(label, col): columns by whose values a cluster is split.

    With t the logarithm of its messages, rounded down: 2 to t values, at most t gaps, no value longer than longest or all zero. Each value must occur more than t times; relaxed, it
    is enough that the counts, in order, make their greatest step to two or more values that are over ten times as frequent in all as those before it and in the mean over twice
    the messages by their logarithm. Clusters with more such columns than PIVOTS have none.
    """
    size = aligned.where("label IS NOT NULL").groupBy("label").agg(F.count_distinct("msg_id").alias("size"))
    gaps = aligned.groupBy("label", "col").agg(F.count(F.when(F.col("bytes").isNull(), 1)).alias("gaps"))
    v = column_values(aligned)
    zero = F.forall(S.values(F.col("bytes")), lambda x: x == 0)
    c = v.groupBy("label", "col").agg(F.array_sort(F.collect_list("n")).alias("counts"), F.max(F.octet_length("bytes")).alias("long"), F.max(zero.cast("int")).alias("zero"))
    t = F.floor(F.log("size"))
    k = F.size("counts")
    x = c.join(gaps, ["label", "col"]).join(size, "label").where((k > 1) & (k <= t) & (F.col("gaps") <= t) & (F.col("long") <= longest) & (F.col("zero") == 0))
    strict = F.element_at("counts", 1) > t
    if relaxed:
        step = F.transform(F.sequence(F.lit(1), k - 1), lambda i: F.element_at("counts", i + 1) - F.element_at("counts", i))
        x = x.withColumn("cut", F.array_position(step, F.array_max(step)).cast("int"))
        total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, y: s + y)
        low, high = F.slice("counts", 1, F.col("cut")), F.slice("counts", F.col("cut") + 1, k)
        often = (F.size(high) > 1) & (total(low) / total(high) < 0.1) & (total(high) / F.size(high) > 2 * F.col("size") / F.log("size"))
        strict = strict | often
    x = x.where(strict).select("label", "col")
    few = x.groupBy("label").agg(F.count("*").alias("k")).where(F.col("k") <= PIVOTS).select("label")
    return x.join(few, "label", "left_semi")


def split(aligned: DataFrame, pivots: DataFrame) -> DataFrame:
    """(msg_id, label, part): each message with its cluster, and the number of its part by the values of the cluster's pivot columns, in the order of these; null where the cluster stays whole."""
    at = aligned.join(pivots, ["label", "col"]).groupBy("label", "msg_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce(F.hex("bytes"), F.lit("-")).alias("h")))), lambda s: s["h"]), ",").alias("key"))
    part = at.select("label", "key").distinct().withColumn("part", F.row_number().over(Window.partitionBy("label").orderBy("key")) - 1)
    return aligned.select("label", "msg_id").distinct().join(at.join(part, ["label", "key"]).select("label", "msg_id", "part"), ["label", "msg_id"], "left").select("msg_id", "label", "part")


def step_statistics(aligned: DataFrame) -> DataFrame:
    """(label, col, values, step, low, high, mean_low, mean_high): the counts of a column's values on both sides of their greatest step."""
    c = column_values(aligned).groupBy("label", "col").agg(F.array_sort(F.collect_list("n")).alias("counts")).where(F.size("counts") > 1)
    k = F.size("counts")
    step = F.transform(F.sequence(F.lit(1), k - 1), lambda i: F.element_at("counts", i + 1) - F.element_at("counts", i))
    c = c.withColumn("step", F.array_position(step, F.array_max(step)).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, y: s + y)
    low, high = total(F.slice("counts", 1, F.col("step"))), total(F.slice("counts", F.col("step") + 1, k))
    return c.select("label", "col", k.alias("values"), "step", low.alias("low"), high.alias("high"), (low / F.col("step")).alias("mean_low"), (high / (k - F.col("step"))).alias("mean_high"))


def fields_of(aligned: DataFrame) -> DataFrame:
    """(label, col, values): the distinct values of each column in order; one is static, several are dynamic. Columns of gaps alone are left out."""
    return aligned.where("bytes IS NOT NULL").groupBy("label", "col").agg(F.array_sort(F.collect_set("bytes")).alias("values"))


def nearest(a: list[bytes], b: list[bytes]) -> float:
    """The least dissimilarity between values of two fields."""
    if not set(a).isdisjoint(b):
        return 0.0
    return min(float(E.matrix(a[part], b)[0].min()) for part in E.chunks(len(a), len(b)))


def field_similarity(a: list[bytes], b: list[bytes]) -> float:
    """One less a weighted distance: 0.4 between two static or two dynamic fields, 0.6 between one of each; 0.1 where the static field is all zero (of two static ones, both)."""
    zero = lambda f: len(f) == 1 and not any(f[0])
    if len(a) > 1 and len(b) > 1:
        weight = SAME
    elif len(a) > 1 or len(b) > 1:
        weight = ZERO if zero(a) or zero(b) else MIXED
    else:
        weight = ZERO if zero(a) and zero(b) else SAME
    return 1 - weight * nearest(a, b)


def align_fields(a: list, b: list, scores: tuple[float, float, float] = FIELD_SCORES) -> tuple[list, list]:
    """The fields of two clusters side by side, None for a gap."""
    gap, mismatch, match = scores
    known: dict = {}

    def score(x, y):
        if (x, y) not in known:
            known[x, y] = A.score_domain(field_similarity(a[x], b[y]), match, mismatch)
        return known[x, y]

    x, y = A.divided_alignment(list(range(len(a))), list(range(len(b))), score, gap)
    return [None if i is None else a[i] for i in x], [None if i is None else b[i] for i in y]


def with_neighbours_joined(a: list, b: list, known: set[bytes]) -> tuple[list, list]:
    """Where a static field stands beside a gap and the next fields on one side are both static, it joins its neighbour there, if the joined value occurs elsewhere.

    Of both sides the one whose static fields are nearer to each other is taken.
    """
    static = lambda f: f is not None and len(f) == 1
    a, b, gone = list(a), list(b), []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if not ((x is None and static(y)) or (y is None and static(x))):
            continue
        sides = {m: A.value_dissimilarity(a[m][0], b[m][0]) for m in (k - 1, k + 1) if 0 <= m < len(a) and static(a[m]) and static(b[m]) and m not in gone}
        if not sides:
            continue
        m = min(sides, key=lambda s: (sides[s], -s))
        own = a if y is None else b
        value = own[min(k, m)][0] + own[max(k, m)][0]
        if value in known:
            own[m] = [value]
            gone.append(k)
    keep = [k for k in range(len(a)) if k not in gone]
    return [a[k] for k in keep], [b[k] for k in keep]


def conditions(x: list | None, y: list | None) -> tuple[bool, ...]:
    """What holds for two aligned fields: a gap in either, equal, all zero in either, either one's value among the other's, near a dynamic one, near static ones."""
    stat = lambda f: f is not None and len(f) == 1
    dyn = lambda f: f is not None and len(f) > 1
    zero = lambda f: stat(f) and not any(f[0])
    mixed = (dyn(x) and stat(y)) or (stat(x) and dyn(y))
    equal = (stat(x) and stat(y) and x[0] == y[0]) or (dyn(x) and dyn(y))
    return (
        x is None,
        y is None,
        equal,
        zero(x),
        zero(y),
        dyn(x) and stat(y) and y[0] in x,
        dyn(y) and stat(x) and x[0] in y,
        mixed and nearest(x, y) < FAR,
        stat(x) and stat(y) and A.value_dissimilarity(x[0], y[0]) < NEAR,
    )


def long_gap_alone(gaps: list[bool], fields: list) -> bool:
    """Whether a run of more than two gaps has neither an end of the fields nor a static field beside it."""
    k = 0
    while k < len(gaps):
        z = k
        while z < len(gaps) and gaps[z]:
            z += 1
        if z - k > 2 and k > 0 and z < len(gaps) and not any(fields[m] is not None and len(fields[m]) == 1 for m in (k - 1, z)):
            return True
        k = max(z, k + 1)
    return False


MATCHES = "p string, q string, fields int, gaps int, matched boolean, torn boolean, held array<struct<dynamic:string,place:int,value:binary,inside:boolean>>"


def matches(aligned: DataFrame, join_neighbours: bool = True) -> DataFrame:
    """One row for each pair of clusters: their aligned fields, gaps, whether all fields fit (matched), whether a long gap stands alone (torn), and which static values dynamic fields take (held).

    A pair of clusters is a group of its own with the columns of both; the number of pairs grows with the square of the clusters, never of the messages.
    More than KNOWN distinct values raise ValueError where neighbours are to be joined.
    """
    f = fields_of(aligned).where("label <> '-1'").select(F.col("label").cast("string").alias("label"), "col", "values")
    rows = f.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("col", "values"))).alias("f")).select("label", F.col("f.values").alias("f"))
    pair = rows.toDF("p", "fp").join(rows.toDF("q", "fq"), F.col("p") < F.col("q"))
    # values that occur at all, for neighbours to be joined to
    known = {bytes(r.bytes) for r in aligned.where("bytes IS NOT NULL").select("bytes").distinct().limit(KNOWN + 1).collect()} if join_neighbours else set()
    if len(known) > KNOWN:
        raise ValueError(f"more than {KNOWN} distinct values: neighbours can't be joined")

    def run(parts):
        for g in parts:
            out = []
            for p, q, fp, fq in zip(g.p, g.q, g.fp, g.fq, strict=True):
                a, b = align_fields([[bytes(v) for v in x] for x in fp], [[bytes(v) for v in x] for x in fq])
                if join_neighbours:
                    a, b = with_neighbours_joined(a, b, known)
                c = [conditions(x, y) for x, y in zip(a, b, strict=True)]
                held = []
                for k, (x, y, h) in enumerate(zip(a, b, c, strict=True)):
                    if not any(h[:5]) and (h[5] or h[6] or h[7]):
                        dynamic, value = (p, y[0]) if len(x) > 1 else (q, x[0])
                        held.append({"dynamic": dynamic, "place": k, "value": value, "inside": bool(h[5] or h[6])})
                torn = long_gap_alone([h[0] for h in c], a) or long_gap_alone([h[1] for h in c], b)
                out.append((p, q, len(c), sum(h[0] or h[1] for h in c), all(any(h[:7]) for h in c), torn, held))
            yield pd.DataFrame(out, columns=["p", "q", "fields", "gaps", "matched", "torn", "held"])

    return pair.mapInPandas(run, MATCHES)


def merge_pairs(found: DataFrame, clusters: int) -> DataFrame:
    """(p, q): pairs whose clusters become one.

    They match in all fields, have gaps in at most 0.4 of these (rounded up) and no long gap that stands alone. Where one dynamic field takes different static values (over 0.1
    apart) in several pairs, pairs whose value isn't among the field's own go; and so does every chain of pairs that holds more than 0.66 of all clusters.
    """
    good = found.where(F.col("matched") & ~F.col("torn") & (F.col("gaps") <= F.ceil(GAPS * F.col("fields"))))
    h = good.select("p", "q", F.explode("held").alias("h")).select("p", "q", "h.*")
    other = h.select(F.col("p").alias("p2"), F.col("q").alias("q2"), F.col("dynamic"), F.col("place"), F.col("value").alias("value2"))
    clash = h.where("NOT inside").join(other, ["dynamic", "place"]).where("(p <> p2 OR q <> q2) AND value <> value2")
    far = clash.where(S.dissimilarity(S.values(F.col("value")), S.values(F.col("value2"))) > 0.1).select("p", "q").distinct()
    left = good.select("p", "q").join(far, ["p", "q"], "left_anti")
    comp = named_components(left)
    large = comp.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > ALL * clusters).select("component")
    bad = comp.join(large, "component", "left_semi").select(F.col("node").alias("p"))
    return left.join(bad, "p", "left_anti")


def named_components(pairs: DataFrame) -> DataFrame:
    """(node, component) of pairs (p, q) of names; the component is its first name."""
    ids = pairs.select(F.explode(F.array("p", "q")).alias("node")).distinct()
    number = ids.withColumn("id", F.xxhash64("node"))
    edges = pairs.select(F.xxhash64("p").alias("a"), F.xxhash64("q").alias("b"))
    c = number.join(components(edges).withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = c.groupBy("component").agg(F.min("node").alias("first"))
    return c.join(first, "component").select("node", F.col("first").alias("component"))


def merged(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(msg_id, label): clusters that pairs connect under the first of their names."""
    return labels.join(named_components(pairs), F.col("label") == F.col("node"), "left").select("msg_id", F.coalesce("component", "label").alias("label"))


def cluster_distances(aligned: DataFrame) -> DataFrame:
    """(p, q, distance) of clusters by the alignment score of their fields: 0 for the greatest score that a pair can have, 100 for the least."""
    f = fields_of(aligned).select(F.col("label").cast("string").alias("label"), "col", "values")
    rows = f.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("col", "values"))).alias("f")).select("label", F.col("f.values").alias("f"))
    gap, mismatch, match = FIELD_SCORES

    def run(parts):
        for g in parts:
            out = []
            for p, q, fp, fq in zip(g.p, g.q, g.fp, g.fq, strict=True):
                a, b = [[bytes(v) for v in x] for x in fp], [[bytes(v) for v in x] for x in fq]
                s = A.last_line(list(range(len(a))), list(range(len(b))), lambda x, y, a=a, b=b: A.score_domain(field_similarity(a[x], b[y]), match, mismatch), gap)[-1]
                n = min(len(a), len(b))
                least, most = min(FIELD_SCORES) * n, match * n
                out.append((p, q, 100 - 100 * (s - least) / (most - least)))
            yield pd.DataFrame(out, columns=["p", "q", "distance"])

    return rows.toDF("p", "fp").join(rows.toDF("q", "fq"), F.col("p") < F.col("q")).mapInPandas(run, "p string, q string, distance double")


def missed_merges(labels: DataFrame, types: DataFrame) -> DataFrame:
    """(type, clusters): types that are the most frequent one of several clusters (msg_id, label; msg_id, type), with these in order. Of equally frequent types the first by name counts."""
    n = labels.join(types, "msg_id").groupBy("label", "type").agg(F.count("*").alias("n"))
    top = n.groupBy("label").agg(F.min(F.struct((-F.col("n")).alias("n"), "type")).alias("m")).select("label", F.col("m.type").alias("type"))
    return top.groupBy("type").agg(F.sort_array(F.collect_list(F.col("label").cast("string"))).alias("clusters")).where(F.size("clusters") > 1)


def to_first(aligned: DataFrame) -> DataFrame:
    """(label, col, msg_id, d): dissimilarity of each value of a column to that of its first message that has one; null for a gap."""
    first = aligned.where("bytes IS NOT NULL").groupBy("label", "col").agg(F.min_by("bytes", "msg_id").alias("f"))
    x = aligned.join(first, ["label", "col"])
    d = F.when(F.col("bytes").isNotNull(), S.dissimilarity(S.values(F.col("bytes")), S.values(F.col("f"))))
    return x.select("label", "col", "msg_id", d.alias("d"))


def without_gaps(aligned: DataFrame) -> DataFrame:
    """(label, msg_id, values): each message's values in the order of their columns."""
    return aligned.where("bytes IS NOT NULL").groupBy("label", "msg_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.hex("bytes").alias("h")))), lambda s: s["h"]), " ").alias("values"))


def progressive_alignment(segments: DataFrame, labels: DataFrame, centres: DataFrame) -> DataFrame:
    """(label, msg_id, col, bytes): members aligned to their centre one after the other, the nearest first; a gap of the centre is filled with the first value that was aligned there.

    Each alignment builds on the ones before, so that a cluster's distinct messages come together in one task; ``alignment.star_alignment`` is the form in which they don't.
    segments are (msg_id, seg_no, bytes), labels (msg_id, label, d) with the distance to the centre, centres (label, medoid).
    """
    parts = F.array_sort(F.collect_list(F.struct("seg_no", "bytes"))).alias("p")
    m = segments.where(F.octet_length("bytes") > 0).groupBy("msg_id").agg(parts).select("msg_id", F.col("p.bytes").alias("p"))
    x = labels.where("label <> -1").join(m, "msg_id").join(centres, "label").select(F.col("label").cast("bigint").alias("label"), "msg_id", (F.col("msg_id") == F.col("medoid")).alias("centre"), "d", "p")

    def align(key, g):
        g = g.sort_values(["centre", "d", "msg_id"], ascending=[False, True, True])
        rows: list[list] = []
        for p in g.p:
            p = [bytes(v) for v in p]
            if not rows:
                rows.append(p)
                continue
            filled = [next((r[k] for r in rows if r[k] is not None), None) for k in range(len(rows[0]))]
            at, own = A.divided_alignment(list(range(len(filled))), p, lambda k, v, f=filled: 1 - A.value_dissimilarity(f[k], v) if f[k] != v else 1.0)
            rows = [[None if k is None else r[k] for k in at] for r in rows]
            rows.append(own)
        out = [(key[0], i, k, v) for i, r in zip(g.msg_id, rows, strict=True) for k, v in enumerate(r)]
        return pd.DataFrame(out, columns=["label", "msg_id", "col", "bytes"])

    return x.groupBy("label").applyInPandas(align, "label bigint, msg_id bigint, col int, bytes binary")

