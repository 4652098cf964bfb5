"""What clusters look like and what they may mean: labels, walks, shapes, densities and hypotheses of a field's role.

Clusters are (id, label), noise -1; distances (i, j, d), i < j; values (id, bytes, n): each distinct value with its occurrences. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlore.functions import series as S
from fieldlore.operators import clusters as C
from fieldlore.operators import pairwise as P
from fieldlore.operators import shapes as H
from fieldlore.operators.lineage import components, once

#: Percentile above which distances are outliers, ratio of deviations, and slope of a linear chain.
OUTLIER, CHAIN_RATIO, CHAIN_SLOPE = 99, 0.4, 3.0


def lengths_and_text(labels: DataFrame, values: DataFrame) -> DataFrame:
    """(label, lengths, text, members): distinct lengths in order, text-like members, all members."""
    x = labels.where("label <> -1").join(values.select("id", "bytes"), "id")
    text = F.coalesce(S.text_like(S.values(F.col("bytes"))), F.lit(False))
    return x.groupBy("label").agg(F.sort_array(F.collect_set(F.octet_length("bytes"))).alias("lengths"), F.sum(text.cast("bigint")).alias("text"), F.count("*").alias("members"))


def largest_distance(d: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, most): the greatest distance inside each cluster, 0 for a single member."""
    most = C.inside(d, labels).groupBy("label").agg(F.max("d").alias("most"))
    return labels.where("label <> -1").select("label").distinct().join(most, "label", "left").fillna(0.0, ["most"])


def names(d: DataFrame, labels: DataFrame, values: DataFrame) -> DataFrame:
    """(label, name): a text with each cluster's number, size, greatest distance and lengths; of the noise its size and lengths."""
    lengths = F.array_join(F.transform(F.sort_array(F.collect_set(F.octet_length("bytes"))), lambda n: n.cast("string")), " ")
    x = labels.join(values.select("id", "bytes"), "id").groupBy("label").agg(F.count("*").alias("n"), lengths.alias("lengths")).join(largest_distance(d, labels), "label", "left")
    cluster = F.format_string("Cluster #%02d: %d Seg.s (d_max=%.3f, %s bytes)", F.col("label"), F.col("n"), F.col("most"), F.col("lengths"))
    return x.select("label", F.when(F.col("label") == -1, F.format_string("Noise: %d Seg.s (%s bytes)", F.col("n"), F.col("lengths"))).otherwise(cluster).alias("name"))


def cauldron(labels: DataFrame, values: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(kind, label, id): clusters of more than three distinct values are regular, others singular; of the noise each distinct value is there once."""
    regular = C.regular(labels).select("label", F.when(F.col("regular"), "regular").otherwise("singular").alias("kind"))
    noise = labels.where("label = -1").join(values.select("id", "bytes"), "id").groupBy("bytes").agg(F.min("id").alias("id"))
    return labels.join(regular, "label").select("kind", "label", "id").union(noise.select(F.lit("noise"), F.lit(-1), "id"))


def singular_from_noise(labels: DataFrame, values: DataFrame) -> DataFrame:
    """(id, label): noise values that occur more often than the logarithm of all occurrences become clusters of their own, labelled by minus two less their id."""
    often = labels.join(values.select("id", "n"), "id").crossJoin(values.agg(F.log(F.sum("n")).alias("bound")))  # one row
    return often.select("id", F.when((F.col("label") == -1) & (F.col("n") > F.col("bound")), -2 - F.col("id")).otherwise(F.col("label")).alias("label"))


def append_text(labels: DataFrame, values: DataFrame, label: int) -> DataFrame:
    """labels with the text-like values that have none as one more cluster."""
    text = values.where(F.coalesce(S.text_like(S.values(F.col("bytes"))), F.lit(False))).select("id").join(labels, "id", "left_anti")
    return labels.select("id", F.col("label").cast("bigint").alias("label")).union(text.select("id", F.lit(label).cast("bigint")))


def of_unique_values(labels: DataFrame, segments: DataFrame) -> DataFrame:
    """(bytes, name): the label of each distinct value of segments (id, bytes) by the clusters of its copies: [mixed] for several, [unknown] for none."""
    x = segments.join(labels, "id", "left").groupBy("bytes").agg(F.min("label").alias("a"), F.max("label").alias("z"))
    return x.select("bytes", F.when(F.col("a").isNull(), "[unknown]").when(F.col("a") == F.col("z"), F.col("a").cast("string")).otherwise("[mixed]").alias("name"))


def link_statistics(d: DataFrame, labels: DataFrame) -> DataFrame:
    """(p, q, least, most, mean, median, deviation, i, j) of distances between two clusters, p < q, with their nearest pair (i in p, j in q)."""
    a = labels.where("label <> -1")
    x = d.join(a.select(F.col("id").alias("i"), F.col("label").alias("li")), "i").join(a.select(F.col("id").alias("j"), F.col("label").alias("lj")), "j").where("li <> lj")
    x = x.select(F.least("li", "lj").alias("p"), F.greatest("li", "lj").alias("q"), "d", F.when(F.col("li") < F.col("lj"), F.col("i")).otherwise(F.col("j")).alias("i"), F.when(F.col("li") < F.col("lj"), F.col("j")).otherwise(F.col("i")).alias("j"))
    g = x.groupBy("p", "q").agg(F.min("d").alias("least"), F.max("d").alias("most"), F.avg("d").alias("mean"), F.median("d").alias("median"), F.stddev_pop("d").alias("deviation"), F.min(F.struct("d", "i", "j")).alias("m"))
    return g.select("p", "q", "least", "most", "mean", "median", "deviation", "m.i", "m.j")


def link_statistics_of(reps: DataFrame, labels: DataFrame, digits: int = 6) -> DataFrame:
    """link_statistics of values (rep_id, bytes) but the nearest pair, counted where pairs are compared; more values than an index takes are compared by a table of pairs."""
    index = P.sent(reps)
    if index is None:
        return link_statistics(P.distances(reps, digits=digits), labels).drop("i", "j")
    return H.link_counts(H.Clusters(index, labels), digits)


def density_pairs(d: DataFrame, labels: DataFrame, near: float = 0.01, alike: float = 0.002, nearest: DataFrame | None = None) -> DataFrame:
    """(p, q): clusters to be merged, since they are very close with links of like density, or rather close with like densities in all.

    Very close: their least distance is under the mean distance inside either one. The density of a link's end is the median distance to its fellows within half
    the extent of the smaller cluster. Rather close: under the mean of both clusters' ratios of the median nearest distance to the mean one. The two nearest neighbours may be given.
    """
    inner = once(C.inside(d, labels))
    shape = inner.groupBy("label").agg(F.avg("d").alias("mean"), F.max("d").alias("extent"))
    both = inner.union(inner.select("label", F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    # the second nearest of a member, as its nearest may be its own twin
    second = (P.neighbours(d, 2) if nearest is None else nearest).where("rank = 2").select(F.col("i").alias("id"), "d").join(labels, "id").groupBy("label").agg(F.median("d").alias("near"))
    shape = once(shape.join(second, "label"))
    side = lambda s: shape.select(*(F.col(c).alias(f"{c}_{s}") for c in ("label", "mean", "extent", "near")))
    links = link_statistics(d, labels).select("p", "q", "least", "i", "j")
    x = links.join(side("p"), F.col("p") == F.col("label_p")).join(side("q"), F.col("q") == F.col("label_q")).withColumn("reach", F.least("extent_p", "extent_q") / 2)

    def density(end, name):
        fellows = both.select(F.col("i").alias("e"), F.col("d").alias("f"))
        return x.select("p", "q", end, "reach").join(fellows, (F.col(end) == F.col("e")) & (F.col("f") <= F.col("reach"))).groupBy("p", "q").agg(F.median("f").alias(name))

    return _to_merge(x.join(density("i", "di"), ["p", "q"], "left").join(density("j", "dj"), ["p", "q"], "left"), near, alike)


def _to_merge(x: DataFrame, near: float, alike: float) -> DataFrame:
    close = ((F.col("least") < F.col("mean_p")) | (F.col("least") < F.col("mean_q"))) & (F.abs(F.col("di") - F.col("dj")) < near)
    loose = (F.col("least") < (F.try_divide(F.col("near_p"), F.col("mean_p")) + F.try_divide(F.col("near_q"), F.col("mean_q"))) / 2) & (F.abs(F.col("near_p") - F.col("near_q")) < alike)
    return x.where(F.coalesce(close, F.lit(False)) | F.coalesce(loose, F.lit(False))).select("p", "q")


def density_pairs_of(reps: DataFrame, labels: DataFrame, near: float = 0.01, alike: float = 0.002, digits: int = 6) -> DataFrame:
    """density_pairs of values (rep_id, bytes), whose pairs are compared but not kept; more values than an index takes are compared by a table of pairs."""
    index = P.sent(reps)
    nearest = P.nearest(reps, 2, digits=digits, index=index)
    if index is None:
        return density_pairs(once(P.distances(reps, digits=digits)), labels, near, alike, nearest)
    clusters = H.Clusters(index, labels)
    shape, links = H.nearest_links(clusters, digits)
    second = nearest.where("rank = 2").select(F.col("i").alias("id"), "d").join(labels, "id").groupBy("label").agg(F.median("d").alias("near"))
    shape = once(shape.join(second, "label"))
    side = lambda s: shape.select(*(F.col(c).alias(f"{c}_{s}") for c in ("label", "mean", "extent", "near")))
    x = links.join(side("p"), F.col("p") == F.col("label_p")).join(side("q"), F.col("q") == F.col("label_q")).withColumn("reach", F.least("extent_p", "extent_q") / 2)
    # only ends that a rule asks for: the others can't be close
    ends = x.where("least < mean_p OR least < mean_q").select("p", "q", F.explode(F.array("i", "j")).alias("end"), "reach")
    found = once(H.densities(clusters, ends, digits))
    density = lambda end, name: found.select("p", "q", F.col("end").alias(end), F.col("density").alias(name))
    return _to_merge(x.join(density("i", "di"), ["p", "q", "i"], "left").join(density("j", "dj"), ["p", "q", "j"], "left"), near, alike)


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): clusters that pairs (p, q) connect get the smallest label among them."""
    c = components(edges.select(F.col("p").cast("bigint").alias("a"), F.col("q").cast("bigint").alias("b")))
    return labels.join(c, F.col("label") == F.col("node"), "left").select("id", F.coalesce("component", "label").alias("label"))


def walks(d: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, step, id, d): from the member with the largest sum of distances always on to the nearest one not yet met; d is the way there, null at the start.

    A walk is one after the other by nature: a cluster's distances come together in one task.
    """

    def walk(key, g):
        ids = np.unique(np.concatenate([g.i, g.j]))
        m = np.full((len(ids), len(ids)), np.inf)
        a, b = np.searchsorted(ids, g.i), np.searchsorted(ids, g.j)
        m[a, b] = m[b, a] = g.d
        sums = np.round(np.where(np.isinf(m), 0, m).sum(1), 9)
        at = int(sums.argmax())
        path, way = [at], [None]
        for _ in range(len(ids) - 1):
            m[:, at] = np.inf
            nxt = int(m[at].argmin())
            way.append(float(m[at, nxt]))
            path.append(nxt)
            at = nxt
        return pd.DataFrame({"label": [key[0]] * len(path), "step": range(len(path)), "id": ids[path], "d": way}).astype({"step": "int32", "d": "float64"})

    kind = labels.schema["label"].dataType.simpleString()
    return C.inside(d, labels).groupBy("label").applyInPandas(walk, f"label {kind}, step int, id bigint, d double")


def shapes(d: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, linear1, linear3, linear4, chaotic): whether a cluster looks like a chain or a blob.

    linear1: the walk is shorter than the greatest distance times the logarithm of its length; chaotic: 1.2 times as long or more. linear3: the walk's steps deviate
    far less than all distances, outliers left out. linear4: the first mean over neighbours in order of distance from one end is small against how it grows.
    """
    inner, walk = once(C.inside(d, labels)), once(walks(d, labels))
    top = inner.groupBy("label").agg(F.max("d").alias("most"), F.percentile("d", F.lit(OUTLIER / 100)).alias("cut"))
    calm = inner.join(top, "label").where("d < cut").groupBy("label").agg(F.stddev_pop("d").alias("all"))
    trace = C.trace_means(d, labels)
    w = Window.partitionBy("label").orderBy("step")
    grow = trace.withColumn("g", F.col("mean") - F.lag("mean").over(w)).groupBy("label").agg(F.avg("g").alias("growth"), F.min_by("mean", "step").alias("first"))
    return _signs(top, calm, walk, grow)


def _signs(top: DataFrame, calm: DataFrame, walk: DataFrame, grow: DataFrame) -> DataFrame:
    way = walk.where("d IS NOT NULL").groupBy("label").agg(F.sum("d").alias("path"), (F.count("*") + 1).alias("n"), F.percentile("d", F.lit(OUTLIER / 100)).alias("cut2"))
    steps = walk.join(way, "label").where("d < cut2").groupBy("label").agg(F.stddev_pop("d").alias("own"))
    x = top.join(way, "label").join(calm, "label", "left").join(steps, "label", "left").join(grow, "label", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    reach = F.col("most") * F.log("n")
    return x.select("label", yes(F.col("path") < reach).alias("linear1"), yes(F.try_divide(F.col("own"), F.col("all")) < CHAIN_RATIO).alias("linear3"), yes(F.try_divide(F.col("first"), F.col("growth")) < CHAIN_SLOPE).alias("linear4"), yes(F.col("path") > 1.2 * reach).alias("chaotic"))


def shapes_of(reps: DataFrame, labels: DataFrame, digits: int = 6) -> DataFrame:
    """shapes of values (rep_id, bytes), whose pairs are counted but not kept; more values than an index takes are compared by a table of pairs."""
    index = P.sent(reps)
    if index is None:
        return shapes(once(P.distances(reps, digits=digits)), labels)
    clusters = H.Clusters(index, labels)
    inner, sums = H.counts(clusters, digits, OUTLIER / 100)
    walk = H.walks(clusters, sums, digits)
    return _signs(inner.select("label", "most"), inner.select("label", "all"), walk, walk.where("step = 0").select("label", "first", "growth"))


def zero_share(labels: DataFrame, values: DataFrame) -> DataFrame:
    """(label, zeros): the share of zero bytes in a cluster's values if zero is the most frequent byte (the smaller of equally frequent ones), else 0."""
    x = labels.where("label <> -1").join(values.select("id", "bytes"), "id").select("label", F.explode(S.values(F.col("bytes"))).alias("byte"))
    n = x.groupBy("label", "byte").agg(F.count("*").alias("n")).groupBy("label").agg(F.sum("n").alias("all"), F.min(F.struct((-F.col("n")).alias("n"), "byte")).alias("m"))
    return n.select("label", F.when(F.col("m.byte") == 0, -F.col("m.n") / F.col("all")).otherwise(0.0).alias("zeros"))


def hypotheses(d: DataFrame | None, labels: DataFrame, values: DataFrame, shape: DataFrame | None = None) -> DataFrame:
    """(label, hypothesis): what each cluster's field may be, by the first rule that holds; null where none does. The clusters' shapes may be given instead of distances.

    pad (over 95 % zeros), nothing for three values or fewer, payload (over 80 % text), timestamp (rank over 95, no chain, a blob, 3 to 8 bytes),
    id/flags/int (rank over 85, 2 to 4 bytes), addr/seq (a chain of rank 70 to 92.5 and no blob, or rank under 35).
    """
    o = C.occurrences(labels, values.select("id", "n")).select("label", F.col("values").alias("distinct"), "rank")
    x = zero_share(labels, values).join(lengths_and_text(labels, values), "label").join(o, "label").join(shapes(d, labels) if shape is None else shape, "label", "left").fillna(False, ["linear4", "chaotic"])
    least, most = F.array_min("lengths"), F.array_max("lengths")
    rank = F.col("rank")
    rule = (
        F.when(F.col("zeros") > 0.95, "pad")
        .when(F.col("distinct") <= 3, F.lit(None))
        .when(F.col("text") / F.col("members") > 0.8, "payload")
        .when((rank > 95) & ~F.col("linear4") & F.col("chaotic") & (least >= 3) & (most <= 8), "timestamp")
        .when((rank > 85) & (least >= 2) & (most <= 4), "id/flags/int")
        .when(rank.between(70, 92.5) & F.col("linear4") & ~F.col("chaotic"), "addr/seq")
        .when(rank < 35, "addr/seq")
    )
    return x.select("label", rule.alias("hypothesis"))


def skewness(labels: DataFrame, values: DataFrame, percent: float = 90) -> DataFrame:
    """(label, skew, percentile): (mode - median) / deviation of the occurrences of a cluster's values (the smallest mode; null without deviation), and a percentile of them."""
    x = labels.where("label <> -1").join(values.select("id", "n"), "id")
    mode = x.groupBy("label", "n").agg(F.count("*").alias("k")).groupBy("label").agg(F.min(F.struct((-F.col("k")).alias("k"), "n")).alias("m")).select("label", F.col("m.n").alias("mode"))
    g = x.groupBy("label").agg(F.median("n").alias("median"), F.stddev_pop("n").alias("deviation"), F.percentile("n", F.lit(percent / 100)).alias("percentile"))
    return g.join(mode, "label").select("label", F.try_divide(F.col("mode") - F.col("median"), F.col("deviation")).alias("skew"), "percentile")


def eigenvalues(labels: DataFrame, values: DataFrame) -> DataFrame:
    """(label, eigen, direction): absolute eigenvalues of the covariance of a cluster's values of its longest length, in order, and whether the greatest exceeds five times the next."""
    x = labels.where("label <> -1").join(values.select("id", "bytes"), "id").withColumn("k", F.octet_length("bytes"))
    x = x.join(x.groupBy("label").agg(F.max("k").alias("k")), ["label", "k"]).where("k > 0")
    v = x.select("label", "k", S.values(F.col("bytes")).alias("v"))
    # sums and products of places are added up before they meet: k numbers, and k by k
    cell = v.select("label", "k", F.posexplode("v").alias("p", "a"), "v").select("label", "k", "p", "a", F.posexplode("v").alias("q", "b"))
    m = cell.groupBy("label", "k", "p", "q").agg(F.count("*").alias("n"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    m = m.select("label", "k", "p", "q", F.when(F.col("n") > 1, (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / (F.col("n") - 1)).otherwise(0.0).alias("c"))

    def solve(key, g):
        n = int(key[1])
        c = np.zeros((n, n))
        c[g.p, g.q] = g.c
        e = np.sort(np.abs(np.linalg.eigvalsh(c)))
        return pd.DataFrame({"label": [key[0]], "eigen": [e.tolist()], "direction": [bool(n > 1 and e[-1] > 5 * e[-2])]})

    kind = labels.schema["label"].dataType.simpleString()
    return m.groupBy("label", "k").applyInPandas(solve, f"label {kind}, eigen array<double>, direction boolean")


def shape_report(d: DataFrame, labels: DataFrame, values: DataFrame) -> DataFrame:
    """One row for each cluster: size, lengths, greatest, mean and median distance, occurrences, rank, chain and blob signs, zeros and text."""
    inner = C.inside(d, labels).groupBy("label").agg(F.max("d").alias("most"), F.avg("d").alias("mean"), F.median("d").alias("median"), F.stddev_pop("d").alias("deviation"))
    o = C.occurrences(labels, values.select("id", "n")).select("label", "total", "rank", "spread")
    return lengths_and_text(labels, values).join(inner, "label", "left").join(o, "label").join(shapes(d, labels), "label", "left").join(zero_share(labels, values), "label")


def nested(labels: DataFrame, values: DataFrame, types: DataFrame) -> DataFrame:
    """(part, label, type, id): noise, text-like values, values that are alone in their cluster, and the others by cluster, each with the type (id, type) of a value."""
    text = F.coalesce(S.text_like(S.values(F.col("bytes"))), F.lit(False))
    size = labels.where("label <> -1").groupBy("label").agg(F.count("*").alias("size"))
    x = labels.join(values.select("id", text.alias("text")), "id").join(size, "label", "left").join(types, "id", "left")
    part = F.when(F.col("text"), "text").when(F.col("label") == -1, "noise").when(F.col("size") == 1, "singular").otherwise("cluster")
    return x.select(part.alias("part"), "label", F.coalesce("type", F.lit("[unknown]")).alias("type"), "id")
