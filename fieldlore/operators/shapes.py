"""Distances inside clusters and between them, counted where pairs are compared: no table of pairs is made.

Values (rep_id, bytes) are in an index that every task has, clusters are (id, label), noise -1. Distances are whole numbers of units of their last digit, so that sums are
exact. All pairs of a cluster are compared, a part of the leaves in each task; a task gives counts, sums and least ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlore.operators import pairwise as P
from fieldlore.operators.lineage import once


class Clusters:
    """An index in every task with the cluster of each place: names in order, and by place the number of the name, -1 for noise."""

    def __init__(self, index: Broadcast, labels: DataFrame) -> None:
        self.index, self.spark = index, labels.sparkSession
        self.kind = labels.schema["label"].dataType.simpleString()
        t = labels.where("label <> -1").select("id", "label").toArrow()
        self.names, code = np.unique(t["label"].to_numpy(), return_inverse=True)
        self.label = self.spark.sparkContext.broadcast(P.placed(index.value, t["id"].to_numpy(), code))

    def by_leaves(self, work, schema: str) -> DataFrame:
        """What work(index, label, leaves) makes, as tables."""
        index, label = self.index, self.label
        return P._by_leaves(self.spark, index.value.leaves, lambda leaves: work(index.value, label.value, leaves), schema)


def _own(index, label, leaf, digits):
    """(cluster, rows, columns, codes, which are pairs): a leaf's places and the later ones of their cluster, each pair once."""
    rows = index.rows(leaf)
    for c in np.unique(label[rows][label[rows] >= 0]).tolist():
        own = rows[label[rows] == c]
        columns = own[0] + np.flatnonzero(label[own[0] :] == c)
        for part, code in index.codes(own, columns, digits):
            yield c, part, columns, code, part[:, None] < columns


#: Codes of a part of a histogram.
SPAN = 1 << 14


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and their counts added up."""
    at, place = np.unique(codes, return_inverse=True)
    out = np.zeros(len(at), np.int64)
    np.add.at(out, place, n)
    return at, out


def percentile(codes: np.ndarray, n: np.ndarray, share: float, unit: float) -> float:
    """The exact percentile of codes in order that occur n times, as Spark gives it: on the line between its two neighbours."""
    upto, at = np.cumsum(n), (int(n.sum()) - 1) * share
    low, high = (codes[np.searchsorted(upto, k, side="right")] / unit for k in (math.floor(at), math.ceil(at)))
    return float(low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)


def counts(clusters: Clusters, digits: int, share: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """(label, most, cut, all): the greatest distance inside a cluster, a percentile, and the deviation of those under it; and (label, id, s): each member's sum of distances in units.

    Two checkpoints. Tasks count distances; counts of one span of them are added up in a task, and a cluster's counts come together in one.
    """
    names, unit = clusters.names, 10.0**digits
    schema = f"label {clusters.kind}, id bigint, x bigint, codes array<bigint>, n array<bigint>"

    def work(index, label, leaves):
        n, sums, seen = {}, np.zeros(len(label), np.int64), np.zeros(len(label), bool)
        size = np.bincount(label[label >= 0])
        for leaf in leaves:
            for c, rows, columns, code, pair in _own(index, label, leaf, digits):
                found = np.bincount(code[pair])
                more = len(found) - len(n.setdefault(c, np.zeros(0, np.int64)))
                if more > 0:
                    n[c] = np.pad(n[c], (0, more))
                n[c][: len(found)] += found
                seen[rows] = size[c] > 1
                code[~pair] = 0
                sums[rows] += code.sum(1)
                sums[columns] += code.sum(0)
        for c, found in n.items():
            at = np.flatnonzero(found)
            # a cluster of one value has no distances
            for part in np.split(at, np.flatnonzero(np.diff(at // SPAN)) + 1) if len(at) else []:
                yield pa.table({"label": pa.array(names[[c]]), "id": pa.nulls(1, pa.int64()), "x": [int(part[0]) // SPAN], "codes": pa.array([part]), "n": pa.array([found[part]])})
        at = np.flatnonzero(seen | (sums > 0))
        none = pa.nulls(len(at), pa.list_(pa.int64()))
        yield pa.table({"label": pa.array(names[label[at]]), "id": pa.array(index.ids[at].astype(np.int64)), "x": sums[at], "codes": none, "n": none})

    def joined(g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return _summed(*(g[c].combine_chunks().flatten().to_numpy() for c in ("codes", "n")))

    def add(g: pa.Table) -> pa.Table:
        at, n = joined(g)
        return pa.table({"label": g["label"][:1], "codes": pa.array([at]), "n": pa.array([n])})

    def shape(g: pa.Table) -> pa.Table:
        at, n = joined(g)
        cut = percentile(at, n, share, unit)
        calm = at / unit < cut
        d, k = at[calm] / unit, n[calm]
        mean = (at[calm] * k).sum() / unit / k.sum() if calm.any() else 0.0
        deviation = float(np.sqrt(((d - mean) ** 2 * k).sum() / k.sum())) if calm.any() else None
        return pa.table({"label": g["label"][:1], "most": [float(at[-1] / unit)], "cut": [cut], "all": pa.array([deviation], pa.float64())})

    made = once(clusters.by_leaves(work, schema))
    parts = made.where("id IS NULL").select("label", "x", "codes", "n").groupBy("label", "x").applyInArrow(add, f"label {clusters.kind}, codes array<bigint>, n array<bigint>")
    shapes = parts.groupBy("label").applyInArrow(shape, f"label {clusters.kind}, most double, cut double, all double")
    return once(shapes), once(made.where("id IS NOT NULL").groupBy("label", "id").agg(F.sum("x").alias("s")))


def walks(clusters: Clusters, sums: DataFrame, digits: int) -> DataFrame:
    """(label, step, id, d, first, growth): semantics.walks, with the first of trace_means and its mean growth; a checkpoint. Each cluster is one task's work.

    Means that are subtracted from one another leave the last less the first one, so that only neighbours and the two ends are compared.
    """
    index, told, names, unit = clusters.index, clusters.label, clusters.names, 10.0**digits
    starts = sums.groupBy("label").agg(F.min(F.struct((-F.col("s")).alias("s"), "id")).alias("m")).select("label", "m.id").toArrow()
    start = P.placed(index.value, starts["id"].to_numpy(), np.searchsorted(names, starts["label"].to_numpy()))
    # the largest first, dealt to tasks by turns
    size = np.bincount(told.value[told.value >= 0], minlength=1)
    work = sorted(((int(k), int(start[k])) for k in np.flatnonzero(start >= 0)), key=lambda x: -size[x[1]])

    def go(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                for at, c in work[k::tasks]:
                    places = np.flatnonzero(told.value == c)
                    path, way = index.value.walk(places, at, digits)
                    first, last = index.value.trace(places, at, digits)
                    m = len(path)
                    growth = (last - first) / (m - 2) if m > 2 else None
                    d = pa.array(way / unit, mask=way < 0)
                    yield from pa.table({"label": pa.array(names[np.full(m, c)]), "step": np.arange(m, dtype=np.int32), "id": index.value.ids[path].astype(np.int64), "d": d, "first": np.full(m, first), "growth": pa.array([growth] * m, pa.float64())}).to_batches()

    tasks = max(1, min(len(work), 4 * clusters.spark.sparkContext.defaultParallelism))
    return once(clusters.spark.range(0, tasks, 1, tasks).mapInArrow(go, f"label {clusters.kind}, step int, id bigint, d double, first double, growth double"))


def nearest_links(clusters: Clusters, digits: int) -> tuple[DataFrame, DataFrame]:
    """(label, mean, extent) of distances inside a cluster, and (p, q, least, i, j): the nearest pair of two clusters, p < q, ties by ids; two checkpoints."""
    names, unit = clusters.names, 10.0**digits

    def work(index, label, leaves):
        inside, best = {}, {}
        for leaf in leaves:
            for c, _, _, code, pair in _own(index, label, leaf, digits):
                if pair.any():
                    n, s, most = inside.get(c, (0, 0, 0))
                    inside[c] = n + int(pair.sum()), s + int(code[pair].sum()), max(most, int(code[pair].max()))
            rows = index.rows(leaf)
            for c in np.unique(label[rows][label[rows] >= 0]).tolist():
                own = rows[label[rows] == c]
                columns = rows[0] + np.flatnonzero((label[rows[0] :] >= 0) & (label[rows[0] :] != c))
                if not len(columns):
                    continue
                order = np.argsort(label[columns], kind="stable")
                other, first = np.unique(label[columns][order], return_index=True)
                for part, code in index.codes(own, columns, digits):
                    code = code[:, order]
                    least = np.minimum.reduceat(code, first, axis=1).min(0)
                    # ties are looked for only where they may be the best so far
                    for k, o in enumerate(other.tolist()):
                        key = (min(c, o), max(c, o))
                        if key in best and best[key][0] < least[k]:
                            continue
                        end = first[k + 1] if k + 1 < len(first) else len(order)
                        a, b = np.nonzero(code[:, first[k] : end] == least[k])
                        x, y = index.ids[part[a]], index.ids[columns[order[first[k] + b]]]
                        i, j = (x, y) if c < o else (y, x)
                        at = np.lexsort((j, i))[0]
                        best[key] = min(best.get(key, (np.inf,)), (int(least[k]), int(i[at]), int(j[at])))
        if inside:
            c, x = list(inside), list(zip(*inside.values(), strict=True))
            yield pa.table({"p": pa.array(names[c]), "q": pa.array(names[c]), "n": pa.array(x[0], pa.int64()), "s": pa.array(x[1], pa.int64()), "x": pa.array(x[2], pa.int64()), "i": pa.nulls(len(c), pa.int64()), "j": pa.nulls(len(c), pa.int64())})
        if best:
            p, q = (list(x) for x in zip(*best, strict=True))
            x, i, j = (pa.array(x, pa.int64()) for x in zip(*best.values(), strict=True))
            yield pa.table({"p": pa.array(names[p]), "q": pa.array(names[q]), "n": pa.nulls(len(p), pa.int64()), "s": pa.nulls(len(p), pa.int64()), "x": x, "i": i, "j": j})

    made = once(clusters.by_leaves(work, f"p {clusters.kind}, q {clusters.kind}, n bigint, s bigint, x bigint, i bigint, j bigint"))
    shape = made.where("p = q").groupBy(F.col("p").alias("label")).agg((F.sum("s") / F.lit(unit) / F.sum("n")).alias("mean"), (F.max("x") / F.lit(unit)).alias("extent"))
    links = made.where("p <> q").groupBy("p", "q").agg(F.min(F.struct("x", "i", "j")).alias("m")).select("p", "q", (F.col("m.x") / F.lit(unit)).alias("least"), "m.i", "m.j")
    return once(shape), once(links)


#: Distinct distances of pairs of clusters that a task holds at once.
HELD = 1 << 21


def link_counts(clusters: Clusters, digits: int) -> DataFrame:
    """(p, q, least, most, mean, median, deviation) of distances between two clusters, p < q; pairs inside a cluster aren't compared.

    Tasks count distances; counts of one span of them are added up in a task, and those of two clusters come together in one.
    """
    names, unit, base = clusters.names, 10.0**digits, 1 << 32
    kind = f"p {clusters.kind}, q {clusters.kind}"

    def rows_of(key, n):
        at, code = key // base, key % base
        ends = np.append(np.flatnonzero((np.diff(at) != 0) | (np.diff(code // SPAN) != 0)) + 1, len(key))
        start, own = np.append(0, ends[:-1]), at[ends - 1]
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(x))
        return pa.table({"p": pa.array(names[own // len(names)]), "q": pa.array(names[own % len(names)]), "x": code[start] // SPAN, "codes": lists(code), "n": lists(n)})

    def work(index, label, leaves):
        key, n, held, size = [], [], np.zeros(0, np.int64), 0
        for leaf in leaves:
            rows = index.rows(leaf)
            for c in np.unique(label[rows][label[rows] >= 0]).tolist():
                own = rows[label[rows] == c]
                columns = own[0] + np.flatnonzero((label[own[0] :] >= 0) & (label[own[0] :] != c))
                if not len(columns):
                    continue
                pair = (np.minimum(label[columns], c) * len(names) + np.maximum(label[columns], c)) * base
                for part, code in index.codes(own, columns, digits):
                    # two of one leaf are met from both sides
                    found = np.unique((pair + code)[part[:, None] < columns], return_counts=True)
                    key.append(found[0])
                    n.append(found[1])
                    size += len(found[0])
                    if size > HELD + 2 * len(held):
                        held, count = _summed(np.concatenate(key), np.concatenate(n))
                        key, n, size = [held], [count], len(held)
                        if size > HELD:
                            yield rows_of(held, count)
                            key, n, held, size = [], [], held[:0], 0
        if size:
            yield rows_of(*_summed(np.concatenate(key), np.concatenate(n)))

    def joined(g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return _summed(*(g[c].combine_chunks().flatten().to_numpy() for c in ("codes", "n")))

    def add(g: pa.Table) -> pa.Table:
        at, n = joined(g)
        return pa.table({"p": g["p"][:1], "q": g["q"][:1], "codes": pa.array([at]), "n": pa.array([n])})

    def statistics(g: pa.Table) -> pa.Table:
        at, n = joined(g)
        mean = float(at.astype(float) @ n) / unit / n.sum()
        deviation = float(np.sqrt((at / unit - mean) ** 2 @ n / n.sum()))
        return pa.table({"p": g["p"][:1], "q": g["q"][:1], "least": [float(at[0] / unit)], "most": [float(at[-1] / unit)], "mean": [mean], "median": [percentile(at, n, 0.5, unit)], "deviation": [deviation]})

    parts = clusters.by_leaves(work, f"{kind}, x bigint, codes array<bigint>, n array<bigint>").groupBy("p", "q", "x").applyInArrow(add, f"{kind}, codes array<bigint>, n array<bigint>")
    return parts.groupBy("p", "q").applyInArrow(statistics, f"{kind}, least double, most double, mean double, median double, deviation double")


def densities(clusters: Clusters, ends: DataFrame, digits: int) -> DataFrame:
    """(p, q, end, density): the median distance from an end (p, q, end, reach) to its fellows within reach; null without any."""
    index, told = clusters.index, clusters.label

    def go(batches):
        order = np.argsort(index.value.ids, kind="stable")
        for b in batches:
            out = []
            for end, reach in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                at = order[np.searchsorted(index.value.ids[order], end)]
                fellows = np.flatnonzero(told.value == told.value[at])
                fellows = fellows[fellows != at]
                d = np.concatenate([x[0] for _, x in index.value.codes(np.array([at]), fellows, digits)]) / 10.0**digits if len(fellows) else np.zeros(0)
                d = d[d <= reach]
                out.append(float(np.median(d)) if len(d) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.float64())], names=["p", "q", "end", "density"])

    kind = f"p {clusters.kind}, q {clusters.kind}, end bigint"
    return ends.select("p", "q", F.col("end").cast("bigint").alias("end"), "reach").mapInArrow(go, f"{kind}, density double")
