"""Refinement by principal components: where, among values that are alike, variation begins or ends, a field's bound is.

Distinct values of relevant segments are clustered. A cluster's values are laid over one another with the bytes that stand beside them; from the eigenvectors of
their covariance come places at which contributions drop to nothing or rise from it. These, and starts and ends that many of the cluster's segments share, become bounds of
each of its segments, and messages are cut anew. Clusters are worked on by their distinct values in context, with how often each occurs.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlore.functions import embeddings as E
from fieldlore.functions import nearby
from fieldlore.operators import cuts as C
from fieldlore.operators import knees as K
from fieldlore.operators import messages as M
from fieldlore.operators import pairwise as P
from fieldlore.operators import templates as T
from fieldlore.operators.lineage import once

#: Significant components at most, and as a share of the dimensions; least eigenvalue; least distinct values; least ratio of lengths; share of text.
PRINCIPALS, SHARE, LEAST_EIGEN, LEAST_VALUES, LENGTHS, TEXT = 4, 0.5, 10.0, 3, 0.5, 0.5
#: Fixed values of the two conditions on contributions: relevant, change; near zero, for so many places, noteworthy, greatest.
RELEVANT, CHANGE, ZERO, ZEROS, NOTEWORTHY, GREATEST = 0.1, 0.98, 0.05, 4, 0.005, 1.0
#: Share of a cluster's segments from which a bound is common; sensitivities of knees for clusters and subclusters; bytes of context on each side.
COMMON, SENSITIVITY, WITHIN, CONTEXT = 0.4, 10.0, 5.0, 8


def scree_knee(eigen: np.ndarray) -> float:
    """The eigenvalue at the knee of the falling curve; 0 without one."""
    falling = np.sort(eigen)[::-1]
    found = K.find_knees(np.arange(len(falling)), falling, falling=True) if len(falling) > 2 and np.ptp(falling) > 0 else None
    return float(falling[int(found.at[0])]) if found and found.at else 0.0


def threshold(eigen: np.ndarray) -> float:
    """What a component must exceed to be significant: the knee, the least eigenvalue, and a tenth of the greatest one; where none is small, the least eigenvalue alone."""
    return max(scree_knee(eigen), LEAST_EIGEN, eigen.max() / 10) if (eigen < LEAST_EIGEN).any() else LEAST_EIGEN


def enough(parts: list[bytes], deviation: np.ndarray) -> bool:
    """Whether a cluster can be analysed: three distinct values, some variance, and not text alone."""
    return len(set(parts)) >= LEAST_VALUES and bool((deviation > 0).any()) and not all(map(C.text_like, parts))


def fit(parts: list[bytes], counts: np.ndarray, eigen: np.ndarray, bound: float) -> bool:
    """Whether a cluster may be analysed as it is: few significant components, lengths not too different, not mostly text."""
    sizes = [len(p) for p in parts]
    text = sum(int(n) for p, n in zip(parts, counts, strict=True) if C.text_like(p))
    return (eigen > bound).sum() <= min(PRINCIPALS, len(eigen) * SHARE) and min(sizes) / max(sizes) >= LENGTHS and text <= TEXT * counts.sum()


def relocations(loadings: np.ndarray) -> list[int]:
    """Places (rows of the significant eigenvectors) at which a bound belongs.

    One is where a relevant contribution falls by more than 0.98 to an irrelevant one; the other where, after four places or more near zero, it rises as much to a
    noteworthy one.
    """
    if not loadings.size:
        return []
    peak = np.abs(loadings).max(1)
    before, at = peak[:-1], peak[1:]
    with np.errstate(all="ignore"):
        falls = (before > RELEVANT) & (at <= RELEVANT) & ((before - at) / before > CHANGE)
        rises = (at > NOTEWORTHY) & (at < GREATEST) & ((at - before) / at > CHANGE)
    quiet = before < ZERO
    run = np.arange(len(quiet)) - np.maximum.accumulate(np.where(quiet, -1, np.arange(len(quiet))))
    return (np.flatnonzero(falls | (rises & quiet & (run >= ZEROS))) + 1).tolist()


def shape_bounds(shapes: dict[tuple[int, int], int], places: list[int]) -> dict[tuple[int, int], list[int]]:
    """New bounds, in the frame of all, of segments that reach from start to end there, by how many of them have which shape.

    A segment takes all places; its own start or end stays where no place is within a byte. Starts and ends that over 0.4 of all have (after these have moved) are added where they
    lie within the segment's new bounds, aren't beside one, and are more frequent than their neighbours; also where they are one byte off a bound that didn't move.
    """
    new, starts, ends = {}, Counter(), Counter()
    for (s, e), n in shapes.items():
        own = sorted(places)
        b = [*([s] if not own or own[0] - s > 1 else []), *own, *([e] if not own or own[-1] < e - 1 else [])]
        new[s, e] = b
        starts[b[0] if b[0] > s else s] += n
        ends[b[-1] if b[-1] < e else e] += n
    total = sum(shapes.values())
    often = lambda c, v: c[v] > COMMON * total

    def ahead(c, v, taken):
        """Whether v is more frequent than either neighbour that isn't beside a bound."""
        return all(w not in c or w in taken or c[v] > c[w] for w in (v - 1, v + 1))

    out = {}
    for (s, e), b in new.items():
        fixed = [x for x in (s, e) if x not in places]
        beside = [x + 1 for x in fixed if often(starts, x + 1)] + [x - 1 for x in fixed if often(ends, x - 1)]
        taken = {x + k for x in [*b, *beside] for k in (-1, 0, 1)}
        more = [v for v in starts if often(starts, v) and v > min(b) and ((v not in taken and ahead(starts, v, taken)) or v in beside)]
        more += [v for v in ends if often(ends, v) and v < max(b) and ((v not in taken and ahead(ends, v, taken)) or v in beside)]
        out[s, e] = sorted({*b, *more})
    return out


def matrix(values: list[bytes]) -> np.ndarray:
    """Dissimilarities of values."""
    return E.matrix(values, values)[0]


def density_labels(d: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Density clusters of a matrix, noise -1."""
    return grown(d <= eps, least)


def grown(near: np.ndarray, least: int) -> np.ndarray:
    """Density clusters by which values are near each other, themselves included."""
    core = near.sum(1) >= least
    label = np.full(len(near), -1)
    for k in np.flatnonzero(core):
        if label[k] >= 0:
            continue
        new, front = label.max() + 1, [k]
        label[k] = new
        while front:
            for j in np.flatnonzero(near[front.pop()] & (label < 0)):
                label[j] = new
                if core[j]:
                    front.append(j)
    return label


def subclusters(values: list[bytes], sensitivity: float = WITHIN) -> list[list[int]] | None:
    """Density clusters of a cluster's distinct values, with a radius of their own; None where no knee is found."""
    n = len(values)
    if n < 4:
        return None
    least, curves = round(math.log(n)), {}
    index, near = nearby.Index(np.arange(n), values), min(least, n - 2) + 1
    # the whole matrix may be larger than a task
    own, other, d = (np.concatenate(x) for x in zip(*(index.nearest(leaf, near) for leaf in range(index.leaves)), strict=True))
    ranks = d[np.lexsort((d, own))].reshape(n, near)
    for k in range(1, least + 1):
        x = np.sort(ranks[:, min(k, n - 2)])
        grid = np.linspace(x[0], x[-1], max(4, min(K.GRID, n)))
        curves[k] = grid, K.smoothed(np.searchsorted(x, grid + 1e-12, side="right") / n)
    found = {k: K.find_knees(*c, sensitivity) for k, c in curves.items()}
    best = max(found, key=lambda k: found[k].sharpness, default=None)
    if best is None or not found[best].at or max(found[best].height) < 0.3:
        return None
    eps = K.clusters.adjusted_eps(max(found[best].at), found[best].sharpness)
    label = nearby.density(index, (own, other, d), eps, least)
    return [np.flatnonzero(label == k).tolist() for k in range(label.max() + 1)]


def analyse(parts: list[bytes], before: list[bytes], after: list[bytes], counts: np.ndarray, depth: int = 0) -> list[tuple[list[int], list[int], dict]]:
    """[(rows, shift of each, new bounds by shape)] of a cluster, or of its subclusters where it can't be analysed as it is."""
    shift, _ = T.shifts_of(parts)
    x = T.laid(parts, before, after, shift)
    weight = counts.astype(int)
    with np.errstate(all="ignore"):
        mean = np.nan_to_num(np.nansum(x * weight[:, None], 0) / np.maximum((~np.isnan(x) * weight[:, None]).sum(0), 1))
    x = np.where(np.isnan(x), mean, x)
    if not enough(parts, np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weight))):
        return []
    noisy = x.copy()
    flat = np.ptp(x, axis=0) == 0
    noisy[:, flat] = np.random.default_rng(11).random((len(x), int(flat.sum()))) * 0.5
    eigen, vectors = np.linalg.eigh(np.atleast_2d(np.cov(noisy.T, fweights=weight)))
    bound = threshold(eigen)
    whole = list(range(len(parts)))
    if not fit(parts, counts, eigen, bound):
        values = sorted(set(parts))
        groups = subclusters(values) if depth < 8 else None
        if groups is not None and groups and len(groups[0]) < len(values):
            out = []
            for g in groups:
                own = {values[i] for i in g}
                rows = [k for k in whole if parts[k] in own]
                found = analyse([parts[k] for k in rows], [before[k] for k in rows], [after[k] for k in rows], counts[rows], depth + 1)
                out += [([rows[k] for k in r], s, b) for r, s, b in found]
            return out
    shapes: Counter = Counter()
    for p, s, n in zip(parts, shift, weight.tolist(), strict=True):
        shapes[s, s + len(p)] += n
    return [(whole, shift, shape_bounds(dict(shapes), relocations(vectors[:, eigen > bound])))]


def relevant(segments: DataFrame) -> DataFrame:
    """Segments of two bytes or more that aren't all zero, with the bytes beside them (before, after) in their messages."""
    w = Window.partitionBy("msg_id").orderBy("offset")
    # what stands before and after: the neighbouring segments, and theirs, as far as the context reaches
    near = lambda k: F.coalesce(F.hex(F.lag("bytes", k).over(w)), F.lit("")) if k > 0 else F.coalesce(F.hex(F.lead("bytes", -k).over(w)), F.lit(""))
    x = segments.withColumn("before", F.unhex(F.right(F.concat(*(near(k) for k in range(CONTEXT, 0, -1))), F.lit(2 * CONTEXT))))
    x = x.withColumn("after", F.unhex(F.left(F.concat(*(near(-k) for k in range(1, CONTEXT + 1))), F.lit(2 * CONTEXT))))
    return M.relevant(x)


def clusters_of(segments: DataFrame, sensitivity: float = SENSITIVITY) -> DataFrame | None:
    """(bytes, label) of the distinct values of relevant segments, noise left out; None where no radius is found."""
    reps = once(P.representatives(M.relevant(segments)))
    try:
        labels, _ = K.cluster_values(reps, sensitivity, most=None)
    except K.NoKneeError:
        return None
    return once(labels.where("label <> -1").join(reps, F.col("id") == F.col("rep_id")).select("bytes", "label"))


def new_bounds(segments: DataFrame, labels: DataFrame) -> DataFrame:
    """(msg_id, offset, bound): bounds that each segment gets from its cluster (bytes, label), in the message's bytes."""
    x = once(relevant(segments).join(labels, "bytes").select("msg_id", "offset", "bytes", "label", "before", "after"))
    rows = x.groupBy("label", "bytes", "before", "after").agg(F.count("*").alias("n"))

    def kernel(key, g):
        g = g.sort_values(["bytes", "before", "after"])
        parts, before, after = (list(map(bytes, g[c])) for c in ("bytes", "before", "after"))
        out = []
        for rows, shift, bounds in analyse(parts, before, after, g.n.to_numpy()):
            for k, s in zip(rows, shift, strict=True):
                out.append((key[0], parts[k], before[k], after[k], [b - s for b in bounds[s, s + len(parts[k])]]))
        return pd.DataFrame(out, columns=["label", "bytes", "before", "after", "bounds"])

    made = rows.groupBy("label").applyInPandas(kernel, "label bigint, bytes binary, before binary, after binary, bounds array<int>")
    both = x.withColumn("label", F.col("label").cast("bigint")).join(made, ["label", "bytes", "before", "after"])
    return both.select("msg_id", "offset", F.explode("bounds").alias("b")).select("msg_id", "offset", (F.col("offset") + F.col("b")).alias("bound"))


def wanted_bounds(bounds: DataFrame, segments: DataFrame) -> DataFrame:
    """(msg_id, bound): new bounds inside their messages that aren't bounds already; of two beside each other from different segments the one outside its segment goes."""
    s = segments.select("msg_id", "offset", (F.col("offset") + F.col("length")).alias("end"))
    size = s.groupBy("msg_id").agg(F.max("end").alias("size"))
    old = s.select("msg_id", F.col("offset").alias("bound")).union(s.select("msg_id", "end")).distinct()
    x = bounds.join(size, "msg_id").where("bound > 0 AND bound < size").join(old, ["msg_id", "bound"], "left_anti")
    x = x.join(s.select("msg_id", "offset", "end"), ["msg_id", "offset"]).withColumn("inside", (F.col("bound") >= F.col("offset")) & (F.col("bound") < F.col("end")))
    one = once(x.groupBy("msg_id", "bound").agg(F.max("inside").alias("inside")))
    beside = one.where("inside").select("msg_id", F.explode(F.array(F.col("bound") - 1, F.col("bound") + 1)).alias("bound")).distinct()
    return one.where("inside").select("msg_id", "bound").union(one.where("NOT inside").join(beside, ["msg_id", "bound"], "left_anti").select("msg_id", "bound"))


def apply_bounds(segments: DataFrame, bounds: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages cut at their segments' bounds and at new ones (msg_id, bound); a bound one byte from a new one gives way to it, but not the message's ends."""
    new = bounds.distinct()
    starts = segments.select("msg_id", F.col("offset").alias("bound"))
    beside = new.select("msg_id", F.explode(F.array(F.col("bound") - 1, F.col("bound") + 1)).alias("bound")).where("bound > 0").distinct()
    kept = starts.join(beside, ["msg_id", "bound"], "left_anti").union(new).distinct()
    m = messages.select("msg_id", "data", F.octet_length("data").alias("size"))
    w = Window.partitionBy("msg_id").orderBy("bound")
    x = kept.join(m, "msg_id").where("bound < size").withColumn("end", F.coalesce(F.lead("bound").over(w), F.col("size")))
    length = (F.col("end") - F.col("bound")).cast("int")
    return x.select("msg_id", (F.row_number().over(w) - 1).alias("seg_no"), F.col("bound").cast("int").alias("offset"), length.alias("length"), F.substring("data", F.col("bound") + 1, length).alias("bytes"))


def refine(segments: DataFrame, messages: DataFrame, sensitivity: float = SENSITIVITY) -> DataFrame:
    """Segments refined once by the principal components of their clusters; as they are where no clusters are found."""
    s = once(segments)
    labels = clusters_of(s, sensitivity)
    if labels is None or labels.isEmpty():
        return s
    bounds = once(wanted_bounds(new_bounds(s, labels), s))
    return once(apply_bounds(s, bounds, messages))


def split_small_first(segments: DataFrame) -> DataFrame:
    """The first segment of a message in single bytes, if it is longer than two and two or more of its bytes are under 0x10."""
    from fieldlore.functions import series as S

    small = F.size(F.filter(S.values(F.col("bytes")), lambda b: b < 0x10)) >= 2
    hit = (F.col("seg_no") == 0) & (F.col("length") > 2) & small
    steps = F.when(hit, F.sequence(F.lit(0), F.col("length") - 1)).otherwise(F.array(F.lit(0)))
    x = segments.where("length > 0").select("msg_id", "offset", "bytes", "length", hit.alias("hit"), F.explode(steps).alias("k"))
    length = F.when(F.col("hit"), 1).otherwise(F.col("length"))
    x = x.select("msg_id", (F.col("offset") + F.col("k")).alias("offset"), length.alias("length"), F.substring("bytes", F.col("k") + 1, length).alias("bytes"))
    return x.select("msg_id", (F.row_number().over(Window.partitionBy("msg_id").orderBy("offset")) - 1).alias("seg_no"), "offset", "length", "bytes")
