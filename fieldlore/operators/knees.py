"""Parameters of density clustering found from the distances themselves.

Distributions are drawn from counts: the driver holds GRID numbers for each k, however many values there are. Sorted curves are whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlore.operators import alignment, clusters, pairwise
from fieldlore.operators.lineage import once

#: Points of a distribution's curve, allowed squared error of the smoothed distribution.
GRID, ERROR = 512, 0.03


class NoKneeError(ValueError):
    """The distances have no knee to take a radius from."""


@dataclass(frozen=True)
class Knees:
    """Where a curve bends: places of the knees, their heights, and the difference curve with its local maxima and minima."""

    at: list[float]
    height: list[float]
    difference: np.ndarray
    maxima: np.ndarray
    minima: np.ndarray

    @property
    def sharpness(self) -> float:
        """The last maximum of the difference curve."""
        return float(self.difference[self.maxima[-1]]) if len(self.maxima) else 0.0


def find_knees(x: np.ndarray, y: np.ndarray, sensitivity: float = 1.0, falling: bool = False) -> Knees:
    """Knees of a rising concave curve, or of a falling convex one, by the largest gains over the diagonal.

    A maximum of the difference between curve and diagonal, both from 0 to 1, is a knee if the difference drops below it by sensitivity mean steps
    before it turns up again.
    """
    span = lambda v: (v - v.min()) / (np.ptp(v) or 1.0)
    u, v = span(np.asarray(x, float)), span(np.asarray(y, float))
    gain = (1 - v if falling else v) - u
    left, right = np.append(True, gain[1:] >= gain[:-1]), np.append(gain[:-1] >= gain[1:], True)
    low_left, low_right = np.append(True, gain[1:] <= gain[:-1]), np.append(gain[:-1] <= gain[1:], True)
    inner = np.zeros(len(gain), bool)
    inner[1:-1] = True
    maxima, minima = np.flatnonzero(left & right & inner), np.flatnonzero(low_left & low_right & inner)
    step = sensitivity * np.abs(np.diff(u).mean()) if len(u) > 1 else 0.0
    at, height = [], []
    for k, top in enumerate(maxima):
        # until the next maximum, or the first minimum, after which only a fall to nothing counts
        until = maxima[k + 1] if k + 1 < len(maxima) else len(gain)
        turned = minima[(minima > top) & (minima < until)]
        bound = np.full(until - top - 1, gain[top] - step)
        if len(turned):
            bound[turned[0] - top - 1 :] = 0.0
        if (gain[top + 1 : until] < bound).any() and float(x[top]) not in at:
            at.append(float(x[top]))
            height.append(float(y[top]))
    return Knees(at, height, gain, maxima, minima)


@lru_cache(4)
def _waves(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of squared second differences of n points."""
    d = np.diff(np.eye(n), 2, axis=0)
    return np.linalg.eigh(d.T @ d)


def smoothed(y: np.ndarray, error: float = ERROR) -> np.ndarray:
    """The curve with the least second differences whose squared distance to y is about error."""
    n = len(y)
    if n < 4:
        return np.asarray(y, float)
    weight, basis = _waves(n)
    part = basis.T @ y
    low, high = -12.0, 18.0
    for _ in range(80):
        mid = (low + high) / 2
        kept = 1 / (1 + 10.0**mid * np.maximum(weight, 0))
        if (((1 - kept) * part) ** 2).sum() > error:
            high = mid
        else:
            low = mid
    return basis @ (part / (1 + 10.0**low * np.maximum(weight, 0)))


def nearest_ranks(d: DataFrame, k: int) -> DataFrame:
    """(i, rank, d): the k nearest others of each value, rank 0 being the nearest; a checkpoint."""
    return once(pairwise.neighbours(d, k).select("i", (F.col("rank") - 1).alias("rank"), "d"))


def nearest_ranks_of(reps: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """nearest_ranks of values (rep_id, bytes), whose pairs are compared but not kept."""
    return once(pairwise.nearest(reps, k, digits=digits).select("i", (F.col("rank") - 1).alias("rank"), "d"))


def distributions(near: DataFrame, grid: int = GRID) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(x, y) by k: the share of values whose k-th nearest distance is at most x, at evenly spaced x; all k in one query."""
    ends = near.groupBy("rank").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("n"))
    points = F.least(F.lit(grid), F.greatest(F.lit(4), F.col("n"))).cast("int")
    width = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("hi") - F.col("lo")) / (F.col("points") - 1))
    place = F.least(F.greatest(F.ceil((F.col("d") - F.col("lo")) / F.col("width") - 1e-12), F.lit(0)), F.col("points") - 1).cast("int")
    x = near.join(F.broadcast(ends.withColumn("points", points).withColumn("width", width)), "rank")
    out: dict[int, tuple] = {}
    for r in x.groupBy("rank", "lo", "width", "points", "n", place.alias("p")).count().collect():
        at, count = out.setdefault(r.rank, (r.lo + r.width * np.arange(r.points), np.zeros(r.points)))
        count[r.p] = r["count"]
    return {k: (at, np.cumsum(count) / count.sum()) for k, (at, count) in out.items()}


def distribution(near: DataFrame, k: int, below: float | None = None, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): the share of values whose k-th nearest distance is at most x, at evenly spaced x; only x below a bound, if one is given."""
    return _of_rank(distributions(near.where(F.col("rank") == k), grid), k, below)


def _of_rank(curves: dict, k: int, below: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    if k not in curves:
        raise NoKneeError("no distances")
    at, share = curves[k]
    return (at[at < below], share[at < below]) if below is not None else (at, share)


@dataclass(frozen=True)
class Parameters:
    eps: float
    min_samples: int
    k: int
    sharpness: float
    knee: float


def sharpest(near: DataFrame, most: int, sensitivity: float) -> int:
    """The k from 2 to most whose distribution has the sharpest knee; most where none has any."""
    return _sharpest(distributions(near), most, sensitivity)


def _sharpest(curves: dict, most: int, sensitivity: float) -> int:
    best, found = 0.0, most
    for k in range(2, most + 1):
        x, y = _of_rank(curves, k)
        now = find_knees(x, smoothed(y), sensitivity).sharpness
        if now > best:
            best, found = now, k
    return found


def by_distribution(near: DataFrame, n: int, sensitivity: float = 0.8, below: float | None = None) -> Parameters:
    """Radius, least neighbours and k from the knee of the smoothed distribution of k-th nearest distances of n values.

    The rightmost knee is the radius. Knees all under a tenth of the height are the fringe's: the curve is searched again from the middle between its last two
    turns. Raises NoKneeError for under 4 values, without a knee, or where the highest one lies below 0.3; ValueError where near holds fewer than ranks(n) others.
    """
    if n < 4:
        raise NoKneeError(f"too few values ({n})")
    least = round(math.log(n))
    curves = distributions(near)
    if least not in curves:
        raise ValueError(f"no distances of rank {least}: ranks({n}) nearest others of each value are needed")
    k = _sharpest(curves, least, sensitivity)
    x, y = _of_rank(curves, k, below)
    if len(x) < 4:
        raise NoKneeError("too few points of the curve")
    y = smoothed(y, ERROR * len(x) / GRID if below is not None else ERROR)
    found = find_knees(x, y, sensitivity)
    if found.height and max(found.height) < 0.1:
        if len(found.minima) < 2 or not len(found.maxima):
            raise NoKneeError("only a fringe")
        start = max(0, int(found.maxima[-1] - found.minima[-2]))
        found = find_knees(x[start:], y[start:], sensitivity)
    if not found.at or max(found.height) < 0.3:
        raise NoKneeError("no knee")
    return Parameters(max(found.at), least, k, found.sharpness, max(found.at))


def adjusted(p: Parameters) -> Parameters:
    """The radius corrected by the knee's sharpness."""
    return Parameters(clusters.adjusted_eps(p.eps, p.sharpness), p.min_samples, p.k, p.sharpness, p.knee)


def adjusted_eps(eps: Column, y: Column) -> Column:
    """A density radius corrected by the last maximum y of the difference curve."""
    return eps * (16 * y * y - 10 * y + 1.8)


def largest_share(labels: DataFrame) -> float:
    """Members of the largest cluster, noise counting as one, over all members that aren't noise."""
    r = labels.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n").alias("top"), F.sum(F.when(F.col("label") != -1, F.col("n"))).alias("real")).first()
    return r.top / r.real if r.top and r.real else 0.0


def cluster(d: DataFrame, ids: DataFrame, sensitivity: float = 0.8, adjust: bool = True, most: float | None = 0.6) -> tuple[DataFrame, Parameters]:
    """(labels, parameters): density clusters with a radius found from d. If one holds more than most of what isn't noise, the curve is cut at its knee and searched again."""
    n = ids.count()
    return _clustered(nearest_ranks(d, ranks(n)), n, lambda eps, least: pairwise.dbscan(d, ids, eps, least), sensitivity, adjust, most)


def cluster_values(reps: DataFrame, sensitivity: float = 0.8, adjust: bool = True, most: float | None = 0.6, digits: int | None = None) -> tuple[DataFrame, Parameters]:
    """cluster of the distances of values (rep_id, bytes), of which only those within the radius are kept."""
    n = reps.count()
    ids, index = reps.selectExpr("rep_id AS id"), pairwise.sent(reps)
    if index is None:
        labelled = lambda eps, least: pairwise.dbscan(pairwise.distances(reps, digits=digits, within=eps), ids, eps, least)
        return _clustered(nearest_ranks_of(reps, ranks(n), digits), n, labelled, sensitivity, adjust, most)
    found = once(pairwise.nearest(reps, ranks(n), digits=digits, index=index))
    labelled = lambda eps, least: pairwise.dense(found, index, ids, eps, least, digits)
    return _clustered(found.select("i", (F.col("rank") - 1).alias("rank"), "d"), n, labelled, sensitivity, adjust, most)


def ranks(n: int) -> int:
    """How many neighbours of each of n values parameters are looked for among."""
    return round(math.log(max(n, 2))) + 1


def _clustered(near: DataFrame, n: int, labelled: Callable[[float, int], DataFrame], sensitivity: float, adjust: bool, most: float | None) -> tuple[DataFrame, Parameters]:
    tune = adjusted if adjust else lambda p: p
    p = tune(by_distribution(near, n, sensitivity))
    labels = once(labelled(p.eps, p.min_samples))
    if most is not None and largest_share(labels) > most:
        try:
            p = tune(by_distribution(near, n, sensitivity, below=p.knee))
        except NoKneeError:
            return labels, p
        labels = once(labelled(p.eps, p.min_samples))
    return labels, p


def sorted_curves(near: DataFrame) -> np.ndarray:
    """For each rank all its distances in order (ranks by places). Tasks count equal ones; the driver holds a number for each rank and value."""
    t = near.groupBy("rank", "d").agg(F.count("*").alias("n")).toArrow()
    rank, d, n = (t[c].to_numpy() for c in ("rank", "d", "n"))
    order = np.lexsort((d, rank))
    rank, d = (np.repeat(x[order], n[order]) for x in (rank, d))
    # every value that has another one has all ranks
    return np.array(np.split(d, np.flatnonzero(np.diff(rank)) + 1))


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian filter with mirrored ends."""
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 / (sigma * sigma) * np.arange(-r, r + 1) ** 2)
    m = np.arange(-r, len(x) + r) % (2 * len(x))
    return np.convolve(x[np.where(m < len(x), m, 2 * len(x) - 1 - m)], w / w.sum(), "valid")


def by_curvature(curves: np.ndarray, n: int) -> tuple[float, int, int]:
    """(radius, least neighbours, k): the greatest relative curvature of the smoothed curves of sorted k-th nearest distances, away from both ends.

    Where all distances are 0 the radius is 0.001.
    """
    sigma = math.log(n)
    best = (0, 0, 0.0)
    smooth = [gaussian(c, max(sigma, 1e-6)) for c in curves[: math.ceil(math.log(n**2))]]
    for k, s in enumerate(smooth):
        bend = np.diff(s, 2)
        top = int(bend.argmax())
        if s[top] > 0 and 2 * sigma < top < len(s) - 2 * sigma and bend[top] / s[top] > best[2]:
            best = (k, top, float(bend[top] / s[top]))
    k, top, _ = best
    eps = float(smooth[k][top + 1])
    return (eps if eps > 0 else 0.001), round(sigma), k


def curvature_of(d: DataFrame, n: int) -> tuple[float, int, int]:
    """by_curvature of the distances of n values."""
    return by_curvature(sorted_curves(nearest_ranks(d, curves(n))), n)


def curves(n: int) -> int:
    """How many ranks of n values curvature is looked for in."""
    return math.ceil(math.log(n**2))


def message_curvature(segments: DataFrame, n: int) -> tuple[float, int, int]:
    """by_curvature of the alignment distances of n messages (msg_id, seg_no, bytes)."""
    near = once(alignment.nearest_messages(segments, curves(n)).select("i", (F.col("rank") - 1).alias("rank"), "d"))
    return by_curvature(sorted_curves(near), n)


def rule_of_thumb(curve: np.ndarray) -> int:
    """The place of the greatest curvature of a smoothed curve of sorted distances."""
    sigma = math.log(max(2, int((curve > 0.001 * curve.max()).sum())))
    return int(np.diff(gaussian(curve, sigma), 2).argmax())


def mean_growth(near: DataFrame) -> DataFrame:
    """(rank, mean, growth): mean k-th nearest distance, and by how much it exceeds the one before."""
    m = {r.rank: r["mean"] for r in near.groupBy("rank").agg(F.avg("d").alias("mean")).collect()}
    rows = [(k, float(m[k]), float(m[k] - m[k - 1]) if k - 1 in m else None) for k in sorted(m)]
    return near.sparkSession.createDataFrame(rows, "rank int, mean double, growth double")


def steepest(near: DataFrame) -> int:
    """The rank at which the mean distance grows most: a least size of clusters."""
    r = mean_growth(near).where("growth IS NOT NULL").agg(F.min(F.struct((-F.col("growth")).alias("g"), "rank")).alias("m")).first()
    return r.m.rank if r.m else 0
