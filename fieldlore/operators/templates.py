"""Templates of field types: values of a cluster laid over one another, and what in messages looks like them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlore.functions import series as S
from fieldlore.functions.embeddings import TERMS
from fieldlore.operators import cuts as C

#: What a window without any information, all zeros, is said to be away from a template.
NOTHING = 99.0


def same_feature(labels: DataFrame, features: DataFrame) -> DataFrame:
    """(label, same): whether all members of a cluster have one feature (id, feature)."""
    return labels.join(features, "id").groupBy("label").agg((F.count_distinct("feature") == 1).alias("same"))


def mean_templates(labels: DataFrame, values: DataFrame) -> DataFrame:
    """(label, pos, mean): the mean byte at each place of a cluster's values, laid left-aligned; noise is left out."""
    x = labels.where("label <> -1").join(values.select("id", "bytes"), "id")
    return x.select("label", F.posexplode(S.values(F.col("bytes"))).alias("pos", "v")).groupBy("label", "pos").agg(F.avg("v").alias("mean"))


def distances_at(short: np.ndarray, long: np.ndarray, most: int = 6) -> np.ndarray:
    """Canberra distance of a value at each shift along a longer one."""
    w = np.lib.stride_tricks.sliding_window_view(long.astype(float), len(short))[: most + 1]
    total = short + w
    return (np.abs(short - w) / np.where(total == 0, 1, total)).sum(1)


def _sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Canberra distances (shift, row of x, row of y) at each shift of the shorter rows x along y."""
    k = x.shape[1]
    return np.stack([TERMS[x[:, None, :], y[None, :, s : s + k]].sum(2) for s in range(min(6, y.shape[1] - k) + 1)])


def _better_without_first(x: np.ndarray, at: int | None, long: np.ndarray) -> bool:
    """Whether a value fits all of the longest ones better by more than 1 without its first byte, unshifted; its own place among these is left out."""
    step = 64
    for k in range(0, len(long), step):
        y = long[k : k + step]
        if at is not None and k <= at < k + step:
            y = np.delete(y, at - k, 0)
        if not len(y):
            continue
        cut = _sums(x[None, 1:], y)[:, 0]
        if (cut.argmin(0) != 0).any() or (cut.min(0) >= _sums(x[None], y)[:, 0].min(0) - 1).any():
            return False
    return True


def shifts_of(parts: list[bytes]) -> tuple[list[int], int]:
    """How far each value is laid to the right over the longest ones, and their length.

    Each of the longest ones says at which shift a shorter value fits it best; the most frequent answer counts, the first among equals. A value of three bytes or more that fits
    all of them better by more than 1 without its first byte, unshifted, is laid one byte to the left. Copies are answered once.
    """
    size = max(map(len, parts), default=0)
    counted: dict[bytes, int] = {}
    for p in parts:
        if len(p) == size:
            counted[p] = counted.get(p, 0) + 1
    weight = np.array(list(counted.values()))
    long = np.frombuffer(b"".join(counted), np.uint8).reshape(len(counted), size)
    place = {p: k for k, p in enumerate(counted)}
    answer: dict[bytes, int] = {}
    for p in parts:
        if p in answer:
            continue
        x, own = np.frombuffer(p, np.uint8), place.get(p)
        answer[p] = 0
        if own is None:
            step = max(1, (1 << 20) // max(len(p), 1))
            best = np.concatenate([_sums(x[None], long[k : k + step])[:, 0].argmin(0) for k in range(0, len(long), step)])
            n = np.bincount(best, weight)
            # of equally frequent shifts the one that the first of the longest values names
            answer[p] = int(best[(n[best] == n.max()).argmax()])
        # a copy among the longest is at no distance, which nothing betters
        alone = own is None or (weight[own] == 1 and len(long) > 1)
        if len(p) > 2 and alone and _better_without_first(x, own, long):
            answer[p] = -1
    return [answer[p] for p in parts], size


def laid(parts: list[bytes], before: list[bytes] | None = None, after: list[bytes] | None = None, shift: list[int] | None = None) -> np.ndarray:
    """Values in rows of one length, NaN where one has none, or its message's neighbouring bytes where these are given. What shifts_of gives may be given."""
    size = max(map(len, parts), default=0)
    shift = shifts_of(parts)[0] if shift is None else shift
    out = np.full((len(parts), size), np.nan)
    for k, (p, s) in enumerate(zip(parts, shift, strict=True)):
        x = np.frombuffer(p, np.uint8)[max(0, -s) :][: size - max(0, s)]
        a = max(0, s)
        out[k, a : a + len(x)] = x
        if before is not None and a:
            near = np.frombuffer(before[k], np.uint8)[-a:]
            out[k, a - len(near) : a] = near
        if after is not None and (rest := size - a - len(x)) > 0:
            near = np.frombuffer(after[k], np.uint8)[:rest]
            out[k, a + len(x) : a + len(x) + len(near)] = near
    return out


def moments(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, deviation and covariance of rows with gaps. Columns without deviation get noise up to a half for the covariance, drawn by a seed: they would make it singular."""
    with np.errstate(all="ignore"):
        mean, deviation = np.nanmean(x, 0), np.nanstd(x, 0)
    noisy = x.copy()
    noisy[:, deviation == 0] = np.random.default_rng(seed).random((len(x), int((deviation == 0).sum()))) * 0.5
    return mean, deviation, pd.DataFrame(noisy).cov().to_numpy()


def field_types(members: DataFrame, context: bool = False, seed: int = 11) -> DataFrame:
    """(label, members, mean, deviation, covariance, type_id) of clusters (label, id, bytes, and with context before and after): each one's values laid over one another.

    The covariance comes row by row; type_id is a hash of the means. A template needs its distinct values together in a task; copies should be counted
    out before. Noise (label -1) is left out; a cluster of one value has no covariance (NaN).
    """
    columns = ["label", "id", "bytes", *(["before", "after"] if context else [])]

    def build(key, g):
        g = g.sort_values("id")
        x = laid(g.bytes.tolist(), g.before.tolist(), g.after.tolist()) if context else laid(g.bytes.tolist())
        mean, deviation, cov = moments(x, seed)
        return pd.DataFrame({"label": [key[0]], "members": [len(g)], "mean": [mean.tolist()], "deviation": [deviation.tolist()], "covariance": [cov.ravel().tolist()]})

    kind = members.schema["label"].dataType.simpleString()
    made = members.where("label <> -1").where(F.octet_length("bytes") > 0).select(*columns).groupBy("label").applyInPandas(build, f"label {kind}, members int, mean array<double>, deviation array<double>, covariance array<double>")
    return made.withColumn("type_id", F.lower(F.hex(F.xxhash64(F.transform("mean", lambda v: F.round(v, 6))))))


def confidence(mean: np.ndarray, inverse: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Mahalanobis distance of each window from the mean."""
    x = windows - mean
    return np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, inverse, x), 0))


def inverse(covariance: list[float], n: int) -> np.ndarray:
    """Pseudo-inverse of a covariance given row by row; of one that isn't defined, that of none."""
    m = np.array(covariance, float).reshape(n, n)
    return np.linalg.pinv(m) if np.isfinite(m).all() else np.zeros((n, n))


def recognise(messages: DataFrame, templates: DataFrame, doubled: tuple[str, ...] = ("id",)) -> DataFrame:
    """(msg_id, label, pos, confidence): how far each window of a message (msg_id, data) is from each template of its length; 99 for windows of zeros.

    Templates (label, mean, covariance) are few, and their number and sizes say how many numbers every task gets; a confidence counts double for labels in doubled.
    """
    rows = [(r.label, np.array(r["mean"]), inverse(r.covariance, len(r["mean"]))) for r in templates.select("label", "mean", "covariance").collect()]
    sent = messages.sparkSession.sparkContext.broadcast(rows)

    def run(parts):
        for b in parts:
            out: list[list] = [[], [], [], []]
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(data or b"", np.uint8).astype(float)
                for label, mean, inv in sent.value:
                    if len(v) < len(mean):
                        continue
                    w = np.lib.stride_tricks.sliding_window_view(v, len(mean))
                    c = confidence(mean, inv, w) * (2 if label in doubled else 1)
                    c[(w == 0).all(1)] = NOTHING
                    for column, value in zip(out, ([i] * len(c), [str(label)] * len(c), range(len(c)), c.tolist()), strict=True):
                        column.extend(value)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["msg_id", "label", "pos", "confidence"])

    return messages.select(F.col("msg_id").cast("bigint"), "data").mapInArrow(run, "msg_id bigint, label string, pos int, confidence double")


def recognised(found: DataFrame, templates: DataFrame, threshold: float | None = None) -> DataFrame:
    """Recognised fields (msg_id, label, pos, length, confidence): confidences under a threshold, which is 20 over the logarithm of a template's mean deviation unless given."""
    mean = F.aggregate("deviation", F.lit(0.0), lambda a, x: a + x) / F.size("deviation")
    t = templates.select(F.col("label").cast("string").alias("label"), F.size("mean").alias("length"), (F.lit(20.0) / F.log(mean) if threshold is None else F.lit(float(threshold))).alias("bound"))
    return found.join(t, "label").where("confidence < bound").select("msg_id", "label", "pos", "length", "confidence")


def recognised_text(messages: DataFrame) -> DataFrame:
    """(msg_id, pos, length) of recognised text."""

    def run(parts):
        for b in parts:
            rows = [(i, a, z - a) for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for a, z in C.text_fields(data or b"")]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["msg_id", "pos", "length"])

    return messages.select(F.col("msg_id").cast("bigint"), "data").mapInArrow(run, "msg_id bigint, pos int, length int")


def overlapping(fields: DataFrame) -> DataFrame:
    """(msg_id, a, b, shared): recognised fields (msg_id, pos, length) of one message that meet, by their places, and by how many bytes."""
    x = fields.select("msg_id", F.col("pos").alias("a"), F.col("length").alias("la")).join(fields.select("msg_id", F.col("pos").alias("b"), F.col("length").alias("lb")), "msg_id")
    x = x.where("(a < b OR (a = b AND la < lb)) AND b < a + la")
    return x.select("msg_id", "a", "b", (F.least(F.col("a") + F.col("la"), F.col("b") + F.col("lb")) - F.col("b")).alias("shared"))


def to_segments(fields: DataFrame, messages: DataFrame) -> DataFrame:
    """Recognised fields as segments (msg_id, offset, length, bytes)."""
    return fields.join(messages.select("msg_id", "data"), "msg_id").select("msg_id", F.col("pos").alias("offset"), "length", F.substring("data", F.col("pos") + 1, F.col("length")).alias("bytes"))


def by_type(segments: DataFrame) -> DataFrame:
    """(type, n, values): segments of each type and how many distinct values they have."""
    return segments.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("bytes").alias("values"))

