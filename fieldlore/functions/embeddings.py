"""Dissimilarities of many values at once, as ``series.embedding`` gives them one by one: whole blocks of values against one another.

The terms are added in the order of the expression, so that results are the same to the last bit. Blocks say how much memory a call takes.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np

_BYTES = np.arange(256.0)
_SUMS = _BYTES[:, None] + _BYTES
#: Canberra terms of two bytes.
TERMS = np.abs(_BYTES[:, None] - _BYTES) / np.where(_SUMS == 0, 1, _SUMS)
#: Pairs that are compared at once at most.
CELLS = 1 << 20


def by_length(values: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(places, bytes)] of values of each length, the bytes in a row for each."""
    at: dict[int, list[int]] = {}
    for k, v in enumerate(values):
        at.setdefault(len(v), []).append(k)
    return [(np.array(k), np.frombuffer(b"".join(values[i] for i in k), np.uint8).reshape(len(k), n)) for n, k in sorted(at.items())]


def embedded(short: np.ndarray, long: np.ndarray, relief: float = 0.33, most: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(d, shift) of rows of bytes of one length against those of another that isn't less."""
    i, o = short.shape[1], long.shape[1]
    e, shift = None, np.zeros((len(short), len(long)), np.int32)
    for s in range(min(most, o - i) + 1):
        now = np.zeros(shift.shape)
        for k in range(i):
            # rows of terms are taken for the side that has fewer values
            now += TERMS[short[:, k]].take(long[:, s + k], axis=1) if len(short) <= len(long) else TERMS[long[:, s + k]].take(short[:, k], axis=1).T
        now /= i
        if e is None:
            e = now
        else:
            less = now < e
            shift[less] = s
            np.minimum(e, now, out=e)
    if i == o:
        return e, shift
    r, p = (o - i) / o, i / (o * o)
    return (1 - r) * e + r + r * p * (1 - e) - relief * r * (1 - e), shift


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """x to so many digits as Spark's round has it: halves of the shortest decimal go up."""
    scaled = x * 10.0**digits
    whole = np.floor(scaled + 0.5)
    odd = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5
    if odd.any():
        some, place = np.unique(x[odd], return_inverse=True)
        step = Decimal(1).scaleb(-digits)
        exact = [float(Decimal(repr(v)).quantize(step, ROUND_HALF_UP).scaleb(digits)) for v in some.tolist()]
        whole[odd] = np.array(exact)[place]
    return whole / 10.0**digits


def chunks(n: int, m: int) -> list[slice]:
    """Parts of n rows that have CELLS cells of m columns at most, or one row."""
    step = max(1, CELLS // max(m, 1))
    return [slice(k, k + step) for k in range(0, n, step)]


def matrix(a: list[bytes], b: list[bytes], relief: float = 0.33, shifts: bool = False, digits: int | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """(d, shift) of each value of a against each of b, in a row for each of a."""
    d, shift = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)), np.int32) if shifts else None
    right = by_length(b)
    for at, x in by_length(a):
        for there, y in right:
            for part in chunks(len(at), len(there)):
                own = x[part]
                one, s = embedded(own, y, relief) if x.shape[1] <= y.shape[1] else (v.T for v in embedded(y, own, relief))
                place = np.ix_(at[part], there)
                d[place] = one if digits is None else half_up(one, digits)
                if shifts:
                    shift[place] = s
    return d, shift


def nearest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k least finite cells of each row, the first ones on ties."""
    if not d.size:
        return np.zeros(0, int), np.zeros(0, int)
    last = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1][:, None]
    less, equal = d < last, d == last
    found = less | (equal & (equal.cumsum(1) <= k - less.sum(1, keepdims=True)))
    return np.nonzero(found & np.isfinite(d))
