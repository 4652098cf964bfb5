"""Per-message series as column expressions: nothing here leaves the JVM.

A series is an array column. Bytes are read as integers 0 to 255; an empty message has an empty series. Places that a
series doesn't define are left out rather than padded, so that a series of n bytes shortens by its start skip.
"""

from __future__ import annotations

import math
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(f):
    """Evaluates f's first argument once a row: inside a lambda it would be evaluated again for each element."""

    @wraps(f)
    def held(x: Column, *args, **kwargs) -> Column:
        return F.element_at(F.transform(F.array(x), lambda y: f(y, *args, **kwargs)), 1)

    return held


def _span(n: Column) -> Column:
    """1 to n, empty for n < 1, null for null."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).when(n < 1, F.array().cast("array<int>"))


def values(data: Column) -> Column:
    """The bytes of a binary column."""
    return F.transform(_span(F.octet_length(data)), lambda i: F.conv(F.hex(F.substring(data, i, 1)), 16, 10).cast("int"))


def nibbles(v: Column) -> Column:
    """High, then low half of each byte."""
    return F.flatten(F.transform(v, lambda x: F.array(F.shiftright(x, 4), x.bitwiseAND(F.lit(15)))))


@bound
def pairs(x: Column, f) -> Column:
    """f(x[i], x[i + 1]) for all neighbours."""
    return F.transform(_span(F.size(x) - 1), lambda i: f(F.element_at(x, i), F.element_at(x, i + 1)))


def bit_congruence(v: Column) -> Column:
    """Share of equal bits between neighbouring bytes."""
    return pairs(v, lambda a, b: 1 - F.bit_count(a.bitwiseXOR(b)) / 8.0)


def delta(x: Column) -> Column:
    """Difference of neighbours."""
    return pairs(x, lambda a, b: b - a)


def cumulated(v: Column) -> Column:
    """Running sums, the first being 0."""
    step = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    return F.aggregate(v, F.array(F.lit(0).cast("bigint")), lambda a, x: step(a, x.cast("bigint")))


@bound
def gradient(x: Column) -> Column:
    """Central differences, one-sided at both ends."""
    n = F.size(x)
    at = lambda i: F.element_at(x, i)
    inner = lambda i: (at(F.least(i + 1, n)) - at(F.greatest(i - 1, F.lit(1)))) / F.when((i == 1) | (i == n), 1.0).otherwise(2.0)
    return F.when(n > 1, F.transform(_span(n), inner)).otherwise(F.array().cast("array<double>"))


@bound
def windows(x: Column, n: int) -> Column:
    """All runs of n neighbours."""
    return F.transform(_span(F.size(x) - n + 1), lambda i: F.slice(x, i, n))


def window_mean(x: Column, n: int) -> Column:
    return F.transform(windows(x, n), lambda w: F.aggregate(w, F.lit(0.0), lambda a, y: a + y) / n)


def window_stddev(x: Column, n: int) -> Column:
    """Population deviation of each run of n."""
    mean = lambda w: F.aggregate(w, F.lit(0.0), lambda a, y: a + y) / n
    return F.transform(windows(x, n), lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, y: a + (y - mean(w)) * (y - mean(w))) / n))


@bound
def gaussian(x: Column, sigma: float) -> Column:
    """Gaussian filter with mirrored ends (d c b a | a b c d | d c b a) and a radius of four sigma."""
    r = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    kernel = [w / sum(raw) for w in raw]
    n = F.size(x)

    def at(i, k):
        m = F.pmod(i + F.lit(k - 1), 2 * n)
        return F.element_at(x, F.when(m < n, m + 1).otherwise(2 * n - m))

    def one(i):
        out = F.lit(0.0)
        for k, w in zip(range(-r, r + 1), kernel, strict=True):
            out = out + at(i, k) * F.lit(w)
        return out

    return F.when(n > 0, F.transform(_span(n), one)).otherwise(F.array().cast("array<double>"))


@bound
def extrema(x: Column, maxima: bool = True) -> Column:
    """Zero-based places of strict local maxima (or minima); an end counts if beyond its only neighbour."""
    n = F.size(x)
    beyond = (lambda a, b: a > b) if maxima else (lambda a, b: a < b)
    at = lambda i: F.element_at(x, i)
    left = lambda i: (i == 1) | beyond(at(i), at(F.greatest(i - 1, F.lit(1))))
    right = lambda i: (i == n) | beyond(at(i), at(F.least(i + 1, n)))
    return F.when(n > 1, F.transform(F.filter(_span(n), lambda i: left(i) & right(i)), lambda i: i - 1)).otherwise(F.array().cast("array<int>"))


@bound
def zero_borders(v: Column) -> Column:
    """Zero-based places at which a run of zeros begins or ends."""
    at = lambda i: F.element_at(v, i)
    return F.transform(F.filter(_span(F.size(v)), lambda i: (i > 1) & ((at(i) == 0) != (at(F.greatest(i - 1, F.lit(1))) == 0))), lambda i: i - 1)


@bound
def plateaus(v: Column) -> Column:
    """Zero-based places whose value differs from the one before and equals the one after."""
    n = F.size(v)
    at = lambda i: F.element_at(v, i)
    return F.transform(F.filter(_span(n - 1), lambda i: (i > 1) & (at(F.greatest(i - 1, F.lit(1))) != at(i)) & (at(i) == at(i + 1))), lambda i: i - 1)


@bound
def entropy(v: Column, base: float = 2.0) -> Column:
    """Shannon entropy of the values of an array."""
    n = F.size(v)
    share = lambda x: F.size(F.filter(v, lambda y: y == x)) / n
    return F.aggregate(F.array_distinct(v), F.lit(0.0), lambda a, x: a - share(x) * F.log(share(x)) / math.log(base))


def absolute_difference(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two series of one length; null otherwise."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x))


def printable(v: Column) -> Column:
    return F.forall(v, lambda x: x.between(0x20, 0x7E))


@bound
def text_like(v: Column, low: float = 50, high: float = 115, least: int = 6) -> Column:
    """Long enough, not all zero, below 0x7f, the mean of non-zero bytes in a corridor, and under a third unprintable."""
    some = F.filter(v, lambda x: x != 0)
    mean = F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.size(some)
    odd = F.size(F.filter(some, lambda x: ~x.between(0x20, 0x7E))) / F.size(v)
    return F.when(F.size(v) < least, False).when(F.size(some) == 0, False).otherwise((F.array_max(v) < 0x7F) & mean.between(low, high) & (odd < 0.33))


def canberra(a: Column, b: Column) -> Column:
    """Canberra distance; where both values are zero nothing is added."""
    term = lambda x, y: F.when((x == 0) & (y == 0), 0.0).otherwise(F.abs(x - y) / (F.abs(x) + F.abs(y)).cast("double"))
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)


def shifts(a: Column, b: Column, most: int = 6) -> Column:
    """Distance of the shorter series, per element, at each shift along the longer one (up to most)."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    n = F.size(short)
    return F.transform(F.sequence(F.lit(0), F.least(F.lit(most), F.size(long) - n)), lambda o: canberra(short, F.slice(long, o + 1, n)) / n)


def dissimilarity(a: Column, b: Column, relief: float = 0.33) -> Column:
    """Dissimilarity of two series of any lengths: the best embedding of the shorter one, and a penalty for what it leaves over."""
    i, o = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    e, r, p = F.array_min(shifts(a, b)), (o - i) / o, i / (o * o)
    return (1 - r) * e + r + r * p * (1 - e) - relief * r * (1 - e)


def best_shift(a: Column, b: Column) -> Column:
    """(e, shift): the least distance per element of the shorter series at any shift along the longer one, and the first shift that has it."""
    one = lambda at: F.struct(F.array_min(at).alias("e"), (F.array_position(at, F.array_min(at)) - 1).cast("int").alias("shift"))
    return F.element_at(F.transform(F.array(shifts(a, b)), one), 1)


def equal_distance(a: Column, b: Column, method: str = "canberra") -> Column:
    """Distance of two series of one length. Cosine: 0 for equal series, 1 where one has no extent; correlation: 0 for equal series, 9.9 where one doesn't vary."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p.cast("double") * q))
    squares = total(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y)))
    if method == "canberra":
        return canberra(a, b)
    if method in ("euclidean", "sqeuclidean"):
        return F.sqrt(squares) if method == "euclidean" else squares
    if method == "cosine":
        aa, bb = dot(a, a), dot(b, b)
        return F.when(squares == 0, 0.0).when((aa == 0) | (bb == 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - dot(a, b) / F.sqrt(aa * bb)))
    n, sa, sb = F.size(a), total(a), total(b)
    va, vb = n * dot(a, a) - sa * sa, n * dot(b, b) - sb * sb
    return F.when(squares == 0, 0.0).when((va <= 0) | (vb <= 0), 9.9).otherwise(1 - (n * dot(a, b) - sa * sb) / F.sqrt(va * vb))


def embedding(a: Column, b: Column, relief: float = 0.33) -> Column:
    """(d, shift): dissimilarity of two series, and where the shorter one lies best in the longer (the first such place)."""
    i, o = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    r, p = (o - i) / o, i / (o * o)

    def one(at):
        e = F.array_min(at)
        return F.struct(((1 - r) * e + r + r * p * (1 - e) - relief * r * (1 - e)).alias("d"), (F.array_position(at, e) - 1).cast("int").alias("shift"))

    return F.element_at(F.transform(F.array(shifts(a, b)), one), 1)


@bound
def lagged(x: Column, k: int) -> Column:
    """Difference of values k places apart."""
    return F.transform(_span(F.size(x) - k), lambda i: F.element_at(x, i + k) - F.element_at(x, i))


def gram_congruence(v: Column, n: int) -> Column:
    """Share of equal bits between each run of n bytes and the run that starts one byte later."""
    apart = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, c: s + c)
    return pairs(windows(v, n), lambda a, b: 1 - apart(a, b) / (8.0 * n))


def inner_gradient(x: Column) -> Column:
    """Gradient without its first place, which an undefined start leaves undefined."""
    return F.slice(gradient(x), 2, F.greatest(F.size(x) - 1, F.lit(0)))


@bound
def horizon(bc: Column, skip: int = 2) -> Column:
    """Each value after the first skip ones less the mean of the two before it."""
    at = lambda i: F.element_at(bc, i)
    skip = max(skip, 2)
    return F.transform(_span(F.size(bc) - skip), lambda i: at(i + skip) - (at(i + skip - 1) + at(i + skip - 2)) / 2)


@bound
def autocorrelation(x: Column) -> Column:
    """Sums of products of the series with itself at every shift from one less than its length backwards to that forwards."""
    n = F.size(x)
    part = lambda k: F.zip_with(F.slice(x, k + 1, n - k), F.slice(x, 1, n - k), lambda a, b: a * b)
    one = lambda k: F.aggregate(part(k), F.lit(0.0), lambda s, y: s + y)
    return F.transform(_span(2 * n - 1), lambda i: one(F.abs(i - n)))


def mirrored(v: Column, f) -> Column:
    """The series f of the bytes read backwards, put back in the order of the message."""
    return F.reverse(f(F.reverse(v)))


def gram_entropy(v: Column, n: int) -> Column:
    """Entropy of each run of n bytes."""
    return F.transform(windows(v, n), lambda w: _entropy(w))


def _entropy(v: Column) -> Column:
    n = F.size(v)
    share = lambda x: F.size(F.filter(v, lambda y: y == x)) / n
    return F.aggregate(F.array_distinct(v), F.lit(0.0), lambda a, x: a - share(x) * F.log2(share(x)))


def bits(v: Column) -> Column:
    """The bits of bytes, the highest first."""
    return F.flatten(F.transform(v, lambda x: F.transform(F.sequence(F.lit(7), F.lit(0)), lambda k: F.getbit(x, k).cast("int"))))


@bound
def bit_gram_entropy(v: Column, n: int = 3) -> Column:
    """Entropy of overlapping runs of n bits, over n; null for no bytes."""
    whole = lambda w: F.aggregate(w, F.lit(0), lambda a, b: a * 2 + b)
    return F.when(F.size(v) > 0, entropy(F.transform(windows(bits(v), n), whole)) / n)


def xor_entropy(a: Column, b: Column, n: int = 3) -> Column:
    """Bit-run entropy of two series combined by exclusive or, as far as the shorter reaches."""
    size = F.least(F.size(a), F.size(b))
    return bit_gram_entropy(F.zip_with(F.slice(a, 1, size), F.slice(b, 1, size), lambda x, y: x.bitwiseXOR(y)), n)


def similarity_at(feature: Column, hay: Column, measure: str = "sad") -> Column:
    """A feature held against every place of a longer series: "sad" sums absolute differences, "cosine" gives a distance, "pearson" a correlation.

    Where a measure isn't defined (no variance, a zero vector) it is null; a feature longer than the series has no place.
    """
    n = F.size(feature)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))

    def one(w: Column) -> Column:
        if measure == "sad":
            return total(F.zip_with(feature, w, lambda x, y: F.abs(x - y).cast("double")))
        aa, bb, ab = dot(feature, feature), dot(w, w), dot(feature, w)
        if measure == "cosine":
            return F.when((aa > 0) & (bb > 0), 1 - ab / F.sqrt(aa * bb))
        sa, sb = total(feature), total(w)
        va, vb = n * aa - sa * sa, n * bb - sb * sb
        return F.when((va > 0) & (vb > 0), (n * ab - sa * sb) / F.sqrt(va * vb))

    return F.transform(_span(F.size(hay) - n + 1), lambda i: one(F.slice(hay, i, n)))


def best_place(at: Column, measure: str = "sad") -> Column:
    """Zero-based place of the best match: the greatest correlation, or the least distance; the first on ties."""
    best = F.array_max(at) if measure == "pearson" else F.array_min(at)
    return (F.array_position(at, best) - 1).cast("int")


def normalisation(method: str, dims: Column, span: float = 255.0) -> Column:
    """One over the greatest distance that a method can give for series of dims values over a domain span wide."""
    most = {"cosine": F.lit(1.0), "correlation": F.lit(2.0), "canberra": dims.cast("double"), "euclidean": dims * span, "sqeuclidean": dims * span * span}
    return 1 / most[method]


def sigmoid(x: Column, shift: float = 0.5) -> Column:
    """Soft threshold of a dissimilarity."""
    return 1 / (1 + F.exp(-(math.pi**2) * (x - shift)))


def flag_pairs(v: Column) -> Column:
    """Zero-based places of two bytes, not both zero, with at most two bits set in each."""
    few = lambda x: F.bit_count(x) <= 2
    at = lambda i: F.element_at(v, i)
    return F.transform(F.filter(_span(F.size(v) - 1), lambda i: few(at(i)) & few(at(i + 1)) & (at(i) + at(i + 1) > 0)), lambda i: i - 1)


def drops(v: Column, share: float = 0.3) -> Column:
    """Zero-based places of a value in the top share of the series' range before one in the bottom share."""
    low, high = F.array_min(v), F.array_max(v)
    at = lambda i: F.element_at(v, i)
    hit = lambda i: (at(i) > high - (high - low) * share) & (at(i + 1) < low + (high - low) * share)
    return F.transform(F.filter(_span(F.size(v) - 1), hit), lambda i: i - 1)


@bound
def undefined_borders(x: Column) -> Column:
    """Zero-based places at which a run of undefined (null) values begins or ends."""
    at = lambda i: F.element_at(x, i).isNull()
    return F.transform(F.filter(_span(F.size(x)), lambda i: (i > 1) & (at(i) != at(F.greatest(i - 1, F.lit(1))))), lambda i: i - 1)


def first_unprintable(v: Column) -> Column:
    """Zero-based place of the first unprintable byte; null without one."""
    return F.array_min(F.transform(F.filter(_span(F.size(v)), lambda i: ~F.element_at(v, i).between(0x20, 0x7E)), lambda i: i - 1))


#: Series of bytes by name.
FEATURES = {
    "bcpnm": lambda v: window_mean(bit_congruence(v), 4),
    "bc": bit_congruence,
    "bcg": lambda v: gaussian(bit_congruence(v), 1.5),
    "bcd": lambda v: delta(bit_congruence(v)),
    "bcdg": lambda v: gaussian(delta(bit_congruence(v)), 0.6),
    "hbcg": lambda v: gaussian(horizon(bit_congruence(v)), 1.5),
    "sbcdg": lambda v: gaussian(lagged(window_mean(bit_congruence(v), 2), 2), 1.5),
    "variance": delta,
    "value": lambda v: v,
    "ntropy": lambda v: gram_entropy(v, 3),
    "stropy": lambda v: F.array(entropy(v)),
}
