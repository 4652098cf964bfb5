"""Where messages are cut, for many messages at once.

A batch is one buffer with the bounds of its messages. A segmentation of it is a mask: True where a segment begins, which
each message that isn't empty does at its first byte. Segmenters make a mask, refinements turn one into another; each works on
whole arrays, by differences, running extremes and sums over ranges. Only what reads a message from left to right (text
windows, random runs) goes message by message.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of messages that are worked on at once, about; a longer message is alone.
CHUNK = 1 << 20


class Batch:
    def __init__(self, messages: list[bytes | None]):
        self.data = np.frombuffer(b"".join(m or b"" for m in messages), np.uint8)
        self.first = np.concatenate([[0], np.cumsum([len(m) if m else 0 for m in messages])]).astype("i8")
        self.size = np.diff(self.first)
        #: the message of each byte, its place there, and how many bytes follow it
        self.owner = np.repeat(np.arange(len(self.size)), self.size)
        self.place = np.arange(len(self.data)) - self.first[:-1][self.owner]
        self.rest = self.size[self.owner] - 1 - self.place

    def whole(self) -> np.ndarray:
        return self.place == 0

    def segments(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the segments."""
        begin = np.flatnonzero(mask)
        return begin, np.append(begin[1:], len(self.data))[: len(begin)]


def _runs(owner: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, "i8")


class Series:
    """Numbers of each message, one after the other: values, the message of each, its place in the series, and the series' length."""

    def __init__(self, values: np.ndarray, owner: np.ndarray):
        self.values, self.owner = values, owner
        begin = _runs(owner)
        length = np.diff(np.append(begin, len(owner)))
        self.begin, self.size = np.repeat(begin, length), np.repeat(length, length)
        self.place = np.arange(len(owner)) - self.begin

    def differences(self) -> Series:
        return Series(np.diff(self.values)[self.owner[1:] == self.owner[:-1]], self.owner[1:][self.owner[1:] == self.owner[:-1]])

    def smooth(self, sigma: float) -> Series:
        """Gaussian filter with mirrored ends: outer pairs of neighbours first, as they are summed where ties matter."""
        radius = int(4 * sigma + 0.5)
        weight = np.exp(-0.5 / (sigma * sigma) * np.arange(-radius, radius + 1) ** 2)
        weight = (weight / weight.sum())[radius:]

        def at(step: int) -> np.ndarray:
            turn = (self.place + step) % np.maximum(2 * self.size, 1)
            return self.values[self.begin + np.where(turn < self.size, turn, 2 * self.size - 1 - turn)]

        out = self.values * weight[0] if len(self.values) else self.values
        for k in range(radius, 0, -1):
            out = out + (at(-k) + at(k)) * weight[k]
        return Series(out, self.owner)

    def extremes(self) -> tuple[np.ndarray, np.ndarray]:
        """Masks of strict minima and maxima; an end counts if beyond its only neighbour, a single number doesn't."""
        step = np.sign(np.diff(self.values))
        inner = self.owner[1:] == self.owner[:-1]
        before, after = np.zeros(len(self.values)), np.zeros(len(self.values))
        before[1:][inner], after[:-1][inner] = step[inner], step[inner]
        start, end, some = self.place == 0, self.place == self.size - 1, self.size > 1
        return some & (start | (before < 0)) & (end | (after > 0)), some & (start | (before > 0)) & (end | (after < 0))


def congruence(b: Batch) -> Series:
    """Share of equal bits of neighbouring bytes."""
    inner = b.rest[:-1] > 0 if len(b.data) else np.zeros(0, bool)
    return Series((1 - np.bitwise_count(b.data[:-1] ^ b.data[1:]) / 8)[inner], b.owner[1:][inner])


def first_of(score: np.ndarray, begin: np.ndarray, end: np.ndarray, least: bool = False) -> np.ndarray:
    """The first place of the greatest (or least) score in each range; the ranges follow one another, and none is empty."""
    if not len(begin):
        return np.zeros(0, "i8")
    # ranges that the score ends before can't be asked for: one number more closes the last
    edges = np.stack([begin, end], 1).ravel()
    padded = np.append(score, np.nan)
    best = (np.fmin if least else np.fmax).reduceat(padded, edges)[::2]
    number = np.repeat(np.arange(len(begin)), end - begin)
    at = np.concatenate([np.arange(a, z) for a, z in zip(begin.tolist(), end.tolist(), strict=True)])
    hit = padded[at] == best[number]
    _, one = np.unique(number[hit], return_index=True)
    return at[hit][one]


def well_apart(b: Batch, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The mask of candidate cuts (message and place, in order) that come more than one byte after the candidate before, or the message's start.

    A message's end is a candidate, too: where one comes too close before it, the last cut kept gives way.
    """
    mask = b.whole()
    if not len(owner):
        return mask
    new = np.concatenate([[True], owner[1:] != owner[:-1]])
    kept = place - np.where(new, 0, np.append(0, place[:-1])) > 1
    last = np.append(new[1:], True)
    tight = np.zeros(len(b.size), bool)
    tight[owner[last]] = (b.size[owner] - place)[last] <= 1
    # the number of cuts kept up to each one says which is its message's last
    some = np.flatnonzero(kept)
    final = some[np.append(owner[some][1:] != owner[some][:-1], True)] if len(some) else some
    kept[final[tight[owner[final]]]] = False
    mask[b.first[owner[kept]] + place[kept]] = True
    return mask


def steepest_rises(b: Batch, sigma: float = 0.6) -> np.ndarray:
    """Cuts where bit congruence's change rises most steeply on the way from a minimum of the smoothed change straight to a maximum."""
    raw = congruence(b).differences()
    low, high = raw.smooth(sigma).extremes()
    # messages of three bytes have a single change
    turn = np.flatnonzero(low | high)
    up = low[turn[:-1]] & high[turn[1:]] & (raw.owner[turn[:-1]] == raw.owner[turn[1:]])
    begin, end = turn[:-1][up], turn[1:][up]
    step = np.append(np.diff(raw.values), 0.0) if len(raw.values) else raw.values
    at = first_of(step, begin, end)
    return well_apart(b, raw.owner[at], raw.place[at] + 2)


def lows_between(b: Batch, sigma: float = 1.5, horizon: bool = False) -> np.ndarray:
    """Cuts at the least raw value around each minimum of the smoothed series: bit congruence, or how much it exceeds the mean of the two before.

    What is around a minimum ends half-way to the ones beside it, the message's start and its end (halves go to the even number). The
    series stands one byte further in its message, after a zero.
    """
    raw = congruence(b)
    if horizon:
        kept = raw.place >= 2
        beyond = raw.values.copy()
        beyond[2:] -= (raw.values[1:-1] + raw.values[:-2]) / 2
        raw = Series(beyond[kept], raw.owner[kept])
    low, _ = raw.smooth(sigma).extremes()
    stop, owner = raw.place[low] + 1, raw.owner[low]
    if not len(stop):
        return b.whole()
    new = np.concatenate([[True], owner[1:] != owner[:-1]])
    before = np.where(new, 0, np.append(0, stop[:-1]))
    after = np.where(np.append(new[1:], True), b.size[owner], np.append(stop[1:], 0))
    begin = before + np.round((stop - before) / 2).astype("i8")
    end = stop + np.round((after - stop) / 2).astype("i8")
    # the zero and the series of each message, one message after the other
    messages = np.flatnonzero(np.bincount(raw.owner, minlength=len(b.size)))
    size = np.bincount(raw.owner, minlength=len(b.size)) + 1
    start = np.zeros(len(b.size), "i8")
    start[messages] = np.concatenate([[0], np.cumsum(size[messages])])[:-1]
    values = np.zeros(int(size[messages].sum()))
    values[start[raw.owner] + raw.place + 1] = raw.values
    end = np.minimum(end, size[owner])
    some = end > begin
    at = first_of(values, (start[owner] + begin)[some], (start[owner] + end)[some], least=True)
    return well_apart(b, owner[some], at - start[owner[some]])


def steep_changes(b: Batch, steepness: int = 200) -> np.ndarray:
    """Cuts where the change of neighbouring bytes turns by more than steepness, or begins or ends to be none; the cut is at the greater change."""
    d = Series(b.data.astype("i8"), b.owner).differences()
    inner = d.owner[1:] == d.owner[:-1]
    left, right, at = d.values[:-1][inner], d.values[1:][inner], d.place[:-1][inner]
    turn = (np.abs(right - left) > steepness) | ((left == 0) != (right == 0))
    mask = b.whole()
    mask[(b.first[d.owner[:-1][inner]] + at + np.where(np.abs(left) > np.abs(right), 1, 2))[turn]] = True
    return mask


def falls(b: Batch, share: float = 0.3) -> np.ndarray:
    """Cuts before a byte in the top share of its message's range that one in the bottom share follows."""
    mask = b.whole()
    if len(b.data):
        begin, v = _runs(b.owner), b.data.astype(float)
        number = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(v))))
        top, bottom = np.maximum.reduceat(v, begin)[number], np.minimum.reduceat(v, begin)[number]
        margin = (top - bottom) * share
        mask[:-1] |= (v[:-1] > (top - margin)[:-1]) & (v[1:] < (bottom + margin)[1:]) & (b.rest[:-1] > 0)
    return mask


def backwards(b: Batch, cut) -> np.ndarray:
    """The cuts of the messages read from their end."""
    at = b.first[:-1][b.owner] + b.rest
    turned = Batch([])
    turned.data, turned.first, turned.size, turned.owner, turned.place, turned.rest = b.data[at] if len(at) else b.data, b.first, b.size, b.owner, b.place, b.rest
    mask = cut(turned)
    out = b.whole()
    inner = np.flatnonzero(mask & (b.place > 0))
    # a cut before byte k from the end is one before byte n - k
    out[b.first[:-1][b.owner[inner]] + b.size[b.owner[inner]] - b.place[inner]] = True
    return out


def printable(b: Batch) -> np.ndarray:
    return (b.data >= 0x20) & (b.data <= 0x7E)


def _wholly(b: Batch, mask: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Which segments have only good bytes."""
    begin = np.flatnonzero(mask)
    return np.logical_and.reduceat(good, begin) if len(begin) else np.zeros(0, bool)


def joined_text(b: Batch, mask: np.ndarray) -> np.ndarray:
    """Neighbours that are both wholly printable become one."""
    begin, text = np.flatnonzero(mask), _wholly(b, mask, printable(b))
    out = mask.copy()
    both = text[1:] & text[:-1] & (b.place[begin[1:]] > 0)
    out[begin[1:][both]] = False
    return out


def widened_text(b: Batch, mask: np.ndarray, good: np.ndarray | None = None) -> np.ndarray:
    """A run of wholly printable segments becomes one, and reaches back over the printable end of the segment before it.

    It reaches on over the printable start of the segment after it if it has an odd number of segments: these are taken in pairs, each
    first one with what follows it.
    """
    good = printable(b) if good is None else good
    begin, end = b.segments(mask)
    text = _wholly(b, mask, good)
    if not text.any():
        return mask.copy()
    new = text & ~np.append(False, text[:-1] & (b.place[begin[1:]] > 0))
    number = np.cumsum(new)[text] - 1
    start, stop = begin[new], np.zeros(new.sum(), "i8")
    stop[number] = end[text]
    odd = np.bincount(number) % 2 == 1
    # the last bad byte before each place, and the first one from it on
    n = len(b.data)
    at = np.arange(n)
    back = np.append(-1, np.maximum.accumulate(np.where(good, -1, at)))
    on = np.append(np.minimum.accumulate(np.where(good, n, at)[::-1])[::-1], n)
    message = b.owner[start]
    left = np.maximum(back[start] + 1, b.first[message])
    right = np.where(odd, np.minimum(on[stop], b.first[message + 1]), stop)
    out = mask.copy()
    # within what a run now covers there is no cut but its start
    cover = np.zeros(n + 1, "i8")
    np.add.at(cover, left, 1)
    np.add.at(cover, right, -1)
    out[np.cumsum(cover[:-1]) > 0] = False
    out[left] = True
    ends = right[(right < n)]
    out[ends] = True
    out[b.place == 0] = True
    return out


def zero_edges(b: Batch, mask: np.ndarray, little_endian: bool = False) -> np.ndarray:
    """Cuts at the edges of runs of zeros, which outrank inferred ones a byte away.

    A run of one or two zeros belongs to text before it (or to whatever is before it, for little endian), otherwise to what follows.
    """
    n = len(b.data)
    if not n:
        return mask.copy()
    zero = b.data == 0
    edge = b.whole()
    edge[1:] |= zero[1:] != zero[:-1]
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], n)
    short = zero[begin] & (end - begin <= 2)
    sums = Sums(b.data.tobytes())
    after_text = np.array([little_endian or (b.place[a] >= 6 and sums.text_like(a - 6, a)) for a in begin[short].tolist()], bool)
    kept = edge.copy()
    kept[begin[short][after_text]] = False
    closing = end[short][~after_text]
    inside = (closing < n) & (b.place[np.minimum(closing, n - 1)] > 0)
    kept[closing[inside]] = False
    # an inferred cut stays unless an edge, or the message's end, is one byte from it
    own = mask.copy()
    own[1:] &= ~kept[:-1] | (b.place[1:] == 0)
    own[:-1] &= ~(kept[1:] | (b.rest[:-1] == 0))
    own[-1] = False
    return own | kept | b.whole()


def single_bytes_first(b: Batch, mask: np.ndarray) -> np.ndarray:
    """The first segment of each message in single bytes."""
    begin, end = b.segments(mask)
    first = b.place[begin] == 0
    cover = np.zeros(len(b.data) + 1, "i8")
    cover[begin[first]] += 1
    cover[end[first]] -= 1
    return mask | (np.cumsum(cover[:-1]) > 0)


def text_like(b: bytes, low: float = 50, high: float = 115, least: int = 6) -> bool:
    """The test of ``functions.series.text_like`` for one value."""
    some = [x for x in b if x]
    if len(b) < least or not some:
        return False
    odd = sum(not 0x20 <= x <= 0x7E for x in some)
    return max(b) < 0x7F and low <= sum(some) / len(some) <= high and odd / len(b) < 0.33


class Sums:
    """Prefix sums of a message, by which any stretch is tested for text in constant time."""

    def __init__(self, data: bytes):
        v = np.frombuffer(data, np.uint8).astype(np.int64)
        odd = (v != 0) & ((v < 0x20) | (v > 0x7E))
        double = np.append((v[:-1] == 0) & (v[1:] == 0), False)[: len(v)]
        self.some, self.total, self.odd, self.high, self.double = (np.concatenate([[0], np.cumsum(x)]).tolist() for x in (v != 0, v, odd, v >= 0x7F, double))

    def text_like(self, a: int, z: int, low: float = 50, high: float = 115, least: int = 6) -> bool:
        """What text_like says of bytes a to z."""
        some = self.some[z] - self.some[a]
        if z - a < least or not some or self.high[z] > self.high[a]:
            return False
        return low <= (self.total[z] - self.total[a]) / some <= high and (self.odd[z] - self.odd[a]) / (z - a) < 0.33

    def zeros(self, a: int, z: int) -> int:
        return z - a - (self.some[z] - self.some[a])

    def double_zero(self, a: int, z: int) -> bool:
        return z - a > 1 and self.double[z - 1] > self.double[a]


def gather_text(segments: list[bytes], least: int = 6) -> list[bytes]:
    """Joins neighbours that together, from least bytes on, stay text-like and free of double zeros; else the first goes as it is."""
    data = b"".join(segments)
    ends, sums, out, i, start = np.cumsum([len(s) for s in segments]).tolist(), Sums(data), [], 0, 0
    while i < len(segments):
        found, j = 0, i
        while j < len(segments):
            if ends[j] - start >= least:
                if not sums.text_like(start, ends[j]) or sums.double_zero(start, ends[j]):
                    break
                found = ends[j]
            j += 1
        # without a text the first segment stands alone and the search goes on behind it
        i = j if found else i + 1
        out.append(data[start : ends[i - 1]])
        start = ends[i - 1]
    return out


def text_fields(data: bytes, least: int = 6) -> list[tuple[int, int]]:
    """Recognised text (from, to), from the left; what follows one is looked at a byte later.

    A window of least bytes opens where it is text-like and has no zero, or several but no two in a row (text of two bytes a character). It grows
    while it stays text-like, and ends with a zero that it takes in after a character that isn't zero two bytes before it. Windows that
    begin at the last least bytes aren't looked at.
    """
    sums, out, a, n = Sums(data), [], 0, len(data)
    while a < n - least:
        zeros, z = sums.zeros(a, a + least), a + least
        if (zeros and not (zeros > 1 and not sums.double_zero(a, z))) or not sums.text_like(a, z):
            a += 1
            continue
        while z < n and not (data[z] == 0 and data[z - 2]) and sums.text_like(a, z + 1):
            z += 1
        z += z < n and data[z] == 0 and data[z - 2] != 0
        if sums.text_like(a, z):
            out.append((a, z))
            a = z
        a += 1
    return out


def text_spans(data: bytes, least: int = 6) -> list[tuple[int, int]]:
    """Longest text-like stretches without zeros, from the left, of least bytes or more."""
    sums, out, a = Sums(data), [], 0
    while a + least <= len(data):
        z = a + least
        if sums.zeros(a, z) or not sums.text_like(a, z):
            a += 1
            continue
        while z < len(data) and data[z] and sums.text_like(a, z + 1):
            z += 1
        out.append((a, z))
        a = z
    return out


def crop_text(segments: list[bytes], spans=text_spans) -> list[bytes]:
    """Text stretches become segments of their own; other bounds inside them go."""
    data = b"".join(segments)
    found = spans(data)
    inner = {b for a, z in found for b in range(a + 1, z)}
    ends = np.cumsum([len(s) for s in segments]).tolist()
    bounds = sorted(({0, len(data), *ends} - inner) | {x for s in found for x in s})
    return [data[a:z] for a, z in zip(bounds, bounds[1:], strict=False)]


def crop_text_fields(segments: list[bytes]) -> list[bytes]:
    return crop_text(segments, text_fields)


def _bit_entropy(b: bytes, n: int) -> float:
    bit = np.unpackbits(np.frombuffer(b, np.uint8)).astype(int)
    grams = sum(bit[k : len(bit) - n + 1 + k] << (n - 1 - k) for k in range(n))
    p = np.bincount(grams) / max(len(grams), 1)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum() / n)


#: short values recur; long ones aren't kept
_short_entropy = lru_cache(50_000)(_bit_entropy)


def bit_entropy(b: bytes, n: int = 3) -> float:
    """Entropy of overlapping runs of n bits, over n."""
    return _short_entropy(b, n) if len(b) <= 16 else _bit_entropy(b, n)


def look_random(a: bytes, b: bytes, x: float, y: float) -> bool:
    """Two neighbours of nearly one bit entropy (x and y), or of high and similar ones whose combination by exclusive or is random too."""
    if abs(x - y) < 0.01:
        return True
    return abs(x - y) < 0.2 and x > 0.5 and y > 0.5 and bit_entropy(bytes(p ^ q for p, q in zip(a, b, strict=False))) > 0.8


def merge_random(segments: list[bytes]) -> list[bytes]:
    """Joins runs in which each original pair looks random, until nothing changes."""
    while True:
        e = [bit_entropy(s) for s in segments]
        out = [list(segments[:1])] if segments else []
        for k in range(1, len(segments)):
            if look_random(segments[k - 1], segments[k], e[k - 1], e[k]):
                out[-1].append(segments[k])
            else:
                out.append([segments[k]])
        joined = [b"".join(run) for run in out]
        if len(joined) == len(segments):
            return joined
        segments = joined


#: Refinements by name: of a mask, and of the segments of one message.
OF_MASKS = {"text": joined_text, "pull": widened_text, "zeros": zero_edges, "first_bytes": single_bytes_first, "zeros_le": lambda b, m: zero_edges(b, m, True)}
OF_SEGMENTS = {"gather": gather_text, "crop_text": crop_text, "crop_fields": crop_text_fields, "random": merge_random}
STEPS = {**OF_MASKS, **OF_SEGMENTS}


def refine(b: Batch, mask: np.ndarray, steps: list[str]) -> np.ndarray:
    for s in steps:
        if s in OF_MASKS:
            mask = OF_MASKS[s](b, mask)
            continue
        begin, end = b.segments(mask)
        data, mask, k = b.data.tobytes(), b.whole(), 0
        while k < len(begin):
            z = k + 1
            while z < len(begin) and b.place[begin[z]]:
                z += 1
            at = int(begin[k])
            for piece in OF_SEGMENTS[s]([data[x:y] for x, y in zip(begin[k:z].tolist(), end[k:z].tolist(), strict=True)]):
                mask[at] = True
                at += len(piece)
            k = z
    return mask


def refined(segments: list[bytes], *steps: str) -> list[bytes]:
    """Steps on the segments of one message."""
    b = Batch([b"".join(segments)])
    mask = b.whole()
    mask[np.cumsum([0, *(len(s) for s in segments[:-1])])[: len(segments)].astype("i8")] = True
    return pieces(b, refine(b, mask, list(steps)))


def pieces(b: Batch, mask: np.ndarray) -> list[bytes]:
    data = b.data.tobytes()
    return [data[a:z] for a, z in zip(*(x.tolist() for x in b.segments(mask)), strict=True)]


def bounds(message: bytes, cut, *args, **kwargs) -> list[int]:
    """The bounds that a segmenter gives one message, its ends included."""
    b = Batch([message])
    return [*np.flatnonzero(cut(b, *args, **kwargs)).tolist(), len(message)] if message else [0]


def as_rows(ids: pa.Array, b: Batch, mask: np.ndarray) -> pa.RecordBatch:
    """Rows (msg_id, seg_no, offset, length, bytes) of a segmentation; the bytes stay in one buffer."""
    begin, end = b.segments(mask)
    owner = b.owner[begin]
    new = _runs(owner)
    number = np.arange(len(begin)) - np.repeat(new, np.diff(np.append(new, len(begin))))
    ends = np.append(begin, len(b.data)).astype("i4")
    binary = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b.data.tobytes())])
    columns = [ids.take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(b.place[begin], pa.int32()), pa.array(end - begin, pa.int32()), binary]
    return pa.RecordBatch.from_arrays(columns, names=["msg_id", "seg_no", "offset", "length", "bytes"])


def in_chunks(sizes: list[int], most: int = CHUNK):
    """Ranges of rows of about most bytes; a larger row is alone."""
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)
