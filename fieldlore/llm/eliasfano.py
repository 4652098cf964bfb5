"""Elias-Fano sequences in files: monotone integers, searched and read by arrays of queries.

A value's low bits are packed; its high part is written in unary, one zero for each step, so that the numbers with a given
high part are found by selecting two zeros. Counts of zeros and ones before each 64-bit word speed selection up. A file
holds several named arrays after a JSON header, and is opened as a memory map: nothing is read until a query asks.
"""

from __future__ import annotations

import json
import mmap
import tempfile

import numpy as np

from fieldlore.llm.shared import get, plain

U = np.uint64


def build(values: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a non-decreasing sequence of unsigned integers."""
    x = np.asarray(values, "u8")
    n = len(x)
    base = x[0] if n else U(0)
    y = x - base
    top = int(y[-1]) if n else 0
    bits = max(0, (top // n).bit_length() - 1) if n else 0
    high = (y >> U(bits)).astype("i8") + np.arange(n)
    words = np.zeros((int(high[-1]) // 64 + 2) if n else 2, "u8")
    np.bitwise_or.at(words, high >> 6, U(1) << (high & 63).astype("u8"))
    # the last step is closed by zeros, of which the spare word has enough
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype="u8")])
    zeros = np.arange(len(words) + 1, dtype="u8") * U(64) - ones
    low = np.zeros(n * bits // 64 + 2, "u8")
    if bits and n:
        at = np.arange(n, dtype="i8") * bits
        w, s = at >> 6, (at & 63).astype("u8")
        v = y & U((1 << bits) - 1)
        np.bitwise_or.at(low, w, v << s)
        over = s.astype("i8") + bits > 64
        np.bitwise_or.at(low, w[over] + 1, v[over] >> (U(64) - s[over]))
    return {"head": np.array([n, int(base), bits, top], "u8"), "high": words, "ones": ones, "zeros": zeros, "low": low}


ONE_EACH, HIGH_EACH = U(0x0101010101010101), U(0x8080808080808080)


def _bit_in_byte() -> np.ndarray:
    """For each rank (from 0) and byte the place of the set bit of that rank."""
    out = np.zeros((8, 256), "u1")
    for byte in range(256):
        for k, at in enumerate(i for i in range(8) if byte >> i & 1):
            out[k, byte] = at
    return out.ravel()


BIT_IN_BYTE = _bit_in_byte()


def nth_bit(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit (from 0) of each word: bytes are counted side by side, then one is looked up."""
    x = word >> U(1)
    x &= U(0x5555555555555555)
    np.subtract(word, x, out=x)
    y = x >> U(2)
    y &= U(0x3333333333333333)
    x &= U(0x3333333333333333)
    x += y
    np.right_shift(x, U(4), out=y)
    x += y
    x &= U(0x0F0F0F0F0F0F0F0F)
    # byte i now gets the number of set bits up to it
    x *= ONE_EACH
    k = k.astype("u8")
    y = k * ONE_EACH
    y |= HIGH_EACH
    y -= x
    y &= HIGH_EACH
    place = np.bitwise_count(y).astype("u8")
    place <<= U(3)
    x <<= U(8)
    x >>= place
    x &= U(255)
    k -= x
    k <<= U(8)
    k |= word >> place & U(255)
    return (place + BIT_IN_BYTE[k]).astype("i8")


def bit_after(words: np.ndarray, at: np.ndarray, zeros: bool) -> np.ndarray:
    """Place of the first one, or zero, after places at, or -1 where the rest of the word has none."""
    w = at >> 6
    x = words[w]
    if zeros:
        x = ~x
    x &= U(0xFFFFFFFFFFFFFFFE) << (at & 63).astype("u8")
    low = x & (~x + U(1))
    low -= U(1)
    return np.where(x == 0, -1, w * 64 + np.bitwise_count(low))


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, base, self.bits, self.top = (int(v) for v in arrays["head"])
        self.base = U(base)
        self.high, self.ones, self.zeros, self.low = (arrays[k] for k in ("high", "ones", "zeros", "low"))
        #: the low bits as a number from each byte on
        self.bytes = np.ndarray(8 * len(self.low) - 7, "<u8", np.ascontiguousarray(self.low).view("u1"), strides=(1,))

    def __len__(self) -> int:
        return self.n

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), "u8")
        at = i * self.bits
        if self.bits <= 57:
            v = self.bytes[at >> 3]
            v >>= (at & 7).astype("u8")
            v &= U((1 << self.bits) - 1)
            return v
        w, s = at >> 6, (at & 63).astype("u8")
        v = self.low[w] >> s
        v |= np.where(s > 0, self.low[w + 1] << (U(64) - np.maximum(s, U(1))), U(0))
        return v & U((1 << self.bits) - 1)

    def select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the k-th one, or zero, of the unary part."""
        before = self.zeros if zeros else self.ones
        w = np.searchsorted(before, k.astype("u8"), side="right") - 1
        word = self.high[w]
        return w * 64 + nth_bit(~word if zeros else word, k - before[w].astype("i8"))

    def next(self, at: np.ndarray, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the k-th one, or zero, the one after that at places at."""
        out = bit_after(self.high, at, zeros)
        far = np.flatnonzero(out < 0)
        out[far] = self.select(k[far], zeros)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        i = np.asarray(i, "i8")
        return ((self.select(i, False) - i).astype("u8") << U(self.bits) | self.lows(i)) + self.base

    def get_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at places i and at those after them."""
        i = np.asarray(i, "i8")
        at = self.select(i, False)
        after = self.next(at, i + 1, False)
        return ((at - i).astype("u8") << U(self.bits) | self.lows(i)) + self.base, ((after - i - 1).astype("u8") << U(self.bits) | self.lows(i + 1)) + self.base

    def lower_bound(self, x: np.ndarray, first: np.ndarray | int = 0, last: np.ndarray | int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value not below x, whether it equals x), each looked for at places first to last alone: the successor search."""
        x = np.asarray(x, "u8")
        first = np.broadcast_to(np.asarray(first, "i8"), x.shape)
        last = np.broadcast_to(np.asarray(self.n if last is None else last, "i8"), x.shape)
        if not self.n:
            return np.zeros(len(x), "i8"), np.zeros(len(x), bool)
        below, above = x < self.base, x > self.base + U(self.top)
        y = np.where(below | above, U(0), x - self.base)
        h = (y >> U(self.bits)).astype("i8")
        # the high part's numbers stand between two zeros, or before the first one
        zero = np.where(h > 0, self.select(np.maximum(h - 1, 0), True), -1)
        after = np.empty_like(zero)
        some = zero >= 0
        after[some] = self.next(zero[some], h[some], True)
        after[~some] = self.select(np.zeros(1, "i8"), True)[0]
        stop = np.clip(after - h, first, last)
        want = y & U((1 << self.bits) - 1)
        a, b = np.clip(zero + 1 - h, first, last), stop.copy()
        while (open_ := np.flatnonzero(a < b)).size:
            mid = (a[open_] + b[open_]) >> 1
            less = self.lows(mid) < want[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
        found = a < stop
        k = np.flatnonzero(found)
        found[k] = self.lows(a[k]) == want[k]
        found &= ~(below | above)
        return np.where(below, first, np.where(above, last, a)), found


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """One file of named arrays."""
    parts, at, table = [], 0, {}
    for name, a in arrays.items():
        data = np.ascontiguousarray(a).tobytes()
        table[name] = (a.dtype.str, len(a), at)
        data += b"\0" * (-len(data) % 64)
        parts.append(data)
        at += len(data)
    head = json.dumps(table).encode()
    head += b" " * (-(len(head) + 8) % 64)
    return b"".join([len(head).to_bytes(8, "little"), head, *parts])


def unpack(path: str) -> dict[str, np.ndarray]:
    """The arrays of a local file, as views of a memory map."""
    with open(path, "rb") as f:
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    n = int.from_bytes(data[:8], "little")
    return {k: np.frombuffer(data, d, m, 8 + n + at) for k, (d, m, at) in json.loads(data[8 : 8 + n]).items()}


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file in the shared folder; of one in a store that can't be mapped, a copy without a name, which goes with the map."""
    if local := plain(path):
        return unpack(local)
    with tempfile.NamedTemporaryFile() as f:
        f.write(get(path))
        f.flush()
        return unpack(f.name)
