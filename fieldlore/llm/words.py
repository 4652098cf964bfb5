"""Words and their 64-bit hashes for many texts at once, over one byte buffer.

The hash of a byte run is a sum of random byte weights times powers of an odd number modulo 2**64, taken from a
prefix sum, then mixed. Equal runs have equal hashes in every process and at every place.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

#: Odd base of the powers.
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, thrice)."""
    x = np.asarray(x, "u8").copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ x >> np.uint64(31)


WEIGHT = mix(np.arange(1, 257, dtype="u8") * np.uint64(0xD6E8FEB86659FD93))
#: Bytes that separate words: the space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that separate runs of letters: ASCII that is no letter.
NO_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
LOWER = np.arange(256, dtype="u1")
LOWER[65:91] += 32


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(1 << bits, base, "u8")
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(20, int(n).bit_length()))


class Words:
    """The words of texts: start and end in the buffer, hash, and the range of words of each text."""

    def __init__(self, texts: list[str | None], separators: np.ndarray = SPACE, lower: bool = False):
        data = [(t or "").encode() for t in texts]
        self.buffer = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
        if lower:
            self.buffer = LOWER[self.buffer]
        gap = separators[self.buffer]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        place = np.cumsum([0] + [len(x) + 1 for x in data])
        #: words of text i are first[i] to first[i + 1]
        self.first = np.searchsorted(self.start, place)
        self.pow, self.inverse = powers(len(self.buffer))
        self.sums = np.zeros(len(self.buffer) + 1, "u8")
        np.cumsum(WEIGHT[self.buffer] * self.pow[: len(self.buffer)], out=self.sums[1:])

    def hashes(self, longest: int | None = None, salt: int = 0) -> np.ndarray:
        """Hash of each word, or of its first bytes."""
        end = self.end if longest is None else np.minimum(self.end, self.start + longest)
        h = (self.sums[end] - self.sums[self.start]) * self.inverse[self.start]
        return mix(h + (end - self.start).astype("u8") * np.uint64(0xA0761D6478BD642F) + np.uint64(salt))

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


#: What is left of a 64-bit number when its first so many bytes are kept; bytes up to which a word is hashed in arrays.
KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], "u8")
LONG = 64


def lower_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts in lower-case ASCII, and where each text's begin and end; words are read eight bytes at a time.

    Words of up to eight bytes and one length never share a hash.
    """
    data = [(t or "").encode() for t in texts]
    joined = (b"\n".join(data) + b"\n" + bytes(8)).lower()
    buffer = np.frombuffer(joined, np.uint8)[:-8]
    gap = (buffer == 32) | (buffer - np.uint8(9) < 5)
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    edge = edge if gap[0] else np.concatenate([[0], edge])
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    numbers = np.ndarray(len(buffer) + 1, "<u8", joined, strides=(1,))
    h = mix((numbers[start] & KEPT[np.minimum(size, 8)]) + size.astype("u8") * np.uint64(0xA0761D6478BD642F))
    more, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(more):
        h[more] = mix((h[more] ^ numbers[start[more] + at] & KEPT[np.minimum(size[more] - at, 8)]) + np.uint64(0xE7037ED1A0B428DB))
        at += 8
        more = more[size[more] > at]
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(joined[start[k] : start[k] + size[k]], digest_size=8).digest(), "little")
    return h, np.searchsorted(start, np.cumsum([0] + [len(x) + 1 for x in data]))


def chunks(texts: list, size: int = 1 << 20):
    """Runs (from, to) of texts of about size characters; a longer text is alone."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and total + n > size:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(texts):
        yield at, len(texts)
