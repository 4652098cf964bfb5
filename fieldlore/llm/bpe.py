"""BPE encoding and decoding over a contiguous rank array.

``MergeTable`` reads a vocabulary file in the JSON form of the tokenizers library. A short word is held as
one list of parts (its boundaries) beside one list with the rank of each adjacent pair; the smallest rank is
searched by a scan, its boundary deleted, and the two neighbouring ranks looked up again. A word of more
than ``SHORT`` symbols, where scans would cost the square of its length, keeps the same order of merges in
a heap.

The words that a batch of texts brings anew are merged together: words of one length are the rows of a matrix,
and each step scans every row for its smallest rank, deletes that boundary and refreshes the two neighbours,
so that all rows stay of one length; rows without a rank left are taken out.

White space never lies inside a pre-token of the word-level vocabulary, and neither NFC nor lower case
reaches across it, so each white-space-delimited word is encoded alone and remembered in a bounded table.
Words of up to 16 bytes are two 64-bit numbers; a hash table in arrays (``WordTable``) looks up those of many
texts at once, and compares the numbers themselves, so that no two words are taken for one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import normalizers

from fieldlore.llm.shared import batches, by_place, col, without
from fieldlore.llm.words import SPACE, chunks

#: Symbols up to which the rank array is scanned.
SHORT = 192
#: Entries of each half of a worker's table of words already seen.
TABLE = 700_000
#: White space to str.split() but not to the vocabulary's patterns.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
#: What separates words in bytes.
SPACES = regex.compile("[\x20\t-\r]")
#: The pattern of byte-level pre-tokens, as published with the vocabulary.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = (1 << 31) - 1
#: Characters of texts whose words are looked up at once.
CHARS = 4 << 20
#: What is left of a 64-bit number when its first so many bytes are kept; 1 and 128 in every byte; ASCII letters.
KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], "u8")
ONES, TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if visible Latin-1, else the next one from U+0100."""
    out, n = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + n))
            n += 1
    return out


def divided(text: str, size: int | None = None):
    """Runs of a text of about size characters (CHARS by default), the next one from white space of ASCII on."""
    at, size = 0, size or CHARS
    while at < len(text):
        m = SPACES.search(text, at + size)
        until = m.start() if m else len(text)
        yield text[at:until]
        at = until


class Recent(dict):
    """A bounded table: make(key) fills it, and when it is full, what hasn't been asked for since the last time goes."""

    def __init__(self, make, limit: int = TABLE):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        return self.keep(key, self.make(key) if value is None else value)

    def add(self, entries: dict) -> None:
        """Many entries at once; they all stay until the table is full again."""
        if len(self) + len(entries) > self.limit:
            self.old = dict(self)
            self.clear()
        self.update(entries)

    def keep(self, key, value):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PairTable:
    """Ranks by pair of token ids, for arrays: a hash table whose collisions go to a smaller one."""

    def __init__(self, pairs: dict[int, int]):
        keys, ranks = np.array(list(pairs), "u8"), np.array(list(pairs.values()), "i8")
        self.levels, bits = [], 20
        while len(keys):
            slot = self.slot(keys, bits)
            _, first = np.unique(slot, return_index=True)
            k, r = np.full(1 << bits, (1 << 64) - 1, "u8"), np.full(1 << bits, NO_RANK, "i4")
            k[slot[first]], r[slot[first]] = keys[first], ranks[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks = keys[rest], ranks[rest]
            more = np.zeros(1 << bits, bool)
            more[self.slot(keys, bits)] = True
            self.levels.append((bits, k, r, more))
            bits = max(8, bits - 3)

    @staticmethod
    def slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype("i8")

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._look(a.astype("u8") << np.uint64(20) | b.astype("u8"), 0)

    def _look(self, key: np.ndarray, level: int) -> np.ndarray:
        bits, keys, ranks, more = self.levels[level]
        slot = self.slot(key, bits)
        out = np.where(keys[slot] == key, ranks[slot], np.int32(NO_RANK))
        if level + 1 < len(self.levels):
            deeper = np.nonzero(more[slot] & (out == NO_RANK))
            if len(deeper[0]):
                out[deeper] = self._look(key[deeper], level + 1)
        return out


class WordTable:
    """Runs of ids by word of up to 16 bytes, none of them 0: a hash table with linear probes, whose rows have a word's two numbers, and where its run begins and how long it is."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self, room: int = 0) -> None:
        """No words; there is room for as many as the limit, or more for this once."""
        self.bits = max(10, (max(self.limit, room) * 4 // 3).bit_length())
        self.rows, self.size = np.zeros((1 << self.bits, 4), "u8"), 0
        self.pool, self.used = np.zeros(4 * self.limit, "<u4"), 0

    def slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (a ^ b * np.uint64(0xBF58476D1CE4E5B9)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        return (h * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - self.bits)).astype("i8")

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the run of each word begins, -1 where there is none, and its length."""
        at, n, left, slot = np.full(len(a), -1), np.zeros(len(a), "i8"), None, self.slot(a, b)
        while left is None or len(left):
            found = self.rows.take(slot, axis=0)
            hit = (found[:, 0] == a) & (found[:, 1] == b)
            own = hit if left is None else left[hit]
            at[own], n[own] = found[hit, 2], found[hit, 3]
            on = np.flatnonzero(~hit & (found[:, 0] != 0))
            left = on if left is None else left[on]
            a, b, slot = a[on], b[on], slot[on] + 1 & (1 << self.bits) - 1
        return at, n

    def put(self, ids: bytes) -> int:
        """Ids beyond those kept: where they begin. The next call may overwrite them."""
        x = np.frombuffer(ids, "<u4")
        if self.used + len(x) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(len(x) + self.used // 2, "<u4")])
        self.pool[self.used : self.used + len(x)] = x
        return self.used

    def add(self, a: np.ndarray, b: np.ndarray, runs: list[bytes]) -> None:
        """Words that the table doesn't have, each once."""
        n = np.fromiter(map(len, runs), "i8", len(runs)) // 4
        first = self.put(b"".join(runs))
        self.used = first + int(n.sum())
        row = np.stack([a, b, (first + np.cumsum(n) - n).astype("u8"), n.astype("u8")], 1)
        slot, self.size = self.slot(a, b), self.size + len(a)
        while len(row):
            _, one = np.unique(slot, return_index=True)
            one = one[self.rows[slot[one], 0] == 0]
            self.rows[slot[one]] = row[one]
            rest = np.ones(len(row), bool)
            rest[one] = False
            row, slot = row[rest], slot[rest] + 1 & (1 << self.bits) - 1


class MergeTable:
    """Vocabulary, merge ranks and text rules of one file."""

    def __init__(self, path: str, table: int = TABLE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.rank, self.made = {}, []
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 20 | vocab[b]] = r
            self.made.append(vocab[a + b])
        symbols = byte_symbols()
        self.inner = [vocab.get(s) for s in symbols]
        self.final = [vocab.get(s + suffix) for s in symbols]
        self.whole = None not in self.inner and None not in self.final
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        rules = spec.get("normalizer") or {}
        # the library's own NFC: its Unicode version orders the newest combining marks otherwise
        self.nfc = normalizers.NFC().normalize_str
        self.rules = [x["type"] for x in rules.get("normalizers", [rules] if rules else [])]
        pre = spec["pre_tokenizer"]
        splits = [x["pattern"]["Regex"] for x in pre.get("pretokenizers", []) if x["type"] == "Split"]
        self.pattern = regex.compile(splits[0] if splits else BYTE_LEVEL)
        self.by_word = bool(splits)
        self.joins_bytes = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.bytes_of = {c: b for b, c in enumerate(symbols)}
        self.pairs = PairTable(self.rank)
        self.new_id = np.array(self.made, "i4")
        self.words = Recent(self.word, table)
        self.short = WordTable(2 * table) if self.by_word else None

    def normal(self, text: str) -> str:
        if "NFC" in self.rules and not unicodedata.is_normalized("NFC", text):
            text = self.nfc(text)
        if "Lowercase" in self.rules:
            # by character: str.lower() alone would use the final sigma
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return text

    def parts(self, piece: str) -> list[int]:
        """Token ids of one pre-token."""
        data = piece.encode()
        ids = [self.inner[b] for b in data[:-1]]
        ids.append(self.final[data[-1]])
        if not self.whole:
            ids = [i for i in ids if i is not None]
        return self.merge(ids) if len(ids) <= SHORT else self.merge_long(ids)

    def merge(self, ids: list[int]) -> list[int]:
        look, made = self.rank.get, self.made
        ranks = [look(a << 20 | b, NO_RANK) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            at = ranks.index(low)
            ids[at] = new = made[low]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = look(new << 20 | ids[at + 1], NO_RANK)
            if at:
                ranks[at - 1] = look(ids[at - 1] << 20 | new, NO_RANK)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in the same order, with a heap and links."""
        look, n = self.rank.get, len(ids)
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := look(ids[i] << 20 | ids[i + 1], -1)) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = self.made[r], False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (q := look(ids[x] << 20 | ids[y], -1)) >= 0:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [t for t, live in zip(ids, alive, strict=True) if live]

    def merge_many(self, pieces: list[str], sizes: bool = False) -> list:
        """Token ids of many pre-tokens as little-endian 32-bit integers, in their order, or only how many there are of each."""
        out: list = [None] * len(pieces)
        data = [p.encode() for p in pieces]
        size = np.fromiter(map(len, data), "i4", len(data))
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            if n > SHORT or len(at) < 16 or not self.whole:
                for i in at.tolist():
                    ids = self.parts(pieces[i])
                    out[i] = len(ids) if sizes else struct.pack(f"<{len(ids)}I", *ids)
                continue
            symbols = np.frombuffer(b"".join([data[i] for i in at.tolist()]), np.uint8).reshape(-1, n)
            ids = np.array(self.inner, "i4")[symbols]
            ids[:, -1] = np.array(self.final, "i4")[symbols[:, -1]]
            ranks = self.pairs.look(ids[:, :-1], ids[:, 1:])
            while len(at):
                low = ranks.min(1) if ranks.shape[1] else np.full(len(at), NO_RANK)
                done = low == NO_RANK
                if done.any():
                    if sizes:
                        for i in at[done].tolist():
                            out[i] = ids.shape[1]
                    else:
                        rows, step = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                        for k, i in enumerate(at[done].tolist()):
                            out[i] = rows[k * step : k * step + step]
                    live = ~done
                    at, ids, ranks, low = at[live], ids[live], ranks[live], low[live]
                    if not len(at):
                        break
                k, rows = ranks.argmin(1), np.arange(len(at))
                ids[rows, k] = self.new_id[low]
                cols = np.arange(ids.shape[1] - 1)
                ids = np.take_along_axis(ids, cols + (cols > k[:, None]), 1)
                cols = cols[:-1]
                ranks = np.take_along_axis(ranks, cols + (cols >= k[:, None]), 1)
                r = np.flatnonzero(k > 0)
                ranks[r, k[r] - 1] = self.pairs.look(ids[r, k[r] - 1], ids[r, k[r]])
                r = np.flatnonzero(k < ranks.shape[1])
                ranks[r, k[r]] = self.pairs.look(ids[r, k[r]], ids[r, k[r] + 1])
        return out

    def learn(self, new: set[str]) -> None:
        """Puts new words into the table of words by their text."""
        learnt = {w: ids for w in new if (ids := self.words.old.get(w)) is not None}
        fresh = [w for w in new if w not in learnt]
        self.words.add(learnt | dict(zip(fresh, self.ids_of([w.lower() if w.isascii() else w for w in fresh]), strict=True)))

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of words without white space of ASCII; ASCII ones are in lower case."""
        cut, pieces = [], []
        for w in words:
            x = w if w.isascii() else self.normal(w)
            # letters only: one pre-token
            if x.isalpha():
                cut.append(1)
                pieces.append(x)
            else:
                found = self.pattern.findall(x)
                cut.append(len(found))
                pieces += found
        made, k, out = self.merge_many(pieces), 0, []
        for n in cut:
            out.append(made[k] if n == 1 else b"".join(made[k : k + n]))
            k += n
        return out

    def pre_tokens(self, text: str | None) -> tuple[list[str], int]:
        """Pre-tokens of a text (null counts as empty) in their order, special strings left out, and how many of these there are."""
        if not text:
            return [], 0
        out, known, at = [], 0, 0
        for m in self.specials.finditer(text):
            out += self.pattern.findall(self.normal(text[at : m.start()]))
            known, at = known + 1, m.end()
        rest = self.pattern.findall(self.normal(text[at:] if at else text))
        return (out + rest if known else rest), known

    def count_pieces(self, pieces: list[str]) -> list[int]:
        """How many token ids each pre-token has."""
        return self.merge_many(pieces, True)

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_word:
            return list(map(self.encode, texts))
        # words hold no byte of 0, so that their numbers have their length
        usual = [bool(t) and "\0" not in t and not self.specials.search(t) for t in texts]
        out = [b"" if u else self.encode(t) for t, u in zip(texts, usual, strict=True)]
        at = [k for k, u in enumerate(usual) if u]
        for x, y in chunks([texts[k] for k in at], CHARS):
            some = [texts[k] for k in at[x:y]]
            if len(some[0]) > CHARS:
                out[at[x]] = b"".join(self.encode_words([z.encode()])[0] for z in divided(some[0]))
                continue
            for k, ids in zip(at[x:y], self.encode_words([t.encode() for t in some]), strict=True):
                out[k] = ids
        return out

    def encode_words(self, data: list[bytes]) -> list[bytes]:
        """Ids of texts in UTF-8 without special strings and bytes of 0: their words are looked up at once, those that the table doesn't have are learnt first."""
        joined = b"\n".join(data) + b"\n" + bytes(16)
        buffer = np.frombuffer(joined, np.uint8)
        gap = SPACE[buffer[:-16]]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        edge = edge if gap[0] else np.concatenate([[0], edge])
        start, end = edge[0::2], edge[1::2]
        # a mark that closes a word after an ASCII letter is a word of its own
        last = buffer[end - 1]
        mark = ((last == 44) | (last == 46)) & (end - start > 1) & LETTER[buffer[end - 2]]
        times = 1 + mark
        second = np.cumsum(times)[mark] - 1
        start, end = np.repeat(start, times), np.repeat(end, times)
        end[second - 1] -= 1
        start[second] = end[second] - 1
        size = end - start
        numbers = np.ndarray(len(buffer) - 7, "<u8", joined, strides=(1,))
        a = numbers[start] & KEPT[np.minimum(size, 8)]
        b = numbers[start + 8] & KEPT[np.clip(size - 8, 0, 8)]
        plain = ((a | b) & TOPS) == 0
        a, b = (np.where(plain, self.lowered(x), x) for x in (a, b))
        long = np.flatnonzero(size > 16)
        a[long] = 0
        at, n = self.known(a, b, long)
        if len(long):
            words = [joined[s:e].decode() for s, e in zip(start[long].tolist(), end[long].tolist(), strict=True)]
            self.learn({w for w in words if w not in self.words})
            runs = list(map(self.words.__getitem__, words))
            n[long] = np.fromiter(map(len, runs), "i8", len(runs)) // 4
            at[long] = self.short.put(b"".join(runs)) + np.cumsum(n[long]) - n[long]
        until = np.concatenate([[0], np.cumsum(n)])
        ids = self.short.pool.take(np.arange(until[-1]) + np.repeat(at - until[:-1], n)).tobytes()
        place = np.cumsum([0] + [len(x) + 1 for x in data])
        cut = (4 * until[np.searchsorted(start, place)]).tolist()
        return [ids[x:y] for x, y in zip(cut, cut[1:], strict=False)]

    @staticmethod
    def lowered(x: np.ndarray) -> np.ndarray:
        """Eight bytes of ASCII a number, in lower case."""
        return x | ((x + ONES * np.uint64(0x80 - 0x41) ^ x + ONES * np.uint64(0x7F - 0x5A)) & TOPS) >> np.uint64(2)

    def known(self, a: np.ndarray, b: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """look() of the table for words that it has or learns now; long ones aren't looked up."""
        at, n = self.short.look(a, b)
        at[long] = 0
        new = np.flatnonzero(at < 0)
        if not len(new):
            return at, n
        if self.short.size + len(new) > self.short.limit:
            new = np.flatnonzero(a)
            self.short.clear(len(new))
        order = new[np.lexsort((b[new], a[new]))]
        x, y = a[order], b[order]
        one = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        words = [w.decode() for w in np.stack([x[one], y[one]], 1).astype("<u8").view("S16").ravel().tolist()]
        self.short.add(x[one], y[one], self.ids_of(words))
        at[new], n[new] = self.short.look(a[new], b[new])
        return at, n

    def word(self, word: str) -> bytes:
        """Ids of a word without white space, as little-endian 32-bit integers."""
        return struct.pack("<%dI" % len(ids := [i for piece in self.pattern.findall(self.normal(word)) for i in self.parts(piece)]), *ids)

    def plain(self, text: str) -> bytes:
        """Ids of a text without special strings."""
        if not self.by_word:
            ids = [i for piece in self.pattern.findall(self.normal(text)) for i in self.parts(piece)]
            return np.array(ids, "<u4").tobytes()
        if ODD_SPACE.search(text):
            # these few characters are no white space here, and str.split() takes them for it
            split = regex.split(r"\s+", text)
            if any(ODD_SPACE.search(w) for w in split):
                ids = [i for piece in self.pattern.findall(self.normal(text)) for i in self.parts(piece)]
                return np.array(ids, "<u4").tobytes()
        else:
            split = text.split()
        return b"".join(map(self.words.__getitem__, split))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian 32-bit integers; null counts as empty. Special strings are their ids."""
        if not text:
            return b""
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self.plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])]) if at else self.plain(text)

    def decode(self, ids: bytes) -> str:
        """The library's decode(): tokens joined by a space, or bytes joined where the file says so."""
        tokens = map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())
        if not self.joins_bytes:
            return " ".join(tokens)
        return bytes(b for t in tokens for b in (t.encode() if t in self.special else map(self.bytes_of.__getitem__, t))).decode(errors="replace")


@lru_cache(maxsize=4)
def merge_table(path: str, table: int = TABLE) -> MergeTable:
    """One table in each worker."""
    return MergeTable(path, table)


def mapped(df: DataFrame, keep: list[str], text: str, fields: str, kernel) -> DataFrame:
    """Columns keep of df and those of fields, which kernel(texts) gives as lists, batch by batch; a kept column with the name of one of these is replaced."""
    batches(df.sparkSession)
    keep = without(keep, *(f.split()[0] for f in fields.split(", ")))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), fields])

    def run(parts):
        for b in parts:
            cols = kernel(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *cols.values()], names=[*keep, *cols])

    return by_place(df.select(*map(col, keep), col(text))).mapInArrow(run, schema)


def bpe_encode(df: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Column ids array<bigint> beside the kept ones (all but the text by default; one called ids is replaced). Null and empty texts give an empty array; whole texts of any length are read; rows are neither dropped nor merged; an empty table stays empty."""
    keep = [c for c in df.columns if c != text] if keep is None else keep

    def kernel(texts):
        t = merge_table(tokenizer)
        return {"ids": pa.array([np.frombuffer(x, "<u4").astype("int64") for x in t.encode_many(texts)], pa.list_(pa.int64()))}

    return mapped(df, keep, text, "ids array<bigint>", kernel)


def bpe_decode(df: DataFrame, tokenizer: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Column decoded string beside the kept ones (one of that name is replaced); a null or empty array gives an empty string."""
    keep = [c for c in df.columns if c != ids] if keep is None else keep

    def kernel(lists):
        t = merge_table(tokenizer)
        return {"decoded": pa.array([t.decode(np.array(x or [], "<u4").tobytes()) for x in lists], pa.string())}

    return mapped(df, keep, ids, "decoded string", kernel)


def bpe_round_trip(df: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None, table: int = TABLE, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text in one pass, and returns n_tokens, ids_sha256 and decoded_sha256, and the ids on request. A worker's table of words has table entries in each half.

    Null and empty texts have 0 tokens and the digest of the empty string; repeated rows each get a row, an empty table none. Kept columns with one of these names are replaced.
    """
    keep = ["doc_id"] if keep is None else keep

    def kernel(texts):
        t = merge_table(tokenizer, table)
        ids = t.encode_many(texts)
        more = {}
        if with_ids:
            place = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
            more["ids"] = pa.ListArray.from_arrays(pa.array(place, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        return {
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(t.decode(x).encode()).hexdigest() for x in ids], pa.string()),
        } | more

    return mapped(df, keep, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, kernel)
