"""Language-model scoring with an n-gram trie in Elias-Fano levels.

Level 1 has the hashes of all training tokens in order; a token's number is its place there. A node of level k is the
number of its context (a node of level k - 1) beside the number of its last token, in the order of both. Pointers, a monotone
sequence, give where each context's successors begin. The successors' numbers are made monotone, too: to each is added the
last sum of the context before. So a node is looked for among the successors of its context alone, from one pointer to the next, as
its token's number relative to the sum that the context begins with. A level is cut into files by ranges of its order, so that the
successors of a very common context may fill several; workers map the files and search them by arrays of queries. Every n-gram of
the training texts is kept.

Probabilities are interpolated: P1(w) = (c + 0.1) / (N + 0.1 (V + 1)) and, for a context v,
P(w | v) = max(c(v w) - D, 0) / c(v) + D T(v) / c(v) * P(w | shorter v), T being the number of distinct successors, which
is the distance of two pointers. The first, discounted part is stored as a 16-bit step of its logarithm; the second needs
no table. Each document begins without context.

Each level is counted over all training texts: a task sorts what it has seen, and sends sorted, compressed runs to
the files' builders, which merge them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from fieldlore.llm import eliasfano as ef
from fieldlore.llm.shared import batches, by_place, col, make_dir, put, size_of, without
from fieldlore.llm.words import chunks, lower_hashes

#: Discount, the query's order, logarithms' step, entries that a task sorts at once, characters that are looked up at once.
DISCOUNT, ORDER, STEP, RUN, CHARS = 0.75, 3, 12 / 65535, 3_000_000, 6_000_000
#: Bytes of input (as stored) for each file of a level, about: what a task merges grows with it, and files with the input.
FILE_BYTES = 16 << 20
ADD = 0.1
#: The end of a text, as a hash that words don't get but by chance.
END = np.uint64(0xE0D0F7EC5AFE57AB)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words in lower-case ASCII, then the end), and where each text's begin and end."""
    words, place = lower_hashes(texts)
    n = np.diff(place)
    first = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(first[-1], END, "u8")
    own = np.ones(first[-1], bool)
    own[first[1:] - 1] = False
    out[own] = words
    return out, first


def squeeze(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run, as byte planes of its differences and its counts."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    planes = gaps.astype("<u8").view("u1").reshape(-1, 8).T.tobytes() + counts.astype("<u4").view("u1").reshape(-1, 4).T.tobytes()
    return len(keys).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes)


def unsqueeze(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=max(1, 12 * n)), "u1")
    gaps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(gaps, dtype="u8"), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel()


def total(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, "i8")
    return keys[at], np.add.reduceat(counts.astype("i8"), at) if len(at) else np.zeros(0, "i8")


def packed(context: np.ndarray, token: np.ndarray, width: int) -> np.ndarray | None:
    """Pairs as single numbers, or None where 64 bits don't hold them."""
    if len(context) and int(context.max()).bit_length() + width > 64:
        return None
    return context.astype("u8") << np.uint64(width) | token.astype("u8")


def distinct_pairs(context: np.ndarray, token: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order (contexts, tokens), and which of them each pair is."""
    keys = packed(context, token, width)
    if keys is not None:
        keys, back = np.unique(keys, return_inverse=True)
        return (keys >> np.uint64(width)).astype("i8"), (keys & np.uint64((1 << width) - 1)).astype("i8"), back
    order = np.lexsort((token, context))
    c, t = context[order], token[order]
    new = np.concatenate([[True], (c[1:] != c[:-1]) | (t[1:] != t[:-1])])
    back = np.empty(len(c), "i8")
    back[order] = np.cumsum(new) - 1
    return c[new], t[new], back


@dataclass
class Level:
    """One level's files: the pair (context, token) that each begins with, and its first node's number; contexts that begin a file with all their successors' number."""

    width: int
    paths: list[str] = field(default_factory=list)
    context: np.ndarray = field(default_factory=lambda: np.zeros(0, "i8"))
    token: np.ndarray = field(default_factory=lambda: np.zeros(0, "u8"))
    base: np.ndarray = field(default_factory=lambda: np.zeros(0, "i8"))
    size: int = 0
    total: int = 0
    edge: np.ndarray = field(default_factory=lambda: np.zeros(0, "i8"))
    after: np.ndarray = field(default_factory=lambda: np.zeros(0, "i8"))
    weight: tuple = ()

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Level 1: number (-1: none) and count of each of the sorted hashes."""
        where, count = np.full(len(keys), -1), np.zeros(len(keys), "i8")
        if not self.size:
            return where, count
        cut = np.concatenate([[0], np.searchsorted(keys, self.token[1:]), [len(keys)]])
        for i, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if z > a:
                f = opened(self.paths[i])
                at, hit = f.keys.lower_bound(keys[a:z])
                at, k = at[hit], np.flatnonzero(hit) + a
                where[k], count[k] = at + self.base[i], f.count[at]
        return where, count

    def look(self, context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, ...]:
        """Number (-1: none), count and discounted probability of each of the sorted distinct pairs, and how many distinct successors its context has."""
        n = len(context)
        where, count, part, after = np.full(n, -1), np.zeros(n, "i8"), np.zeros(n), np.zeros(n, "i8")
        if not self.size or not n:
            return where, count, part, after
        file = np.maximum(np.searchsorted(self.context, context, side="right") - 1, 0)
        # before the first token that a file has of a context, the file before it has them
        while (early := np.flatnonzero((file > 0) & (context == self.context[file]) & (token < self.token[file].astype("i8")))).size:
            file[early] -= 1
        cut = np.concatenate([[0], np.flatnonzero(np.diff(file)) + 1, [n]])
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            f = opened(self.paths[file[a]])
            new = np.concatenate([[True], context[a + 1 : z] != context[a : z - 1]])
            own, of = context[a:z][new] - f.low, np.cumsum(new) - 1
            inside = (own >= 0) & (own < len(f.pointers) - 1)
            own = np.where(inside, own, 0)
            first, last = (x.astype("i8") for x in f.pointers.get_two(own))
            last = np.where(inside, last, first)
            start, only = np.zeros(len(own), "u8"), np.zeros(len(own), "u8")
            after[a:z] = (last - first)[of]
            # most contexts have one successor, the value after the sum that they begin with
            one = (first > 0) & (last - first == 1)
            some = np.flatnonzero(one)
            start[some], only[some] = f.keys.get_two(first[some] - 1)
            some = np.flatnonzero((first > 0) & ~one)
            start[some] = f.keys.get(first[some] - 1)
            sums = start[of] + token[a:z].astype("u8")
            at, hit, rest = first[of], one[of] & (only[of] == sums), np.flatnonzero((~one & (last > first))[of])
            at[rest], hit[rest] = f.keys.lower_bound(sums[rest], first[of[rest]], last[of[rest]])
            at, k = at[hit], np.flatnonzero(hit) + a
            where[k], count[k] = at + self.base[file[a]], f.count[at]
            part[k] = 10.0 ** (-STEP * f.part[at].astype("f8"))
        at = np.minimum(np.searchsorted(self.edge, context), len(self.edge) - 1)
        hit = self.edge[at] == context
        after[hit] = self.after[at[hit]]
        return where, count, part, after


class File:
    def __init__(self, arrays: dict[str, np.ndarray]):
        pick = lambda p: ef.EliasFano({k[len(p) :]: v for k, v in arrays.items() if k.startswith(p)})
        self.keys, self.count = pick("k_"), arrays["count"]
        self.part = arrays.get("part")
        self.pointers = pick("p_") if "p_head" in arrays else None
        self.low = int(arrays["low"][0])


@lru_cache(maxsize=4096)
def opened(path: str) -> File:
    """A level's file, mapped once in each worker."""
    return File(ef.mapped(path))


def cut_points(weight: list[tuple[float, float]], n: int) -> np.ndarray:
    """Places that cut a numbering into n ranges of about equal weight; weight has (place, weight before it)."""
    place, before = (np.array(x, "f8") for x in zip(*weight, strict=True))
    return np.interp(np.arange(1, n) / n * before[-1], before, place)


def build_level(df: DataFrame, text: str, levels: list[Level], parts: int) -> Level:
    """Counts and writes the level after those given."""
    spark = df.sparkSession
    folder, depth = make_dir(spark, f"level{len(levels) + 1}"), len(levels)
    width = levels[0].size.bit_length() if levels else 64
    # a file's pairs are numbers relative to the context that its range begins with
    if levels:
        some = cut_points(levels[-1].weight, parts) if parts > 1 and levels[-1].weight else np.zeros(0)
        low = np.floor(some).astype("i8")
        cuts = np.unique(np.stack([np.append(0, low), np.append(0, ((some - low) * (1 << width)).astype("i8"))], 1), axis=0)
        spans = np.diff(np.append(cuts[:, 0], levels[-1].size)) + 1
        if int(spans.max()).bit_length() + width > 64:
            raise ValueError("the ranges of a level's files are too wide for 64 bits: more parts are needed")
    else:
        hashes = np.array([(i << 64) // parts for i in range(1, parts)], "u8")
    sent = spark.sparkContext.broadcast(levels)

    def count(batches_):
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            if not depth:
                keys, n = total(*map(np.concatenate, zip(*held, strict=True)))
                at = np.concatenate([[0], np.searchsorted(keys, hashes), [len(keys)]])
            else:
                context, token, n = map(np.concatenate, zip(*held, strict=True))
                context, token, back = distinct_pairs(context, token, width)
                n = np.bincount(back, n, len(context)).astype("i8")
                at = np.searchsorted(context, cuts[:, 0])
                for i in np.flatnonzero(cuts[:, 1]):
                    at[i] += np.searchsorted(token[at[i] : np.searchsorted(context, cuts[i, 0], side="right")], cuts[i, 1])
                at = np.append(at, len(context))
                keys = (context - np.repeat(cuts[:, 0], np.diff(at))).astype("u8") << np.uint64(width) | token.astype("u8")
            held.clear()
            rows = [(i, squeeze(keys[a:z], n[a:z])) for i, (a, z) in enumerate(zip(at[:-1], at[1:], strict=True)) if z > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["file", "run"])

        size = 0
        for texts in gathered(batches_):
            h, first = tokens(texts[0])
            if not depth:
                held.append(total(h))
            else:
                context, token, back = distinct_pairs(*grams(sent.value, h, first), width)
                held.append((context, token, np.bincount(back, minlength=len(context))))
            size += len(held[-1][0])
            if size > RUN:
                yield flush()
                size = 0
        if held:
            yield flush()

    def build(key, g):
        runs = [unsqueeze(r) for r in g.run]
        keys, n = total(np.concatenate([k for k, _ in runs]), np.concatenate([c for _, c in runs]))
        path, low, begin, ends = f"{folder}/part-{key[0]:05d}.ef", 0, (0, str(int(keys[0]))), (0, 0, 0, 0)
        arrays = {}
        if depth:
            context, token = (keys >> np.uint64(width)).astype("i8") + cuts[key[0], 0], keys & np.uint64((1 << width) - 1)
            low, begin = int(context[0]), (int(context[0]), str(int(token[0])))
            own, at = np.unique(context, return_index=True)
            stop = np.append(at[1:], len(keys))
            # pointers of all contexts from the first to the last, and the end
            arrays |= {f"p_{k}": v for k, v in ef.build(np.append(np.searchsorted(context, np.arange(low, int(context[-1]) + 1)), len(keys))).items()}
            # to a context's tokens the sum that the context before ends with is added
            before = np.concatenate([[0], np.cumsum(token[stop - 1], dtype="u8")])[:-1]
            keys = token + np.repeat(before, stop - at)
            c = np.repeat(counts_at(sent.value[-1], own), stop - at)
            arrays["part"] = np.clip(np.round(-np.log10((n - DISCOUNT) / c) / STEP), 0, 65535).astype("u2")
            ends = (int(own[0]), int(stop[0] - at[0]), int(own[-1]), int(stop[-1] - at[-1]))
        arrays |= {f"k_{k}": v for k, v in ef.build(keys).items()}
        arrays["count"] = n.astype("u4" if n.max() < 1 << 32 else "u8")
        arrays["low"] = np.array([low], "i8")
        put(path, ef.pack(arrays))
        # the next level's files are balanced by this: about how many successors a node has
        w = np.concatenate([[0], np.cumsum(n.astype("f8") ** 0.8)])
        marks = np.unique(np.clip(np.searchsorted(w, np.linspace(0, w[-1], 65)), 0, len(n)))
        marks = np.unique(np.concatenate([marks, np.maximum(marks - 1, 0)]))
        return pd.DataFrame({"file": [key[0]], "path": [path], "context": [begin[0]], "token": [begin[1]], "n": [len(keys)], "total": [int(n.sum())], "ends": [list(ends)], "place": [marks.astype("f8").tolist()], "weight": [w[marks].tolist()]})

    runs = df.select(col(text)).mapInArrow(count, "file int, run binary")
    # one row for each file comes to the driver
    made = sorted(runs.groupBy("file").applyInPandas(build, "file int, path string, context bigint, token string, n bigint, total bigint, ends array<bigint>, place array<double>, weight array<double>").collect(), key=lambda r: r.file)
    level = Level(width if depth else 0)
    level.paths = [r.path for r in made]
    level.context, level.token = np.array([r.context for r in made], "i8"), np.array([int(r.token) for r in made], "u8")
    level.base = np.concatenate([[0], np.cumsum([r.n for r in made])]).astype("i8")[:-1]
    level.size, level.total = sum(r.n for r in made), sum(r.total for r in made)
    before, weight, seen = 0.0, [], {}
    for r, b in zip(made, level.base, strict=True):
        weight += [(b + p, before + w) for p, w in zip(r.place, r.weight, strict=True)]
        before += r.weight[-1]
        for c, n in {r.ends[0]: r.ends[1], r.ends[2]: r.ends[3]}.items():
            seen[c] = seen.get(c, 0) + n
    if depth:
        level.edge = np.array(sorted(seen), "i8")
        level.after = np.array([seen[c] for c in level.edge.tolist()], "i8")
    level.weight = tuple(weight)
    return level


def counts_at(level: Level, numbers: np.ndarray) -> np.ndarray:
    """Counts of nodes by number (sorted)."""
    out = np.zeros(len(numbers), "i8")
    file = np.searchsorted(level.base, numbers, side="right") - 1
    for i in np.unique(file):
        k = file == i
        out[k] = opened(level.paths[i]).count[numbers[k] - level.base[i]]
    return out


def gathered(parts):
    """Arrow batches joined up to CHARS characters, as lists of columns: texts first."""
    held, size = None, 0
    for b in parts:
        cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
        for a, z in chunks(cols[0], CHARS):
            some = [c[a:z] for c in cols]
            n = sum(len(t) for t in some[0] if t)
            if held and size + n > CHARS:
                yield held
                held, size = None, 0
            held = some if held is None else [x + y for x, y in zip(held, some, strict=True)]
            size += n
    if held and held[0]:
        yield held


def walk(levels: list[Level], h: np.ndarray, first: np.ndarray):
    """For each level the numbers, counts and discounted probabilities of the n-grams that end at each token (-1 where there is none), and how many successors their contexts have."""
    distinct, back = np.unique(h, return_inverse=True)
    where, count = (x[back] for x in levels[0].find(distinct))
    out = [(where, count, None, None)]
    # a token that was never seen comes after all others
    number = np.where(where < 0, levels[0].size, where)
    begin = np.zeros(len(h), bool)
    begin[first[:-1]] = True
    for k, level in enumerate(levels[1:], 1):
        context = np.concatenate([[-1], out[k - 1][0][:-1]])
        context[begin] = -1
        ok = np.flatnonzero(context >= 0)
        got = np.full(len(h), -1), np.zeros(len(h), "i8"), np.zeros(len(h)), np.zeros(len(h), "i8")
        if len(ok):
            c, t, back = distinct_pairs(context[ok], number[ok], level.width)
            for x, y in zip(got, level.look(c, t), strict=True):
                x[ok] = y[back]
        out.append(got)
    return out


def grams(levels: list[Level], h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, token) of the next level's nodes in training texts."""
    out = walk(levels, h, first)
    context = np.concatenate([[-1], out[-1][0][:-1]])
    context[first[:-1]] = -1
    ok = context >= 0
    return context[ok], out[0][0][ok]


def train(df: DataFrame, text: str = "text", order: int = 2, parts: int | None = None) -> list[Level]:
    """The levels of a trie over all rows of df, with their whole texts however long.

    A null or empty text is an end alone, which counts; repeated rows count each time; of an empty table the levels are empty. A level has about
    parts files: as many as the session deals shuffles to, or more where the input has more than FILE_BYTES for each.
    """
    spark = df.sparkSession
    batches(spark)
    parts = parts or size_of(df, int(spark.conf.get("spark.sql.shuffle.partitions")), FILE_BYTES)
    levels: list[Level] = []
    for _ in range(order):
        levels.append(build_level(df, text, levels, parts))
    return levels


def probabilities(levels: list[Level], h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, base probability, model probability) of each token."""
    out = walk(levels, h, first)
    count = out[0][1]
    base = (count + ADD) / (levels[0].total + ADD * (levels[0].size + 1))
    p = base
    for k in range(1, len(levels)):
        seen = np.concatenate([[0], out[k - 1][1][:-1]])
        _, _, part, after = out[k]
        # a context without successors (the end) leaves the shorter one as it is
        at = np.flatnonzero(after > 0)
        p = p.copy()
        p[at] = part[at] + DISCOUNT * after[at] / seen[at] * p[at]
    return count, base, p


def score(df: DataFrame, levels: list[Level], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score (log10) of every whole text. Null and empty texts have one token, the end; repeated rows each get a row, an empty table none. Without training tokens the scores are 0. Kept columns with one of the five names are replaced."""
    batches(df.sparkSession)
    keep = without(["doc_id"] if keep is None else keep, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    sent = df.sparkSession.sparkContext.broadcast(levels)
    types = [df.schema[c].dataType for c in keep]
    kinds = [to_arrow_type(t) for t in types]
    fields = ", ".join([*(f"`{c}` {t.simpleString()}" for c, t in zip(keep, types, strict=True)), "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"])

    def run(parts):
        levels = sent.value
        for cols in gathered(parts):
            h, first = tokens(cols[0])
            n = np.diff(first)
            if levels[0].total:
                count, base, p = probabilities(levels, h, first)
                sums = [np.add.reduceat(np.log10(x), first[:-1]) for x in (base, p)]
                known = np.add.reduceat((count > 0).astype("i8"), first[:-1])
            else:
                sums, known = [np.zeros(len(n))] * 2, np.zeros(len(n), "i8")
            numbers = {"n_tokens": n, "n_known": known, "train_tokens": np.full(len(n), levels[0].total), "base_score": sums[0], "score": sums[1]}
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True)), *map(pa.array, numbers.values())], names=[*keep, *numbers])

    return by_place(df.select(col(text), *map(col, keep))).mapInArrow(run, fields)


