"""Token counts without token ids.

The distinct pre-tokens of all texts are gathered first; each is cut into pieces once, by the builder of the file that its hash
belongs to, and only the number of its pieces is written, beside the hash, in Elias-Fano order. Then each document's
pre-token frequencies are joined to that table: workers map its files, look up the pre-tokens that they haven't met lately by
arrays of hashes, and sum. So texts and (document, pre-token) pairs are never shuffled, distinct pre-tokens are: once for each task
that meets them. Distinct pre-tokens of one hash, if there are any, are kept aside in full.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from operator import mul

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from fieldlore.llm import eliasfano as ef
from fieldlore.llm.bpe import Recent, mapped, merge_table
from fieldlore.llm.shared import batches, col, make_dir, put, size_of

#: Distinct pre-tokens that a task holds before it sends them on, entries of each half of a worker's table, bytes of input (as stored) for each file.
SEEN, TABLE, FILE_BYTES = 400_000, 500_000, 64 << 20


def hashes(pieces: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces), "u8", len(pieces))


def file_of(h: np.ndarray, files: int) -> np.ndarray:
    """Files are ranges of the hash."""
    return ((h >> np.uint64(32)) * np.uint64(files) >> np.uint64(32)).astype("i4")


def bundle(pieces: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, pieces), "<u4", len(pieces))
    return len(pieces).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(sizes.tobytes() + b"".join(pieces))


def unbundle(blob: bytes) -> list[bytes]:
    n, data = int.from_bytes(blob[:8], "little"), zstandard.ZstdDecompressor().decompress(blob[8:])
    at = 4 * n + np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u4", n), dtype="i8")])
    return [data[a:z] for a, z in zip(at.tolist(), at[1:].tolist(), strict=False)]


@dataclass(frozen=True)
class PieceTable:
    """Files of (hash, number of pieces) by ranges of the hash (None for a range without any), and pre-tokens whose hash isn't theirs alone."""

    paths: tuple[str | None, ...]
    odd: tuple[tuple[bytes, int], ...]


def piece_table(df: DataFrame, tokenizer: str, text: str = "text", files: int | None = None) -> PieceTable:
    """The number of pieces of each distinct pre-token of all rows. Null and empty texts have none; an empty table gives an empty one."""
    spark = df.sparkSession
    batches(spark)
    files = files or size_of(df, int(spark.conf.get("spark.sql.shuffle.partitions")), FILE_BYTES)
    folder = make_dir(spark, "pieces")

    def gather(parts):
        own, seen, fresh = merge_table(tokenizer), set(), []

        def flush():
            held = [p.encode() for p in fresh]
            h = hashes(held)
            order = np.argsort(h)
            cut = np.searchsorted(file_of(h[order], files), np.arange(files + 1))
            rows = [(k, bundle([held[i] for i in order[a:z].tolist()])) for k, (a, z) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if z > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["file", "run"])

        for b in parts:
            new = set()
            for t in b.column(0).to_pylist():
                new.update(own.pre_tokens(t)[0])
            new -= seen
            fresh += new
            seen |= new
            if len(seen) > SEEN:
                yield flush()
                seen, fresh = set(), []
        if fresh:
            yield flush()

    def build(key, g):
        pieces = sorted(set().union(*map(unbundle, g.run)))
        h, n = hashes(pieces), np.array(merge_table(tokenizer).count_pieces([p.decode() for p in pieces]), "i8")
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        twice = np.zeros(len(h), bool)
        twice[1:] |= h[1:] == h[:-1]
        twice[:-1] |= h[1:] == h[:-1]
        path = f"{folder}/part-{key[0]:05d}.ef"
        put(path, ef.pack({f"k_{k}": v for k, v in ef.build(h[~twice]).items()} | {"n": n[~twice].astype("u2" if n.max() < 1 << 16 else "u8")}))
        odd = [(pieces[i], int(n[k])) for k, i in enumerate(order.tolist()) if twice[k]]
        return pd.DataFrame({"file": [key[0]], "path": [path], "odd": [[p for p, _ in odd]], "n": [[c for _, c in odd]]})

    runs = df.select(col(text)).mapInArrow(gather, "file int, run binary")
    # one row for each file comes to the driver
    made = {r.file: r for r in runs.groupBy("file").applyInPandas(build, "file int, path string, odd array<binary>, n array<bigint>").collect()}
    odd = tuple((bytes(p), c) for r in made.values() for p, c in zip(r.odd, r.n, strict=True))
    return PieceTable(tuple(made[k].path if k in made else None for k in range(files)), odd)


class Counts:
    """A worker's view of a piece table, with what it has looked up lately."""

    def __init__(self, table: PieceTable, tokenizer: str):
        self.table, self.own, self.odd = table, merge_table(tokenizer), dict(table.odd)
        self.known = Recent(lambda p: int(self.look([p])[0]), TABLE)

    def look(self, pieces: list[str]) -> np.ndarray:
        """Number of pieces of each pre-token, from the files."""
        data = [p.encode() for p in pieces]
        h = hashes(data)
        order = np.argsort(h)
        out, file = np.zeros(len(h), "i8"), file_of(h[order], len(self.table.paths))
        cut = np.concatenate([[0], np.flatnonzero(np.diff(file)) + 1, [len(h)]])
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if z > a and (path := self.table.paths[file[a]]):
                keys, n = opened(path)
                at, hit = keys.lower_bound(h[order[a:z]])
                out[order[a:z][hit]] = n[at[hit]]
        for p, n in self.odd.items():
            out[[k for k, x in enumerate(data) if x == p]] = n
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        freqs, known = [], self.known
        for t in texts:
            pieces, special = self.own.pre_tokens(t)
            freqs.append((Counter(pieces), special))
        new = {p for f, _ in freqs for p in f if p not in known}
        if new:
            again = {p: known.old[p] for p in new if p in known.old}
            rest = [p for p in new if p not in again]
            known.add(again | dict(zip(rest, self.look(rest).tolist(), strict=True)))
        look = known.__getitem__
        return [special + sum(map(mul, map(look, f), f.values())) for f, special in freqs]


@lru_cache(maxsize=4096)
def opened(path: str) -> tuple[ef.EliasFano, np.ndarray]:
    a = ef.mapped(path)
    return ef.EliasFano({k[2:]: v for k, v in a.items() if k.startswith("k_")}), a["n"]


@lru_cache(maxsize=2)
def counts_of(table: PieceTable, tokenizer: str) -> Counts:
    return Counts(table, tokenizer)


def token_counts(df: DataFrame, tokenizer: str, limit: int = 1024, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """n_bytes, n_tokens and over_limit of every whole text.

    Null and empty texts have 0 bytes and 0 tokens; special strings inside texts are one token each; repeated rows each get a row; an empty
    table has none. Kept columns with one of the three names are replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(piece_table(df, tokenizer, text))

    def kernel(texts):
        n = counts_of(sent.value, tokenizer).count(texts)
        return {
            "n_bytes": pa.array([len(x.encode()) if x else 0 for x in texts], pa.int64()),
            "n_tokens": pa.array(n, pa.int64()),
            "over_limit": pa.array([x > limit for x in n], pa.bool_()),
        }

    return mapped(df, ["doc_id"] if keep is None else keep, text, "n_bytes bigint, n_tokens bigint, over_limit boolean", kernel)
