"""Length-delimited binary records of token ids, with an offset index for shuffled reads.

A shard ``part-00000.rec`` is a run of frames: the length of the payload (8 bytes), the masked checksum
of that length (4), the payload, and the masked checksum of the payload (4), all little-endian. The payload
is the document id (8), the number of ids (4), the bytes of one id (1), and the ids, compressed by zstd.
``part-00000.idx`` has for each frame the document id, the frame's place in the shard and its number of
ids, 8 bytes each, so that a reader can fetch any frame without the others. Checksums are CRC-32, rotated
right by 15 bits and increased by a constant, so that a checksum over data that holds checksums stays useful.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlore.llm.bpe import merge_table
from fieldlore.llm.shared import batches, col, get, make_dir, opened_for, plain, put, size_of

MASK = 0xA282EAD8
#: Bytes of input (as stored) for each shard, about.
SHARD_BYTES = 64 << 20
PRESS, UNPRESS = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    """The payload of one sequence. A null id is stored as the smallest 64-bit integer."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return struct.pack("<qIB", -(1 << 63) if doc_id is None else doc_id, len(ids), width) + PRESS.compress(ids.astype(f"<u{width}").tobytes())


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, n, width = struct.unpack_from("<qIB", payload)
    data = UNPRESS.decompress(payload[13:], max_output_size=max(1, n * width))
    return None if doc_id == -(1 << 63) else doc_id, np.frombuffer(data, f"<u{width}").astype("<u4")


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def frames(data, at: int = 0, most: int | None = None) -> Iterator[bytes]:
    """Payloads from a place on, all or so many. A length or payload that doesn't fit its checksum raises ValueError."""
    data, left = memoryview(data), most
    while at < len(data) and left != 0:
        left = None if left is None else left - 1
        length = bytes(data[at : at + 8])
        if len(data) < at + 12 or struct.unpack_from("<I", data, at + 8)[0] != masked(length):
            raise ValueError(f"damaged length at byte {at}")
        n = struct.unpack("<Q", length)[0]
        payload = bytes(data[at + 12 : at + 12 + n])
        if len(data) < at + 16 + n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
            raise ValueError(f"damaged record at byte {at}")
        yield payload
        at += 16 + n


def read_index(path: str) -> np.ndarray:
    """Rows (document id, place of the frame, number of ids) of a shard."""
    return np.frombuffer(get(path), "<i8").reshape(-1, 3)


def read_record(path: str, place: int) -> tuple[int | None, np.ndarray]:
    """One sequence by its place from the index, without reading those before it: two ranges of the shard are fetched."""
    head = get(path, place, 12)
    return unpack(next(frames(head + get(path, place + 12, struct.unpack_from("<Q", head)[0] + 4))))


def shard_records(path: str, order: np.ndarray | None = None) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """(row of the index, document id, ids) of a shard's records by their places in the index, in its order or another one.

    A mounted shard is mapped; of another one, in its own order all is fetched at once, else each record's range alone. A record
    that isn't what the index says raises ValueError.
    """
    index = read_index(path.removesuffix("rec") + "idx")
    data = mapped(path) if plain(path) or order is None else None
    for k in range(len(index)) if order is None else order.tolist():
        key, place, n = index[k].tolist()
        doc_id, ids = read_record(path, place) if data is None else unpack(next(frames(data, place, 1)))
        if len(ids) != n or (-(1 << 63) if doc_id is None else doc_id) != key:
            raise ValueError(f"the index of {path} doesn't fit its record at byte {place}")
        yield k, doc_id, ids


def write_records(df: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", shards: int | None = None) -> tuple[str, list[tuple]]:
    """Encodes every whole text, appends end_id and writes shards in ascending order of the key.

    Returns the folder and one row for each shard that has records: (number, path, records, ids, ids
    before it). Shards are ranges of the key cut at approximate quantiles, so that each has about as many
    records; rows of equal key stay together and are ordered by their payload. Null keys come first, null
    texts have the end id only. Files appear under their name when whole, so that a retried task replaces
    its own file; an empty table has no shard.
    """
    spark = df.sparkSession
    batches(spark)
    n = shards or size_of(df, int(spark.conf.get("spark.sql.shuffle.partitions")), SHARD_BYTES)
    cuts = df.select(F.percentile_approx(col(key).cast("bigint"), [i / n for i in range(1, n)] or [0.5], max(10_000, 10 * n))).first()[0] or []
    cuts = np.unique(np.array(cuts, "i8"))
    folder, end = make_dir(spark, "records"), struct.pack("<I", end_id)

    def encode(parts):
        own = merge_table(tokenizer)
        for b in parts:
            keys, out = b.column(0).to_pylist(), []
            for k, ids in zip(keys, own.encode_many(b.column(1).to_pylist()), strict=True):
                out.append(pack(k, np.frombuffer(ids + end, "<u4")))
            shard = [-1 if k is None else int(s) for k, s in zip(keys, np.searchsorted(cuts, [k or 0 for k in keys], side="right"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([max(0, s) for s in shard], pa.int32()), pa.array(keys, pa.int64()), pa.array(out, pa.binary())], names=["shard", "k", "payload"])

    def write(parts):
        at, sink, done = -1, None, []
        for b in parts:
            for s, payload in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if s != at:
                    if sink:
                        done.append(sink.close())
                    at, sink = s, Shard(folder, s)
                sink.add(payload)
        if sink:
            done.append(sink.close())
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("ids", pa.int64())]))

    coded = df.select(col(key).cast("bigint").alias("k"), col(text).alias("t")).mapInArrow(encode, "shard int, k bigint, payload binary")
    dealt = coded.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", "k", "payload")
    # one row for each shard comes to the driver
    rows, before = [], 0
    for r in sorted(dealt.mapInArrow(write, "shard int, path string, records bigint, ids bigint").collect(), key=lambda r: r.shard):
        rows.append((r.shard, r.path, r.records, r.ids, before))
        before += r.ids
    return folder, rows


class Shard:
    """A shard being written, straight to a file: a temporary one where the store is mounted, else one of this attempt's own name."""

    def __init__(self, folder: str, number: int):
        own = uuid.uuid4().hex
        self.path = f"{folder}/part-{number:05d}.rec" if plain(folder) else f"{folder}/part-{number:05d}-{own}.rec"
        self.number, self.place, self.ids, self.index = number, 0, 0, []
        self.tmp = plain(f"{self.path}.{own}.tmp")
        self.out = opened_for(self.tmp or self.path)

    def add(self, payload: bytes) -> None:
        doc_id, n, _ = struct.unpack_from("<qIB", payload)
        self.index.append((doc_id, self.place, n))
        self.out.write(x := frame(payload))
        self.place += len(x)
        self.ids += n

    def close(self) -> dict:
        self.out.close()
        if self.tmp:
            os.replace(self.tmp, plain(self.path))
        put(self.path.removesuffix("rec") + "idx", np.array(self.index, "<i8").tobytes())
        return {"shard": self.number, "path": self.path, "records": len(self.index), "ids": self.ids}


def arrow_batches(rows: Iterator[tuple], names: list[str], batch: int) -> Iterator[pa.RecordBatch]:
    """Rows of 64-bit numbers, with an array of them in a column called ids."""
    held: list[tuple] = []

    def made():
        cols = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.list_(pa.int64()) if n == "ids" else pa.int64()) for n, c in zip(names, cols, strict=True)], names=names)

    for r in rows:
        held.append(r)
        if len(held) == batch:
            yield made()
            held = []
    if held:
        yield made()


def read_records(spark: SparkSession, manifest: list[tuple], batch: int = 1024, ids: bool = False) -> DataFrame:
    """Reads shards back by their indices: doc_id, start (ids before it in all shards), n_tokens, ids_crc32, and the ids on request.

    Damaged records, and ones that the index doesn't fit, raise ValueError. Without shards there are no rows.
    """
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids

    def rows_of(path, start):
        for _, doc_id, x in shard_records(path):
            yield doc_id, start, len(x), zlib.crc32(x.tobytes()), *([x.astype("i8")] * ids)
            start += len(x)

    def read(parts):
        for b in parts:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from arrow_batches(rows_of(path, start), names, batch)

    rows = spark.createDataFrame([(p, s) for _, p, _, _, s in manifest], "path string, start bigint")
    return rows.repartition(max(1, len(manifest))).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids)


def read_shuffled(spark: SparkSession, manifest: list[tuple], seed: int = 0, batch: int = 1024) -> DataFrame:
    """Every record once, in an order drawn anew for each seed: turn (0 and up), doc_id, n_tokens and ids, by byte ranges from the index.

    The shards are put in a drawn order, and so are a shard's records; both follow from the seed and the shard's number, so that a
    retried task reads alike. A partition is a shard, with its turns in order; partitions come in the order of their turns.
    """
    order = sorted(manifest, key=lambda m: zlib.crc32(struct.pack("<qq", seed, m[0])))
    before = np.concatenate([[0], np.cumsum([m[2] for m in order])]).tolist()

    def rows_of(number, path, records, at):
        drawn = np.random.default_rng([seed & 0xFFFFFFFF, number]).permutation(records)
        for k, (_, doc_id, x) in enumerate(shard_records(path, drawn)):
            yield at + k, doc_id, len(x), x.astype("i8")

    def read(parts):
        for b in parts:
            for r in b.to_pylist():
                yield from arrow_batches(rows_of(r["number"], r["path"], r["records"], r["at"]), ["turn", "doc_id", "n_tokens", "ids"], batch)

    rows = spark.createDataFrame([(m[0], m[1], m[2], a) for m, a in zip(order, before, strict=False)], "number int, path string, records bigint, at bigint")
    return rows.repartitionByRange(max(1, len(manifest)), "at").mapInArrow(read, "turn bigint, doc_id bigint, n_tokens bigint, ids array<bigint>")


def mapped(path: str):
    local = plain(path)
    return np.memmap(local, np.uint8, "r") if local and os.path.getsize(local) else get(path)
