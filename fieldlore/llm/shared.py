"""The folder that driver and executors share, and small helpers on it.

Lineage is cut by tables written below ``spark.checkpoint.dir``. When that setting is absent (tests), a
folder of this machine is set as the checkpoint folder, which only a single-machine session may use. A table that a
returned frame reads stays there for whoever clears that folder; all others are deleted.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python, so that long texts keep a batch small.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


#: Keys that may be sent to every task, at most: each has over one part in so many of the rows. Rows that have no more keys than may be sent whole.
HOT, FEW = 1000, 20_000


def batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch may hold in this session; smaller bounds that it has stay.

    Spark reads both settings when a plan is run, which may be after an operator has returned its frame, so they are not set back.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; its own one only where none is set and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not jsc.isLocal():
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(f"file://{tempfile.gettempdir()}/checkpoints")
        base = jsc.getCheckpointDir().get()
    return base.rstrip("/")


def col(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(*names: str) -> list[str]:
    """Names that no table has by chance."""
    tail = uuid.uuid4().hex
    return [f"{n}_{tail}" for n in names]


def by_place(df: DataFrame) -> DataFrame:
    """df with plain names: Spark's Python functions take no columns with dots in their names."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def without(columns: list[str], *taken: str) -> list[str]:
    """Columns but those whose names an operator's own columns take."""
    own = {t.lower() for t in taken}
    return [c for c in columns if c.lower() not in own]


def size_of(df: DataFrame, least: int, bytes_each: int) -> int:
    """Parts to deal df into: least, or more where its files have more than bytes_each a part. Frames without known files count as small."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-n // bytes_each) if n < 1 << 60 else 0)


def lookup(rows: DataFrame, table: DataFrame, key: list[str], total: int, n: str = "n") -> DataFrame:
    """rows joined to a table with one row a key and the number n of rows that have it.

    Keys that hold more than one part in HOT of the total, HOT at most, are sent to every task, so that their rows stay where
    they are; the others are joined by a shuffle in which no key is hot. The table has no more rows than the total, so
    that up to FEW it is sent whole.
    """
    if total <= FEW:
        return rows.join(F.broadcast(table), key)
    often = table.where(F.col(n) * HOT > total)
    hot = F.broadcast(often)
    return rows.join(hot, key).union(rows.join(F.broadcast(often.select(*key)), key, "left_anti").join(table.where(F.col(n) * HOT <= total), key))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/fieldlore-{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns the table read back: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._fieldlore_path = path
    return out


def drop(spark: SparkSession, *tables) -> None:
    """Deletes tables made by save(), or paths; for those that no returned frame reads."""
    for t in tables:
        path = getattr(t, "_fieldlore_path", t)
        if isinstance(path, str):
            hp = spark._jvm.org.apache.hadoop.fs.Path(path)
            hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hp, True)


def make_dir(spark: SparkSession, name: str) -> str:
    """A new folder for files that executors write themselves."""
    path = scratch(spark, name)
    hp = spark._jvm.org.apache.hadoop.fs.Path(path)
    hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hp)
    return path


def plain(path: str) -> str | None:
    """The path for open(), or None when the store isn't a mounted file system."""
    u = urlparse(path)
    return u.path if u.scheme in ("", "file") else None


def put(path: str, data) -> None:
    """Writes a whole file under another name first, so that a retried task leaves one whole file."""
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    if local := plain(own):
        with open(local, "wb") as f:
            f.write(data)
        os.replace(local, plain(path))
    else:
        from pyarrow import fs

        store, p = fs.FileSystem.from_uri(own)
        with store.open_output_stream(p) as f:
            f.write(data)
        store.move(p, fs.FileSystem.from_uri(path)[1])


def opened_for(path: str):
    """A stream to a new file; in a store it goes out in parts as it is written."""
    if local := plain(path):
        return open(local, "wb", 1 << 20)
    from pyarrow import fs

    store, p = fs.FileSystem.from_uri(path)
    return store.open_output_stream(p)


def get(path: str, at: int = 0, n: int | None = None) -> bytes:
    """A file, or n bytes of it from a place on."""
    if local := plain(path):
        with open(local, "rb") as f:
            f.seek(at)
            return f.read(-1 if n is None else n)
    from pyarrow import fs

    store, p = fs.FileSystem.from_uri(path)
    with store.open_input_file(p) as f:
        f.seek(at)
        return f.read(n)


#: Bits of a sieve for each wanted key, about, and 32,768-bit pieces that it has at most (32 MB).
SIEVE_BITS, SIEVE_PIECES = 16, 8192


def wanted_rows(df: DataFrame, key: str, wanted: DataFrame, number: int) -> DataFrame:
    """Rows of df whose key is among those of wanted (one column of that name and type, each of number keys once).

    First through a sieve of one bit for each hash that a wanted key has, which every task gets and whose size is bounded, so that few of the
    other rows are shuffled; then exactly.
    """
    pieces = min(SIEVE_PIECES, max(1, number * SIEVE_BITS >> 15))
    piece, at, bits = fresh("piece", "at", "bits")
    hashed = F.xxhash64(col(key))
    with_place = lambda d: d.withColumns({piece: F.pmod(F.shiftright(hashed, 15), F.lit(pieces)), at: F.pmod(hashed, F.lit(1 << 15))})
    made = with_place(wanted).groupBy(piece).agg(F.bitmap_construct_agg(at).alias(bits))
    byte = F.conv(F.hex(F.substring(col(bits), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    some = with_place(df).join(F.broadcast(made), piece).where(F.call_function("shiftright", byte, F.pmod(F.col(at), F.lit(8)).cast("int")).bitwiseAND(1) == 1)
    # no semi-join: the optimizer would put that first
    return some.select(*map(col, df.columns)).join(wanted, key).select(*map(col, df.columns))
