"""The capture source on files made here."""

import struct

from fieldlore.plans import pipelines
from fieldlore.sources import pcap
from fieldlore.streaming import messages


def udp(data: bytes) -> bytes:
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 28 + len(data), 0, 0, 64, 17, 0, b"\x0a\0\0\1", b"\x0a\0\0\2")
    return b"\0" * 12 + b"\x08\0" + ip + struct.pack(">HHHH", 1, 2, 8 + len(data), 0) + data


def capture(frames, order="<", linktype=1):
    magic = {"<": b"\xd4\xc3\xb2\xa1", ">": b"\xa1\xb2\xc3\xd4"}[order]
    out = magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, linktype)
    for i, f in enumerate(frames):
        out += struct.pack(order + "4I", 1000 + i, 5, len(f), len(f)) + f
    return out


def test_capture(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture([udp(b"hello"), udp(b"") + b"\0" * 18, b"\xff" * 20])[:-3])
    (tmp_path / "b.pcap").write_bytes(capture([udp(b"world")], ">"))
    pcap.register(spark)
    df = spark.read.format("pcap").load(str(tmp_path))
    rows = df.orderBy("msg_id").collect()
    assert [bytes(r.data) for r in rows] == [b"hello", b"", b"world"]
    assert rows[0].ts.timestamp() == 1000.000005 and [r.seq for r in rows] == [0, 1, 0]
    segments = pipelines.segment(df, "4bytesfixed").orderBy("msg_id", "seg_no").collect()
    assert [bytes(r.bytes) for r in segments] == [b"hell", b"o", b"worl", b"d"]
    assert pipelines.field_types(pipelines.segment(df), 0.2, 1).count() > 0


def test_streams(spark, tmp_path):
    """A stream of message files: the first of each payload, and the last of each payload and hour."""
    rows = [(1, 1, "2026-01-01 00:00:00", b"a"), (2, 2, "2026-01-01 00:10:00", b"b"), (3, 3, "2026-01-01 00:20:00", b"a"), (4, 4, "2026-01-01 05:00:00", b"z")]
    df = spark.createDataFrame([(i, k, t, bytearray(d)) for i, k, t, d in rows], "msg_id bigint, seq bigint, ts string, data binary").selectExpr("msg_id", "seq", "timestamp(ts) AS ts", "data")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = {}
    for name, f, mode in (("first", messages.deduplicate, "append"), ("last", messages.last_of_window, "append")):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        found[name] = sorted(r.msg_id for r in spark.table(name).collect())
    assert found["first"] in ([1, 2, 4], [2, 3, 4]) and found["last"] == [2, 3]
