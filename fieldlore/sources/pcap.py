"""Packet captures as a Spark data source: spark.read.format("pcap").load(path).

Classic capture files of either byte order, with micro- or nanosecond stamps; one partition for each file, read as a stream of
records. Columns are (msg_id, seq, ts, linktype, raw, data): data is the payload above Ethernet (or raw IP), IPv4 or IPv6, and UDP or TCP;
a frame of another make keeps its raw bytes as data. A truncated last record is left out.
"""

from __future__ import annotations

import glob
import os
import struct
from datetime import UTC, datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the capture format: magic numbers, with byte order and stamps a second; link types.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
ETHERNET, RAW_IP = 1, 101
SCHEMA = "msg_id bigint, seq bigint, ts timestamp, linktype int, raw binary, data binary"


def payload(raw: bytes, linktype: int) -> bytes:
    """The application's bytes of a frame, or all of it where a layer isn't known or cut short."""
    at = {ETHERNET: 14, RAW_IP: 0}.get(linktype)
    if at is None or len(raw) <= at:
        return raw
    if linktype == ETHERNET:
        kind = raw[12:14]
        while kind == b"\x81\x00" and len(raw) > at + 4:
            kind, at = raw[at + 2 : at + 4], at + 4
        if kind not in (b"\x08\x00", b"\x86\xdd"):
            return raw
    version, end = raw[at] >> 4, len(raw)
    if version == 4 and len(raw) >= at + 20:
        protocol, end = raw[at + 9], min(end, at + struct.unpack_from(">H", raw, at + 2)[0])
        at += 4 * (raw[at] & 15)
    elif version == 6 and len(raw) >= at + 40:
        protocol, end = raw[at + 6], min(end, at + 40 + struct.unpack_from(">H", raw, at + 4)[0])
        at += 40
    else:
        return raw
    if protocol == 17 and end >= at + 8:
        return raw[at + 8 : end]
    if protocol == 6 and end >= at + 20:
        return raw[at + 4 * (raw[at + 12] >> 4) : end]
    return raw[at:end]


def records(path: str):
    """(seconds, nanoseconds, link type, frame) of each record of a file."""
    with open(path, "rb") as f:
        head = f.read(24)
        if head[:4] not in MAGIC or len(head) < 24:
            raise ValueError(f"{path} is no capture file")
        order, units = MAGIC[head[:4]]
        linktype = struct.unpack(order + "I", head[20:24])[0] & 0xFFFF
        while len(h := f.read(16)) == 16:
            seconds, part, n, _ = struct.unpack(order + "4I", h)
            raw = f.read(n)
            if len(raw) < n:
                return
            yield seconds, part * (10**9 // units), linktype, raw


class PcapReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        files = sorted(glob.glob(os.path.join(self.path, "*.pcap")) if os.path.isdir(self.path) else glob.glob(self.path))
        return [InputPartition((i, f)) for i, f in enumerate(files)]

    def read(self, partition):
        if partition is None:
            return
        number, path = partition.value
        for seq, (s, ns, kind, raw) in enumerate(records(path)):
            yield (number << 32) + seq, seq, datetime.fromtimestamp(s, UTC) + timedelta(microseconds=ns // 1000), kind, raw, payload(raw, kind)


class PcapDataSource(DataSource):
    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PcapReader(self.options["path"])


def register(spark) -> None:
    spark.dataSource.register(PcapDataSource)
