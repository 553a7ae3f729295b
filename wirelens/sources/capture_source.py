"""``spark.read.format("wirelens_capture")``: capture files as a data source, in batch and as a stream.

Batch. A sidecar index (``build_sidecar``) has a row for each byte range of a
capture: where its records begin, what holds there, the number of its first
packet, its first and last packet time and its UDP destination ports. The source
plans one partition for some ranges, drops the ranges that a pushed filter on
``ts``, ``dst_port``, ``packet_no`` or ``file`` rules out, and skips packets
inside a range that the same filters rule out. Packet numbers come from the
index, so they are those of the full read whatever is left out. Bodies are read
once: the index is made from headers.

Stream. Offsets are, for each file, the byte after its last whole record, the
number of packets so far and what a reader must know there (byte order and
interfaces of the current section). A capture that grows is read on from there,
also after a restart; the last record waits until it is whole. New files join as
they appear. A folder named ``connection=<id>`` gives its captures that
connection.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from wirelens.sources import captures as cap

SCHEMA = (
    "file string, packet_no long, ts_sec long, ts_usec int, link_type int, ts timestamp, "
    "src_port int, dst_port int, connection_id string, frame binary"
)
SIDECAR = (
    "file string, part long, start long, stop long, length long, byte_order string, format string, before array<string>, "
    "first_no long, packets long, first_us long, last_us long, ports array<int>"
)
_ARROW = pa.schema(
    [
        ("file", pa.string()),
        ("packet_no", pa.int64()),
        ("ts_sec", pa.int64()),
        ("ts_usec", pa.int32()),
        ("link_type", pa.int32()),
        ("ts", pa.timestamp("us", "UTC")),
        ("src_port", pa.int32()),
        ("dst_port", pa.int32()),
        ("connection_id", pa.string()),
        ("frame", pa.binary()),
    ]
)
#: Bytes of a frame that can hold what the ports are read from: Ethernet with a VLAN tag, the longest IPv4 header, UDP.
HEADERS = 86
#: Bytes of captures that one task reads.
TASK_BYTES = 64 << 20


def udp_ports(frame: bytes) -> tuple[int | None, int | None]:
    """Source and destination port as far as the headers tell; every valid datagram has them."""
    at = 18 if frame[12:14] in (b"\x81\x00", b"\x88\xa8") else 14
    if len(frame) < at + 20 or frame[at - 2 : at] != b"\x08\x00" or frame[at] >> 4 != 4 or frame[at + 9] != 17:
        return None, None
    udp = at + 4 * (frame[at] & 15)
    if len(frame) < udp + 4:
        return None, None
    return int.from_bytes(frame[udp : udp + 2]), int.from_bytes(frame[udp + 2 : udp + 4])


def _micros(sec: int, usec: int) -> int | None:
    """The pair (0, 0) means no time."""
    return sec * 1_000_000 + usec if sec or usec else None


# ------------------------------------------------------------------- sidecar


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            packets, first, last, ports = 0, None, None, set()
            for sec, usec, _, head in cap._range_packets(r, HEADERS):
                packets += 1
                us = _micros(sec, usec)
                if us is not None:
                    first = us if first is None or us < first else first
                    last = us if last is None or us > last else last
                port = udp_ports(head)[1]
                if port is not None:
                    ports.add(port)
            rows.append((r.file, r.part, packets, first, last, sorted(ports)))
        out = pd.DataFrame(rows, columns=["file", "part", "packets", "first_us", "last_us", "ports"])
        for c in ("first_us", "last_us"):
            out[c] = out[c].astype("Int64")
        yield out


def build_sidecar(spark: SparkSession, path: str | list[str], sidecar: str, range_bytes: int = cap.RANGE_BYTES) -> DataFrame:
    """Write the index of all captures under ``path`` to ``sidecar`` and return it. A row per range; bodies are not read."""
    files = cap.capture_files(spark, path)
    ready = cap.usable_ranges(files, cap.index_captures(files, range_bytes))
    spread = cap.spread_ranges(ready, "file", "part")
    told = spread.mapInPandas(_summaries, "file string, part long, packets long, first_us long, last_us long, ports array<int>")
    told = told.withColumn("first_no", F.coalesce(F.sum("packets").over(cap.earlier_ranges()), F.lit(0)) + 1)
    names = [c.split()[0] for c in SIDECAR.split(", ")]
    ready.join(told, ["file", "part"]).select(*names).write.mode("overwrite").parquet(sidecar)
    return spark.read.schema(SIDECAR).parquet(sidecar)


# ------------------------------------------------------------------- filters

_OPS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
_COMPARE = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "in": lambda a, b: a in b}


def _plain(value):
    """Times as microseconds."""
    if isinstance(value, datetime):
        value = value.replace(tzinfo=UTC) if value.tzinfo is None else value
        delta = value - datetime(1970, 1, 1, tzinfo=UTC)
        return (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds
    return value


def _conditions(filters) -> list[tuple[str, str, object]]:
    """(column, operator, value) of the filters that ranges can be told apart by."""
    out = []
    for f in filters:
        op = _OPS.get(type(f))
        if op and len(f.attribute) == 1 and f.attribute[0] in ("ts", "dst_port", "packet_no", "file"):
            out.append((f.attribute[0], op, frozenset(map(_plain, f.value)) if op == "in" else _plain(f.value)))
    return out


def _may_hold(low, high, op: str, value) -> bool:
    """Whether a number between ``low`` and ``high`` can fulfil the condition."""
    if low is None or value is None:
        return False
    if op == "in":
        return any(v is not None and low <= v <= high for v in value)
    return {"=": low <= value <= high, ">": high > value, ">=": high >= value, "<": low < value, "<=": low <= value}[op]


def _range_fits(r: dict, conditions) -> bool:
    for column, op, value in conditions:
        if column == "ts" and not _may_hold(r["first_us"], r["last_us"], op, value):
            return False
        if column == "packet_no" and not (r["packets"] and _may_hold(r["first_no"], r["first_no"] + r["packets"] - 1, op, value)):
            return False
        if column == "file" and not _COMPARE[op](r["file"], value):
            return False
        if column == "dst_port" and not any(_COMPARE[op](p, value) for p in r["ports"]):
            return False
    return True


# -------------------------------------------------------------------- reading


class _Ranges(InputPartition):
    def __init__(self, ranges: list[dict], conditions: list):
        super().__init__(len(ranges))
        self.ranges, self.conditions = ranges, conditions


def _connection(file: str) -> str | None:
    named = [p for p in file.split("/") if p.startswith("connection=")]
    return named[-1].partition("=")[2] if named else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


def _batches(packets: Iterator[tuple], conditions: list) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (file, number, connection, (sec, usec, link, frame)) that fulfil the conditions."""
    rows, held = [], 0
    for file, number, connection, (sec, usec, link, frame) in packets:
        us = _micros(sec, usec)
        src, dst = udp_ports(frame[:HEADERS])
        own = {"ts": us, "dst_port": dst, "packet_no": number, "file": file}
        if all(own[c] is not None and _COMPARE[op](own[c], v) for c, op, v in conditions):
            rows.append((file, number, sec, usec, link, us, src, dst, connection, frame))
            held += len(frame) + 64
            if held >= cap.BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
    if rows:
        yield _batch(rows)


class CaptureReader(DataSourceReader):
    """Ranges of the sidecar that the filters leave; the filters are applied again by Spark."""

    def __init__(self, options: dict):
        self.path, self.sidecar = options.get("path"), options.get("sidecar")
        if not self.sidecar:
            raise ValueError("option sidecar names the folder that build_sidecar has written")
        self.task_bytes = int(options.get("taskbytes") or TASK_BYTES)
        self.conditions: list = []

    def pushFilters(self, filters):
        self.conditions = _conditions(filters)
        return filters

    def partitions(self):
        from pyarrow import dataset

        store, root = cap.store_of(self.sidecar)
        # one row a range, and only of ranges whose time fits: the list that any file source plans by
        table = dataset.dataset(root, filesystem=store, format="parquet", exclude_invalid_files=True)
        where = None
        for column, op, value in self.conditions:
            if column == "ts" and op in (">", ">=", "="):
                where = (dataset.field("last_us") >= value) if where is None else where & (dataset.field("last_us") >= value)
            if column == "ts" and op in ("<", "<=", "="):
                where = (dataset.field("first_us") <= value) if where is None else where & (dataset.field("first_us") <= value)
        rows = [r for r in table.to_table(filter=where).to_pylist() if _range_fits(r, self.conditions)]
        rows.sort(key=lambda r: (r["file"], r["part"]))
        self._check(rows)
        parts, held = [[]], 0
        for r in rows:
            size = max(0, (r["stop"] if r["stop"] is not None else r["length"]) - r["start"])
            if parts[-1] and held + size > self.task_bytes:
                parts.append([])
                held = 0
            parts[-1].append({k: r[k] for k in ("file", "start", "stop", "length", "byte_order", "format", "before", "first_no")})
            held += size
        # without any partition Spark would read one that is None
        return [_Ranges(p, self.conditions) for p in parts]

    def _check(self, rows: list[dict]) -> None:
        """A capture that has changed since the index was made must not be read by it."""
        lengths = {r["file"]: r["length"] for r in rows}
        for file, length in lengths.items():
            store, key = cap.store_of(file)
            if store.get_file_info(key).size != length:
                raise ValueError(f"{file} is not as long as when its index was made; build the index again")

    def read(self, partition):
        def packets():
            for r in partition.ranges:
                connection = _connection(r["file"])
                for k, packet in enumerate(cap._range_packets(SimpleNamespace(**r))):
                    yield r["file"], r["first_no"] + k, connection, packet

        yield from _batches(packets(), partition.conditions)


# --------------------------------------------------------------------- stream


class _Stretch(InputPartition):
    def __init__(self, file: str, start: list, stop: int):
        super().__init__(file)
        self.file, self.start, self.stop = file, start, stop


class _Position:
    """Where a reader stands in a capture: byte, packets before it, and what holds there."""

    def __init__(self, at: int = 0, packets: int = 0, fmt: str | None = None, order: str = "<", link: int = cap.ETHERNET, nano: bool = False, interfaces=()):
        self.at, self.packets, self.fmt = at, packets, fmt
        self.order, self.link, self.nano, self.interfaces = order, link, nano, [tuple(i) for i in interfaces]

    def plain(self) -> list:
        return [self.at, self.packets, self.fmt, self.order, self.link, self.nano, [list(i) for i in self.interfaces]]

    def state(self) -> dict:
        return {"order": self.order, "interfaces": self.interfaces, "link": self.link, "nano": self.nano}


def advance(path: str, size: int, start: list, mark_bytes: int = TASK_BYTES, most: int | None = None) -> tuple[list[list], str | None]:
    """Positions after ``start``, one for every ``mark_bytes`` and one after the last whole record, and the fault met, if any.

    Reads headers only. A record that the file doesn't hold whole yet is left for later; it is no fault.
    """
    p, marks, fault = _Position(*start), [], None
    with cap._open(path) as f:
        try:
            if p.fmt is None:
                p.fmt, p.order, p.nano, p.link = cap._head(f)
                p.at = 24 if p.fmt == "PCAP" else 0
            limit, begun = (size if most is None else min(size, p.at + most)), p.at
            if p.fmt == "PCAP":
                for at, _, _ in cap._pcap_records(f, p.order, p.at, limit, size, 0):
                    p.at, p.packets = at, p.packets + 1
                    if p.at - begun >= mark_bytes:
                        marks.append(p.plain())
                        begun = p.at
            else:
                for at, kind, order, content, pos in cap._blocks(f, p.order, p.at, limit, size, 20):
                    p.packets += _counts(kind, order, content, at - pos - 12, p.interfaces if kind != cap.SECTION else [])
                    if kind == cap.SECTION:
                        p.interfaces = []
                    elif kind == cap.INTERFACE and (info := cap._interface(order, content)) is not None:
                        p.interfaces.append(info)
                    p.at, p.order = at, order
                    if p.at - begun >= mark_bytes:
                        marks.append(p.plain())
                        begun = p.at
        except cap._Fault as e:
            late = e.reason in ("too_small", "bad_global_header") or e.reason.startswith("truncated") or (e.reason == "bad_section_header")
            fault = None if late else e.reason
            if p.fmt is None:
                return [], fault
    if not marks or marks[-1][0] != p.at:
        marks.append(p.plain())
    return marks, fault


def _counts(kind: int, order: str, content: bytes, held: int, interfaces: list) -> int:
    """1 if the block is a packet that readers emit. ``content`` is its first 20 bytes, ``held`` its length."""
    import struct

    if kind == cap.ENHANCED and held >= 20:
        which, _, _, caught = struct.unpack(order + "4I", content[:16])
        known = which < len(interfaces) and interfaces[which][0] == cap.ETHERNET
        return int(known and 0 < caught <= cap.MAX_PACKET and held >= 20 + caught)
    if kind == cap.SIMPLE and held >= 4:
        caught = struct.unpack(order + "I", content[:4])[0]
        return int((not interfaces or interfaces[0][0] == cap.ETHERNET) and 0 < caught <= cap.MAX_PACKET and held >= 4 + caught)
    return 0


class CaptureStreamReader(DataSourceStreamReader):
    """Offsets: {file: {"marks": positions as JSON, "fault": reason}}; the last mark is where the file has been read to.

    Spark asks for the latest offset without saying where the stream stands, so
    positions are also kept in the folder of option ``positions``; without it a
    restarted stream walks the headers of its files again.
    """

    def __init__(self, options: dict):
        self.path, self.positions = options["path"], options.get("positions")
        self.mark_bytes = int(options.get("taskbytes") or TASK_BYTES)
        self.most = int(options["maxbytespertrigger"]) if options.get("maxbytespertrigger") else None
        self.known: dict | None = None

    def initialOffset(self):
        return {"files": "{}"}

    def _kept(self) -> dict:
        from pyarrow import fs

        if not self.positions:
            return {}
        store, root = cap.store_of(self.positions)
        name = f"{root}/positions.json"
        if store.get_file_info(name).type != fs.FileType.File:
            return {}
        with store.open_input_stream(name) as f:
            return json.loads(f.read())

    def _keep(self) -> None:
        if not self.positions:
            return
        store, root = cap.store_of(self.positions)
        store.create_dir(root)
        with store.open_output_stream(f"{root}/_positions.tmp") as f:
            f.write(json.dumps(self.known).encode())
        store.move(f"{root}/_positions.tmp", f"{root}/positions.json")

    def latestOffset(self):
        from pyarrow import fs

        if self.known is None:
            self.known = self._kept()
        fresh = dict(self.known)
        store, root = cap.store_of(self.path)
        listed = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        for info in sorted(listed, key=lambda i: i.path):
            if info.type != fs.FileType.File or not info.path.lower().endswith((".pcap", ".pcapng")):
                continue
            own = fresh.get(info.path) or {"marks": [], "fault": None}
            last = own["marks"][-1] if own["marks"] else _Position().plain()
            if own["fault"] or info.size <= last[0]:
                continue
            # a file that is met for the first time after a restart is walked whole: it may have been read before
            most = self.most if own["marks"] or self.positions else None
            marks, fault = advance(self._name(info.path), info.size, last, self.mark_bytes, most)
            if marks or fault:
                fresh[info.path] = {"marks": (marks if marks and marks[-1][0] > last[0] else own["marks"]), "fault": fault}
        if fresh != self.known:
            self.known = fresh
            self._keep()
        return {"files": json.dumps(self.known, sort_keys=True)}

    def _name(self, key: str) -> str:
        """A listed path in the form that opens it."""
        scheme, found, rest = self.path.partition("://")
        return f"{scheme}://{rest.split('/')[0]}/{key.lstrip('/')}" if found and not self.path.startswith("file:") else key

    def partitions(self, start, end):
        before, after, out = json.loads(start["files"]), json.loads(end["files"]), []
        for file, own in sorted(after.items()):
            old = before.get(file)
            at = old["marks"][-1] if old and old["marks"] else _Position().plain()
            for mark in own["marks"]:
                if mark[0] > at[0]:
                    out.append(_Stretch(self._name(file), at, mark[0]))
                    at = mark
        return out

    def read(self, partition):
        def packets():
            p, file = _Position(*partition.start), partition.file
            connection = _connection(file)
            with cap._open(file) as f:
                if p.fmt is None:
                    p.fmt, p.order, p.nano, p.link = cap._head(f)
                    p.at = 24 if p.fmt == "PCAP" else 0
                for k, packet in enumerate(cap._packets(f, p.fmt, p.state(), p.at, partition.stop, partition.stop)):
                    yield file, p.packets + 1 + k, connection, packet

        yield from _batches(packets(), [])


class CaptureSource(DataSource):
    @classmethod
    def name(cls):
        return "wirelens_capture"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return CaptureReader(self.options)

    def streamReader(self, schema):
        return CaptureStreamReader(self.options)


def register_captures(spark: SparkSession) -> None:
    """Make the source known to a session; sources in Python get filters only where the session allows it."""
    spark.dataSource.register(CaptureSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_indexed(spark: SparkSession, path: str, sidecar: str, range_bytes: int = cap.RANGE_BYTES, build: bool = True) -> DataFrame:
    """Packets of all captures under ``path`` by way of their index, which is made first unless ``build`` is off."""
    if build:
        build_sidecar(spark, path, sidecar, range_bytes)
    register_captures(spark)
    return spark.read.format("wirelens_capture").option("sidecar", sidecar).load(path)


def stream_captures(spark: SparkSession, path: str, positions: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """Packets of the captures under ``path`` as a stream that follows growing files; ``positions`` is a folder of its own for each query."""
    register_captures(spark)
    reader = spark.readStream.format("wirelens_capture")
    for name, value in (("positions", positions), ("maxbytespertrigger", max_bytes)):
        if value is not None:
            reader = reader.option(name, str(value))
    return reader.load(path)
