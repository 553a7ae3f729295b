"""Capture files (pcap, pcapng) as packet tables, and back.

A capture has no index, and a packet's place and number depend on everything
before it. Files are therefore cut into byte ranges that are walked in
parallel: each range guesses its first record boundary, and a range is trusted
only when its start equals the end of the range before. Ranges that guessed
wrong are walked again from the true boundary on, until a later guess is met, so the result is
exact whatever the guesses were. Walks read record headers only; a range is
read once with its packets' bodies, when its number of packets is known.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from wirelens.functions.bind import bind
from wirelens.sources.work import written

RANGE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20

# Record and block limits, block types, magic numbers.
MAX_PACKET = 16 << 20
MAX_BLOCK = 64 << 20
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
PCAP_MAGIC = {
    bytes.fromhex("A1B2C3D4"): (">", False),
    bytes.fromhex("D4C3B2A1"): ("<", False),
    bytes.fromhex("A1B23C4D"): (">", True),
    bytes.fromhex("4D3CB2A1"): ("<", True),
}
SECTION_MAGIC = {bytes.fromhex("1A2B3C4D"): ">", bytes.fromhex("4D3C2B1A"): "<"}
ETHERNET = 1

SEGMENT = (
    "file string, part long, start long, byte_order string, stop long, stop_order string, "
    "format string, events string, error string, error_at long"
)
PACKET = "file string, packet_no long, ts_sec long, ts_usec int, link_type int, frame binary"


def capture_files(
    spark: SparkSession, path: str | list[str], max_bytes: int | None = None, rejected: bool = False
) -> DataFrame:
    """(path, length, reason): .pcap/.pcapng files that are not empty and under the cap.

    Only metadata is scanned. ``rejected=True`` also lists the others with a
    reason, except empty files, which the listing itself leaves out.
    """
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    )
    big = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    reason = (
        F.when(~F.lower("path").rlike(r"\.(pcap|pcapng)$"), "suffix")
        .when(F.col("length") <= 0, "empty")
        .when(big, "too_large")
    )
    out = found.withColumn("reason", reason)
    return out if rejected else out.filter("reason is null").drop("reason")


def _store_uri(path: str) -> str:
    """Spark's names of one object store in the form that the reader library knows."""
    return re.sub(r"^s3[an]://", "s3://", path)


def _open(path: str):
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return open(path, "rb", buffering=1 << 20)
    from pyarrow import fs

    store, key = fs.FileSystem.from_uri(_store_uri(path))
    return io.BufferedReader(store.open_input_file(key), 1 << 20)


def store_of(path: str):
    """File system and path of a folder or file, as the reader library has them."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(_store_uri(path))
    return fs.LocalFileSystem(), os.path.abspath(path)


class _Fault(Exception):
    def __init__(self, at: int, reason: str):
        super().__init__(reason)
        self.at, self.reason = at, reason


def _head(f) -> tuple[str, str, bool, int]:
    """(format, byte order, nanoseconds, link type) from the first bytes."""
    first = f.read(24)
    if len(first) < 4:
        raise _Fault(0, "too_small")
    if first[:4] == b"\x0a\x0d\x0d\x0a":
        if len(first) < 12:
            raise _Fault(0, "bad_section_header")
        order = SECTION_MAGIC.get(first[8:12])
        if order is None:
            raise _Fault(8, "bad_byte_order_magic")
        total = struct.unpack(order + "I", first[4:8])[0]
        if total < 28 or total > MAX_BLOCK:
            raise _Fault(4, "bad_section_length")
        return "PCAPNG", order, False, ETHERNET
    if len(first) < 24:
        raise _Fault(0, "bad_global_header")
    if first[:4] not in PCAP_MAGIC:
        raise _Fault(0, "bad_magic")
    order, nano = PCAP_MAGIC[first[:4]]
    return "PCAP", order, nano, struct.unpack(order + "I", first[20:24])[0]


def _pcap_records(f, order: str, at: int, limit: int, size: int, reach: int | None):
    """Yield (next position, header fields, first ``reach`` bytes of data) of records starting before ``limit``."""
    f.seek(at)
    while at < limit and at < size:
        head = f.read(16)
        if len(head) != 16:
            raise _Fault(at, "truncated_packet_header")
        sec, sub, caught, _ = struct.unpack(order + "4I", head)
        if caught == 0 or caught > MAX_PACKET:
            raise _Fault(at + 8, "bad_packet_size")
        if at + 16 + caught > size:
            raise _Fault(at + 16, "truncated_packet_data")
        data = f.read(caught if reach is None else min(reach, caught))
        if len(data) < caught:
            f.seek(caught - len(data), os.SEEK_CUR)
        at += 16 + caught
        yield at, (sec, sub), data


def _blocks(f, order: str, at: int, limit: int, size: int, reach: int | None):
    """Yield (next position, block type, byte order, first ``reach`` bytes of the body, position) of pcapng blocks."""
    f.seek(at)
    while at < limit and at < size:
        head = f.read(8)
        if len(head) != 8:
            raise _Fault(at, "truncated_block_header")
        kind, total = struct.unpack(order + "2I", head)
        if kind == SECTION:
            order = SECTION_MAGIC.get(f.peek(4)[:4], order)
            total = struct.unpack(order + "I", head[4:])[0]
        if total < 12 or total > MAX_BLOCK:
            raise _Fault(at + 4, "bad_block_length")
        if at + total > size:
            raise _Fault(at + 8, "truncated_block")
        content = f.read(total - 12 if reach is None or kind == INTERFACE else min(reach, total - 12))
        if len(content) < total - 12:
            f.seek(total - 12 - len(content), os.SEEK_CUR)
        # The first section header is accepted without comparing its trailer.
        if struct.unpack(order + "I", f.read(4))[0] != total and at > 0:
            raise _Fault(at, "block_length_mismatch")
        at += total
        yield at, kind, order, content, at - total


def _interface(order: str, body: bytes) -> tuple[int, int, int] | None:
    """(link type, base, exponent) of an interface block; ticks per second are base^exponent."""
    if len(body) < 8:
        return None
    link = struct.unpack(order + "H", body[:2])[0]
    base, exponent, at = 10, 6, 8
    while at + 4 <= len(body):
        code, length = struct.unpack(order + "2H", body[at : at + 4])
        at += 4
        if code == 0 or at + length > len(body):
            break
        if code == 9 and length >= 1:
            base, exponent = (2 if body[at] & 0x80 else 10), body[at] & 0x7F
        at += (length + 3) & ~3
    return link, base, exponent


def _plausible_pcap(f, order: str, at: int, size: int, hops: int = 12) -> bool:
    for _ in range(hops):
        if at == size:
            return True
        f.seek(at)
        head = f.read(16)
        if len(head) != 16:
            return False
        _, sub, caught, wire = struct.unpack(order + "4I", head)
        if not (0 < caught <= MAX_PACKET and sub < 1_000_000_000 and caught <= wire <= MAX_PACKET):
            return False
        at += 16 + caught
    return at <= size


def _plausible_blocks(f, order: str, at: int, size: int, hops: int = 4) -> bool:
    for _ in range(hops):
        if at == size:
            return True
        f.seek(at)
        head = f.read(12)
        if len(head) != 12:
            return False
        if head[:4] == b"\x0a\x0d\x0d\x0a":
            order = SECTION_MAGIC.get(head[8:], order)
        total = struct.unpack(order + "I", head[4:8])[0]
        if not 12 <= total <= MAX_BLOCK or at + total > size:
            return False
        f.seek(at + total - 4)
        if f.read(4) != head[4:8]:
            return False
        at += total
    return at <= size


def _guess(f, fmt: str, order: str, at: int, size: int) -> tuple[int | None, str]:
    """First offset, and its byte order, from which several records follow each other."""
    orders = [order] if fmt == "PCAP" else [order, "<" if order == ">" else ">"]
    test = _plausible_pcap if fmt == "PCAP" else _plausible_blocks
    # Blocks are padded to four bytes; a file that breaks this is repaired, not guessed.
    step = 1 if fmt == "PCAP" else 4
    for p in range(-(-at // step) * step, min(at + (1 << 17), size), step):
        for o in orders:
            if test(f, o, p, size):
                return p, o
    return None, order


def _walk(path: str, size: int, part: int, width: int, start: int | None, order: str | None) -> tuple:
    """Follow records from ``start`` (or a guess) to the end of a range."""
    fmt, events, begin, first = None, [], start, order
    try:
        with _open(path) as f:
            fmt, head_order, nano, link = _head(f)
            if part == 0:
                begin, first = (24 if fmt == "PCAP" else 0), head_order
            elif begin is None:
                begin, first = _guess(f, fmt, head_order, part * width, size)
                if begin is None:
                    return path, part, None, None, None, None, fmt, "[]", None, None
            limit, at, now = (part + 1) * width, begin, first
            if fmt == "PCAP":
                if part == 0:
                    events.append([0, first, link, nano])
                for at, _, _ in _pcap_records(f, first, at, limit, size, 0):
                    pass
            else:
                for at, kind, now, content, pos in _blocks(f, first, at, limit, size, 0):
                    if kind == SECTION:
                        events = [[pos, "S", now]]  # a section forgets what came before
                    elif kind == INTERFACE:
                        info = _interface(now, content)
                        if info is not None:
                            events.append([pos, "I", *info])
            return path, part, begin, first, at, now, fmt, json.dumps(events), None, None
    except _Fault as e:
        return path, part, begin, first, None, None, fmt, json.dumps(events), e.reason, e.at
    except OSError as e:
        return path, part, begin, first, None, None, fmt, "[]", f"unreadable: {e.strerror}", 0


#: Ranges whose results a task hands on at once.
RANGES_AT_ONCE = 256


def _walk_batches(width: int):
    columns = [c.split()[0] for c in SEGMENT.split(", ")]

    def run(batches):
        for pdf in batches:
            listed = list(pdf.itertuples(index=False))
            for at in range(0, len(listed), RANGES_AT_ONCE):
                rows = []
                for r in listed[at : at + RANGES_AT_ONCE]:
                    start = None if pd.isna(r.start) else int(r.start)
                    rows.append(_walk(r.path, int(r.length), int(r.part), width, start, r.byte_order))
                out = pd.DataFrame(rows, columns=columns)
                for c in ("start", "stop", "error_at"):
                    out[c] = out[c].astype("Int64")
                yield out

    return run


def spread_ranges(ranges: DataFrame, *by: str) -> DataFrame:
    """Ranges dealt to as many tasks as a shuffle has.

    The number is given as the table is small whatever the captures are: Spark
    would otherwise put all ranges, and so all reading, into one task. It deals by
    a hash of the columns, as rows that a join has dealt by the columns stay there.
    """
    return ranges.repartition(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*by))


def _repair_file(width: int):
    """Of one file's ranges in order those that began in the wrong place, walked from where the range before ends."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in SEGMENT.split(", ")]
        rows, stop, order = [], None, None
        for r in pdf.sort_values("part").itertuples(index=False):
            agreed = r.start == stop and r.byte_order == order
            row = tuple(getattr(r, c) for c in columns)
            if r.part and not agreed:
                row = _walk(r.file, int(r.length), int(r.part), width, int(stop), order)
            rows.append(row)
            stop, order = row[4], row[5]
            if row[8] is not None or stop is None or pd.isna(stop):
                break  # a fault ends the file
        out = pd.DataFrame(rows, columns=columns)
        for c in ("start", "stop", "error_at"):
            out[c] = out[c].astype("Int64")
        return out

    return run


def index_captures(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Agreed ranges of every file: (file, part, start, stop, format, events, error, error_at).

    ``events`` lists the interface blocks of a range from its last section on,
    which is all that later ranges need. The table has one small row per range.
    Files with a wrong guess are mended in one more job, whatever the number of
    wrong guesses: only their wrong ranges are walked again.
    """
    ranges = files.select(
        "path",
        "length",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / range_bytes))).alias("part"),
        F.lit(None).cast("long").alias("start"),
        F.lit(None).cast("string").alias("byte_order"),
    )
    spread = spread_ranges(ranges, "path", "part")
    segments = written(spread.mapInPandas(_walk_batches(range_bytes), SEGMENT), "index")
    lengths = files.select(F.col("path").alias("file"), "length")
    order = Window.partitionBy("file").orderBy("part")
    seen = segments.withColumns(
        {"_want": F.lag("stop").over(order), "_order": F.lag("stop_order").over(order), "_ended": F.lag("error").over(order).isNotNull()}
    )
    agreed = F.col("start").eqNullSafe(F.col("_want")) & F.col("byte_order").eqNullSafe(F.col("_order"))
    # A range that lies wholly inside the record of an earlier one starts past its own end.
    off = seen.filter((F.col("part") > 0) & ~F.col("_ended") & F.col("_want").isNotNull() & ~agreed)
    wrong = written(off.select("file").distinct(), "wrong")
    mended = segments.join(wrong, "file", "left_semi").join(lengths, "file").groupBy("file").applyInPandas(_repair_file(range_bytes), SEGMENT)
    segments = written(segments.join(wrong, "file", "left_anti").unionByName(mended), "index")
    ended = F.max(F.col("error").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return segments.withColumn("_dead", F.coalesce(ended, F.lit(0))).filter("_dead = 0").drop("_dead")


def capture_format(index: DataFrame) -> DataFrame:
    """(file, format, byte_order, nanoseconds, link_type) of readable files."""
    head = F.get(F.from_json("events", "array<array<string>>"), F.lit(0))
    classic = F.col("format") == "PCAP"
    return index.filter("part = 0 and format is not null").select(
        "file",
        "format",
        "byte_order",
        (classic & (F.get(head, F.lit(3)) == "true")).alias("nanoseconds"),
        F.when(classic, F.get(head, F.lit(2)).cast("int")).alias("link_type"),
    )


def capture_errors(index: DataFrame) -> DataFrame:
    """(file, position, reason) of the fault that ends a file."""
    return index.filter("error is not null").select(
        "file", F.col("error_at").alias("position"), F.col("error").alias("reason")
    )


def _state_before(fmt: str, listed) -> dict:
    """Byte order, interfaces and pcap header fields after the given events."""
    state = {"order": "<", "interfaces": [], "link": ETHERNET, "nano": False}
    for events in listed:
        for e in json.loads(events):
            if fmt == "PCAP":
                state.update(order=e[1], link=e[2], nano=e[3])
            elif e[1] == "S":
                state.update(order=e[2], interfaces=[])
            else:
                state["interfaces"].append(tuple(e[2:]))
    return state


def _packets(f, fmt: str, state: dict, start: int, stop: int, size: int, reach: int | None = None):
    """(sec, usec, link type, first ``reach`` bytes of the frame) of the packets a range emits."""
    if fmt == "PCAP":
        for _, (sec, sub), data in _pcap_records(f, state["order"], start, stop, size, reach):
            yield sec, (sub // 1000 if state["nano"] else sub), state["link"], data
        return
    interfaces = list(state["interfaces"])
    for at, kind, order, content, pos in _blocks(f, state["order"], start, stop, size, None if reach is None else reach + 20):
        held = at - pos - 12
        if kind == SECTION:
            interfaces = []
        elif kind == INTERFACE:
            info = _interface(order, content)
            if info is not None:
                interfaces.append(info)
        elif kind == ENHANCED and len(content) >= 20:
            which, high, low, caught = struct.unpack(order + "4I", content[:16])
            if which >= len(interfaces) or interfaces[which][0] != ETHERNET:
                continue
            if caught == 0 or caught > MAX_PACKET or held < 20 + caught:
                continue
            ticks = interfaces[which][1] ** interfaces[which][2]
            raw = (high << 32) | low
            sec, rest = divmod(raw, ticks)
            usec = (rest * 1_000_000 + ticks // 2) // ticks
            if usec >= 1_000_000:
                sec, usec = sec + 1, 0
            yield sec, usec, ETHERNET, content[20 : 20 + caught]
        elif kind == SIMPLE and len(content) >= 4:
            if interfaces and interfaces[0][0] != ETHERNET:
                continue
            caught = struct.unpack(order + "I", content[:4])[0]
            if caught == 0 or caught > MAX_PACKET or held < 4 + caught:
                continue
            yield 0, 0, ETHERNET, content[4 : 4 + caught]


def _range_packets(r, reach: int | None = None):
    state = _state_before(r.format, r.before)
    state["order"] = r.byte_order
    stop = int(r.stop) if not pd.isna(r.stop) else int(r.length)
    try:
        with _open(r.file) as f:
            yield from _packets(f, r.format, state, int(r.start), stop, int(r.length), reach)
    except _Fault:
        return  # reported by capture_errors; packets before the fault count


def _count_batches(batches):
    for pdf in batches:
        counts = [sum(1 for _ in _range_packets(r, 0)) for r in pdf.itertuples(index=False)]
        yield pdf[["file", "part"]].assign(packets=counts)


def _read_batches(batches):
    names = ["file", "packet_no", "ts_sec", "ts_usec", "link_type", "frame"]
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            rows, held, number = [], 0, int(r.first_no)
            for sec, usec, link, frame in _range_packets(r):
                rows.append((r.file, number, sec, usec, link, frame))
                number += 1
                held += len(frame)
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)


def earlier_ranges():
    return Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def usable_ranges(files: DataFrame, index: DataFrame) -> DataFrame:
    """Ranges that can be read by themselves: (file, part, start, stop, byte_order, format, length, before).

    ``before`` are the interface blocks that hold where the range starts.
    """
    lengths = files.select(F.col("path").alias("file"), "length")
    upto = earlier_ranges()
    usable = index.filter("start is not null and byte_order is not null and format is not null").join(lengths, "file")
    # Ranges are grouped by the section they start in: a range that opens a section
    # gives its blocks to the group after its own, so a range collects the few
    # interface blocks of its own section only.
    opens = ((F.col("format") == "PCAP") & (F.col("part") == 0)) | F.contains(F.col("events"), F.lit('"S"'))
    marked = usable.withColumn("_opens", opens.cast("int"))
    marked = marked.withColumn("_section", F.coalesce(F.sum("_opens").over(upto), F.lit(0)))
    given = marked.filter("events <> '[]'").select(
        "file", (F.col("_section") + F.col("_opens")).alias("_section"), "part", F.col("events").alias("_told")
    )
    needs = marked.withColumn("_told", F.lit(None).cast("string"))
    both = needs.unionByName(given, allowMissingColumns=True)
    inside = Window.partitionBy("file", "_section").orderBy("part", F.col("_told").isNotNull())
    earlier = F.collect_list("_told").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    own = (F.col("format") == "PCAP") & (F.col("part") == 0)  # a pcap header holds for its own range too
    return (
        both.withColumn("before", F.when(own, F.array("events")).otherwise(earlier))
        .filter("start is not null")
        .select("file", "part", "start", "stop", "byte_order", "format", "length", "before")
    )


def read_captures(files: DataFrame, index: DataFrame | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Packets of all files, numbered from 1 within each file."""
    index = index_captures(files, range_bytes) if index is None else index
    ready = usable_ranges(files, index)
    spread = spread_ranges(ready, "file", "part")
    counts = spread.mapInPandas(_count_batches, "file string, part long, packets long")
    numbered = counts.withColumn("first_no", F.coalesce(F.sum("packets").over(earlier_ranges()), F.lit(0)) + 1).drop("packets")
    work = spread_ranges(ready.join(numbered, ["file", "part"]), "file", "part")
    return work.mapInPandas(_read_batches, PACKET)


def read_pcap(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    return read_captures(capture_files(spark, path), range_bytes=range_bytes)


read_pcapng = read_pcap


# ------------------------------------------------------------------- writing


def packet_block_hex(micros, frame):
    """Enhanced packet block of a frame, as hex text built from columns."""
    from wirelens.functions.bytes import int_hex

    size = F.octet_length(frame).cast("bigint")
    pad = F.pmod(F.lit(4) - F.pmod(size, F.lit(4)), F.lit(4))
    total = int_hex(size + pad + 32, 4, True)
    high, low = F.shiftrightunsigned(micros, 32), micros.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.concat(
        F.lit("06000000"),
        total,
        F.lit("00000000"),
        int_hex(high, 4, True),
        int_hex(low, 4, True),
        int_hex(size, 4, True),
        int_hex(size, 4, True),
        F.hex(frame),
        F.repeat(F.lit("00"), pad.cast("int")),
        total,
    )


def packet_record_hex(micros, frame, little: bool = True, nano: bool = False):
    """Record of a frame in a classic capture, as hex text built from columns."""
    from wirelens.functions.bytes import int_hex

    size = F.octet_length(frame).cast("bigint")
    part = F.pmod(micros, F.lit(1_000_000)) * (1000 if nano else 1)
    numbers = [F.floor(micros / 1_000_000).cast("bigint"), part, size, size]
    return F.concat(*[int_hex(n, 4, little) for n in numbers], F.hex(frame))


def classic_head(little: bool = True, nano: bool = False) -> bytes:
    """Global header of a classic capture: version 2.4, Ethernet."""
    magic = next(m for m, kind in PCAP_MAGIC.items() if kind == ("<" if little else ">", nano))
    return magic + struct.pack(("<" if little else ">") + "2H4I", 2, 4, 0, 0, 262144, ETHERNET)


# Section header (version 1.0, unknown length) and Ethernet interface block.
CAPTURE_HEAD = struct.pack("<3I2H2II", SECTION, 28, 0x1A2B3C4D, 1, 0, 0xFFFFFFFF, 0xFFFFFFFF, 28)
CAPTURE_HEAD += struct.pack("<2I2H2I", INTERFACE, 20, ETHERNET, 0, 262144, 20)


class _Written(WriterCommitMessage):
    def __init__(self, temporary: str, final: str, part: int = 0):
        self.temporary, self.final, self.part = temporary, final, part


def _joined(column):
    """The bytes of a column's values, one after another; NULL has none."""
    import numpy as np
    import pyarrow as pa

    column = column.drop_null().cast(pa.large_binary())
    if not len(column):
        return b""
    _, ends, data = column.buffers()
    first, last = (int(np.frombuffer(ends, np.int64)[column.offset + k]) for k in (0, len(column)))
    return data.slice(first, last - first) if data is not None else b""


class _CaptureWriter(DataSourceArrowWriter):
    """One capture per task: written under a temporary name, renamed on commit.

    With ``one_file`` tasks write records only and the commit puts them behind
    one head, in the order of the partitions: one capture from many tasks.
    Names carry the write's own id, so a second write to a folder adds captures;
    an overwriting one removes the captures that were there once its own are complete.
    """

    def __init__(self, path: str, overwrite: bool, head: bytes = CAPTURE_HEAD, suffix: str = "pcapng", one_file: bool = False):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex[:12]
        self.head, self.suffix, self.one_file = head, suffix, one_file

    def _store(self):
        return store_of(self.path)

    def write(self, iterator):
        from pyspark import TaskContext

        store, root = self._store()
        store.create_dir(root)
        part = TaskContext.get().partitionId()
        temporary = f"{root}/_part-{part:05d}-{uuid.uuid4().hex}.tmp"
        wrote = False
        with store.open_output_stream(temporary) as out:
            if not self.one_file:
                out.write(self.head)
            for batch in iterator:
                records = _joined(batch.column(0))
                if len(records):
                    out.write(records)
                    wrote = True
        if not wrote:
            store.delete_file(temporary)
            return _Written("", "")
        return _Written(temporary, f"{root}/part-{part:05d}-{self.job}.{self.suffix}", part)

    def _together(self, store, root: str, parts: list[_Written]) -> _Written:
        """The tasks' records behind one head."""
        whole = _Written(f"{root}/_whole-{self.job}.tmp", f"{root}/part-00000-{self.job}.{self.suffix}")
        with store.open_output_stream(whole.temporary) as out:
            out.write(self.head)
            for m in sorted(parts, key=lambda m: m.part):
                with store.open_input_stream(m.temporary) as f:
                    while piece := f.read(BATCH_BYTES):
                        out.write(piece)
        return whole

    def commit(self, messages):
        from pyarrow import fs

        store, root = self._store()
        there = store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if self.overwrite else []
        parts = [m for m in messages if m is not None and m.temporary]
        for m in [self._together(store, root, parts)] if self.one_file and parts else parts:
            store.move(m.temporary, m.final)
        for f in there:
            if re.fullmatch(r"part-\d{5}(-[0-9a-f]{12})?\.pcap(ng)?", f.base_name):
                store.delete_file(f.path)
        for m in parts if self.one_file else []:
            store.delete_file(m.temporary)

    def abort(self, messages):
        store, _ = self._store()
        for m in messages:
            if m is not None and m.temporary:
                store.delete_file(m.temporary)


class CaptureSink(DataSource):
    """``df.write.format("wirelens_pcapng")``: one binary column of packet blocks."""

    @classmethod
    def name(cls):
        return "wirelens_pcapng"

    def schema(self):
        return "block binary"

    def writer(self, schema, overwrite):
        one_file = self.options.get("onefile") == "true"
        if "head" in self.options:
            return _CaptureWriter(self.options["path"], overwrite, bytes.fromhex(self.options["head"]), "pcap", one_file)
        return _CaptureWriter(self.options["path"], overwrite, one_file=one_file)


def write_capture(
    frames: DataFrame,
    path: str,
    ts: str = "ts",
    frame: str = "frame",
    mode: str = "append",
    classic: tuple[bool, bool] | None = None,
    one_file: bool = False,
) -> None:
    """Write frames as captures, one file per partition, or one in all with ``one_file``; ``mode`` is append or overwrite.

    The format is pcapng with microseconds, or with ``classic`` = (little-endian,
    nanoseconds) pcap. Serial records have no network framing; rows whose frame
    is NULL are skipped.
    """
    # bound, so that the filter doesn't copy the expressions that make the frame
    rows = bind(frames.select(F.coalesce(F.unix_micros(ts), F.lit(0).cast("bigint")).alias("micros"), F.col(frame).alias("frame")), {"frame": F.col("frame")})
    record = packet_block_hex(F.col("micros"), F.col("frame")) if classic is None else packet_record_hex(F.col("micros"), F.col("frame"), *classic)
    write_records(rows.filter("frame IS NOT NULL").select(F.unhex(record).alias("block")), path, mode, classic, one_file)


def write_records(
    blocks: DataFrame, path: str, mode: str = "append", classic: tuple[bool, bool] | None = (True, False), one_file: bool = False
) -> None:
    """Write the one column of ``blocks``, records as bytes, behind a capture's head; one file per partition, in its order.

    With ``one_file`` all partitions' records make one capture, in the
    partitions' order. Records that are NULL are skipped.
    """
    blocks.sparkSession.dataSource.register(CaptureSink)
    # the writer skips NULLs: a filter here would copy the record's deep expression
    writer = blocks.write.format("wirelens_pcapng").mode(mode)
    if one_file:
        writer = writer.option("onefile", "true")
    if classic is not None:
        writer = writer.option("head", classic_head(*classic).hex())
    writer.save(path)
