"""Byte folds over whole Arrow buffers: all rows of a batch at once, no loop over rows.

A binary column arrives as one buffer of bytes and a list of offsets. A fold over
[start, stop) of every row is a fold over segments of that buffer. Used where a
range's length is known only at run time; short fixed ranges are generated code
in ``bytes``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _buffer(data: pa.Array):
    """Bytes of all rows, and where each row begins and ends in them."""
    import numpy as np

    wide = pa.types.is_large_binary(data.type)
    _, offsets, values = data.buffers()
    width = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, width, len(data) + 1, data.offset * np.dtype(width).itemsize).astype(np.int64)
    raw = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return raw, at[:-1], at[1:]


def fold(operation: str, data: pa.Array, start: pa.Array, stop: pa.Array) -> pa.Array:
    """XOR or sum of the bytes [start, stop) of every row, cut to the row; NULL where one of the three is."""
    import numpy as np

    if not len(data):
        return pa.array([], pa.int64())
    raw, first, last = _buffer(data)
    missing = np.asarray(data.is_null()) | np.asarray(start.is_null()) | np.asarray(stop.is_null())
    begin, end = (np.asarray(x.fill_null(0).cast(pa.int64())) for x in (start, stop))
    lo = np.minimum(first + np.maximum(begin, 0), last)
    hi = np.maximum(np.minimum(first + end, last), lo)
    out = np.zeros(len(data), np.int64)
    some = np.flatnonzero((hi > lo) & ~missing)
    if len(some):
        # pairs of segments: the wanted one, and what lies between it and the next
        lo, hi = lo[some], hi[some]
        edges = np.stack([lo, hi], axis=1).ravel()
        if edges[-1] == len(raw):
            edges = edges[:-1]
        kind = np.bitwise_xor if operation == "xor" else np.add
        out[some] = kind.reduceat(raw, edges, dtype=np.uint8 if operation == "xor" else np.int64)[::2]
    return pa.array(out, mask=missing)


def _folding(operation: str):
    def run(data: pa.Array, start: pa.Array, stop: pa.Array) -> pa.Array:
        return fold(operation, data, start, stop)

    return F.arrow_udf(run, "long")


def folded(operation: str, payload: Column, start: Column, stop: Column) -> Column:
    """``fold`` as a column. It cannot stand inside a lambda."""
    return _folding(operation)(payload, start.cast("long"), stop.cast("long"))


#: Tests of a packet in order; a datagram fails none.
DROP_REASONS = (
    "link_type", "short_ethernet", "short_vlan", "not_ipv4", "short_ipv4", "ip_version", "ip_header_length", "truncated_ip_header",
    "ip_total_length", "truncated_ip", "fragment", "not_udp", "truncated_udp_header", "udp_length", "truncated_udp",
)
HEADER_FIELDS = pa.struct([(n, pa.int64()) for n in ("failed", "src", "dst", "src_port", "dst_port", "at", "size")])
#: Bytes behind the last frame, so that every header read is inside the buffer.
MARGIN = 96


def headers(frame: pa.Array, link: pa.Array) -> pa.Array:
    """Ethernet, IPv4 and UDP headers of all frames: the first failed test (from 1, 0 for none), addresses, ports, payload's place and size.

    Sizes are tested before the values behind them, so what a short frame's
    reads find beyond its end is never used.
    """
    import numpy as np

    if not len(frame):
        return pa.array([], HEADER_FIELDS)
    raw, first, last = _buffer(frame)
    raw = np.append(raw, np.zeros(MARGIN, np.uint8))
    missing = np.asarray(frame.is_null())
    size = last - first

    def byte(at):
        return raw[first + at].astype(np.int64)

    def number(at, count=2):
        total = byte(at)
        for k in range(1, count):
            total = total << 8 | byte(at + k)
        return total

    kind = number(12)
    vlan = (kind == 0x8100) | (kind == 0x88A8)
    net = np.where(vlan, 18, 14)
    kind = np.where(vlan, number(16), kind)
    version = byte(net)
    ihl = (version & 15) * 4
    total, udp = number(net + 2), net + ihl
    length = number(udp + 4)
    end = udp + length
    tests = [
        np.asarray(link.fill_null(0)) != 1, size < 14, vlan & (size < 18), kind != 0x0800, size < net + 20, version >> 4 != 4, ihl < 20,
        size < udp, total < ihl + 8, size < net + total, number(net + 6) & 0x3FFF != 0, byte(net + 9) != 17, size < udp + 8, length < 8,
        (end > net + total) | (end > size),
    ]
    failed = np.select(tests, range(1, len(tests) + 1), 0)
    values = [failed, number(net + 12, 4), number(net + 16, 4), number(udp), number(udp + 2), udp + 8, length - 8]
    return pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in values], fields=list(HEADER_FIELDS), mask=pa.array(missing))


def packet_headers(frame: Column, link: Column) -> Column:
    return F.arrow_udf(headers, "struct<failed:bigint,src:bigint,dst:bigint,src_port:bigint,dst_port:bigint,at:bigint,size:bigint>")(frame, link.cast("long"))
