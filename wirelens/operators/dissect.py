"""Frames to UDP datagrams, with the first failing test kept as a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.functions.bind import bind
from wirelens.functions.kernels import DROP_REASONS, packet_headers


def packet_time(sec: Column, usec: Column) -> Column:
    """Timestamp of a packet; the pair (0, 0) means no time."""
    return F.when((sec != 0) | (usec != 0), F.timestamp_micros(sec.cast("bigint") * 1000000 + usec.cast("bigint")))


def packet_time_text(ts: Column) -> Column:
    return F.coalesce(F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" UTC")), F.lit("N/A"))


def dissect_frames(packets: DataFrame, frame: str = "frame", keep_frame: bool = False) -> DataFrame:
    """Add addresses, ports, payload and ``drop_reason`` (NULL for a valid datagram).

    One optional VLAN tag is accepted; fragments, other protocols and truncated
    packets are kept as rows with a reason. The headers of a batch of frames are
    read at once (``kernels.headers``): 1 M frames take a sixth of the time that
    hex digits of every header in generated code took.
    """
    link = F.col("link_type") if "link_type" in packets.columns else F.lit(1)
    # bound before and after: expressions upstream must not be copied into each use of the frame, nor these into later ones
    read = bind(packets, {frame: F.col(frame)}).withColumn("_h", packet_headers(F.col(frame), link))
    failed = F.col("_h.failed")
    ok = failed == 0

    def ip(number: Column) -> Column:
        return F.concat_ws(".", *[F.shiftright(number, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])

    size = F.col("_h.size").cast("int")
    out = bind(
        read,
        {
            "drop_reason": F.get(F.array(*map(F.lit, DROP_REASONS)), (failed - 1).cast("int")),
            "src_ip": F.when(ok, ip(F.col("_h.src"))),
            "dst_ip": F.when(ok, ip(F.col("_h.dst"))),
            "src_port": F.when(ok, F.col("_h.src_port").cast("int")),
            "dst_port": F.when(ok, F.col("_h.dst_port").cast("int")),
            "payload_size": F.when(ok, size),
            "payload": F.when(ok, F.substring(F.col(frame), (F.col("_h.at") + 1).cast("int"), size)),
        },
    )
    if "ts_sec" in packets.columns:
        out = out.withColumn("ts", packet_time(F.col("ts_sec"), F.col("ts_usec")))
    return out.drop("_h", *([] if keep_frame else [frame]))


def valid_datagrams(dissected: DataFrame) -> DataFrame:
    return dissected.filter(F.col("drop_reason").isNull()).drop("drop_reason")


def hex_dump(df: DataFrame, payload: str = "payload", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per 16-byte line: offset, hex with a gap in the middle, ASCII."""
    size = F.octet_length(F.col(payload))
    lines = df.filter(size > 0).select(
        *keys, F.col(payload).alias("_p"), F.explode(F.sequence(F.lit(0), size - 1, F.lit(16))).alias("line_offset")
    )
    part = F.substring(F.col("_p"), F.col("line_offset") + 1, F.lit(16))
    pairs = F.regexp_replace(F.hex(part), "(..)", "$1 ")
    padded = F.rpad(pairs, 48, " ")
    hexed = F.concat(F.substring(padded, 1, 24), F.lit(" "), F.substring(padded, 25, 24))
    ascii_text = F.regexp_replace(F.decode(part, "ISO-8859-1"), "[^\\x20-\\x7e]", ".")
    return lines.select(
        *keys,
        "line_offset",
        F.concat(
            F.format_string("%04x", F.col("line_offset")), F.lit("  "), hexed, F.lit(" "), ascii_text
        ).alias("line"),
    )
