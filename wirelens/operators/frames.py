"""Ethernet/IPv4/UDP and TCP frames around a payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.functions.bytes import raw_of, int_hex, ones_complement, sum_words16

# Destination and source MAC (locally administered), EtherType IPv4.
ETHERNET = "020000000002" + "020000000001" + "0800"


def ip_hex(text: Column) -> Column:
    """Dotted IPv4 text as 8 hex digits; anything else as zeros."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    t = F.trim(text)
    parts = F.split(t, r"\.")
    digits = F.concat(*[int_hex(F.get(parts, F.lit(i)).try_cast("bigint"), 1) for i in range(4)])
    return F.when(t.rlike(rf"^{octet}(\.{octet}){{3}}$"), digits).otherwise(F.lit("00000000"))


def _halves(hex8: Column) -> Column:
    value = raw_of(hex8)
    return F.shiftright(value, 16) + value.bitwiseAND(F.lit(0xFFFF))


def _ipv4_hex(protocol: int, carried: Column, src: Column, dst: Column) -> Column:
    total = (carried + 20).bitwiseAND(F.lit(0xFFFF))
    fixed = 0x4500 + 0x4000 + (64 << 8 | protocol)
    check = ones_complement(total + fixed + _halves(src) + _halves(dst))
    return F.concat(
        F.lit("4500"),
        int_hex(total, 2),
        F.lit("0000" + "4000" + f"40{protocol:02X}"),
        int_hex(check, 2),
        src,
        dst,
    )


def _with_ips(df: DataFrame, src_ip: str, dst_ip: str) -> DataFrame:
    return df.withColumn("_src", ip_hex(F.col(src_ip))).withColumn("_dst", ip_hex(F.col(dst_ip)))


def udp_frames(
    df: DataFrame,
    payload: str = "payload",
    src_ip: str = "src_ip",
    src_port: str = "src_port",
    dst_ip: str = "dst_ip",
    dst_port: str = "dst_port",
    frame: str = "frame",
) -> DataFrame:
    """Add the frame; the UDP checksum is 0, the IPv4 checksum is computed."""
    carried = (F.octet_length(F.col(payload)).cast("bigint") + 8).bitwiseAND(F.lit(0xFFFF))
    staged = _with_ips(df, src_ip, dst_ip)
    head = F.concat(
        F.lit(ETHERNET),
        _ipv4_hex(17, carried, F.col("_src"), F.col("_dst")),
        int_hex(F.col(src_port), 2),
        int_hex(F.col(dst_port), 2),
        int_hex(carried, 2),
        F.lit("0000"),
    )
    return staged.withColumn(frame, F.concat(F.unhex(head), F.col(payload))).drop("_src", "_dst")


def tcp_frames(
    df: DataFrame,
    payload: str = "payload",
    src_ip: str = "src_ip",
    src_port: str = "src_port",
    dst_ip: str = "dst_ip",
    dst_port: str = "dst_port",
    frame: str = "frame",
) -> DataFrame:
    """Add the frame; sequence and acknowledgement 1, PSH|ACK, checksum computed."""
    carried = (F.octet_length(F.col(payload)).cast("bigint") + 20).bitwiseAND(F.lit(0xFFFF))
    staged = _with_ips(df, src_ip, dst_ip)
    src, dst = F.col("_src"), F.col("_dst")
    ports = F.concat(int_hex(F.col(src_port), 2), int_hex(F.col(dst_port), 2))
    control = "00000001" + "00000001" + "5018" + "FFFF"
    control_sum = 1 + 1 + 0x5018 + 0xFFFF
    # The pseudo header adds the addresses, the protocol number 6 and the segment length.
    total = _halves(src) + _halves(dst) + 6 + carried + _halves(ports) + control_sum + sum_words16(F.col(payload))
    head = F.concat(
        F.lit(ETHERNET),
        _ipv4_hex(6, carried, src, dst),
        ports,
        F.lit(control),
        int_hex(ones_complement(total), 2),
        F.lit("0000"),
    )
    return staged.withColumn(frame, F.concat(F.unhex(head), F.col(payload))).drop("_src", "_dst")
