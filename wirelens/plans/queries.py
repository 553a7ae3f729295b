"""Registered queries: each runs an operator over whole driver tables, with its SQL check.

Inputs are encoded from the tables; the SQL works on the raw tables and never
on our encoding, so a decoded result must equal the original columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelens.functions import bits as fb
from wirelens.functions import bytes as by
from wirelens.functions import sentences as st
from wirelens.functions import text as tx
from wirelens.functions.bind import bind
from wirelens.operators import decode, dissect, encode, icd, nmea, quality, route, schedule, summary, verify
from wirelens.operators.frames import tcp_frames, udp_frames
from wirelens.operators.reframe import reframe
from wirelens.operators.scan import running, values_at
from wirelens.plans import wire_events as we
from wirelens.plans.definitions import messages_from_catalog
from wirelens.plans.model import Field, Message
from wirelens.sources.capture_source import read_indexed, stream_captures
from wirelens.sources.captures import (
    capture_errors,
    capture_files,
    capture_format,
    index_captures,
    packet_record_hex,
    read_captures,
    read_pcapng,
    write_capture,
    write_records,
)
from wirelens.sources.catalog import parse_catalog, parse_field_catalog, read_field_sheets, sheets_by_header
from wirelens.sources.documents import read_icd_tables
from wirelens.sources.nmea_registry import nmea_registry
from wirelens.sources.work import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TYPE_ID = "list_position(['click','view','purchase','signup','error'], event_type)"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def listed(sql: str) -> str:
    """Rule counts without the rules that nothing breaks."""
    return f"SELECT * FROM ({sql}) WHERE violations > 0"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    datagrams = dissect.valid_datagrams(dissect.dissect_frames(we.event_frames(we.events(spark, sf))))
    return route.route(datagrams, we.event_messages())


# ------------------------------------------------------------------ decoding


@query(
    f"""SELECT event_id, user_id, event_type AS message, CAST({TYPE_ID} AS BIGINT) AS msg_id,
    CAST(round(value * 100) AS DOUBLE) * CAST(0.01 AS DOUBLE) AS value, epoch_us(ts) AS ts_us FROM events"""
)
def decode_events(spark, sf):
    """Frames to datagrams to messages to typed columns; the five types share one layout."""
    layout = Message("event", 0, 24, we.BASE_FIELDS)
    rows = _routed(spark, sf).withColumnRenamed("message", "type")
    out = decode.decode_fields(rows, layout, values_only=True, keep=("type",))
    return out.select("event_id", "user_id", F.col("type").alias("message"), "msg_id", "value", "ts_us")


@query(
    f"""WITH e AS (SELECT event_id, event_type, user_id, round(value * 100) AS cents, epoch_us(ts) AS us,
        {TYPE_ID} AS id FROM events)
    SELECT event_id, 'sync' AS field, CAST(43605 AS DOUBLE) AS value, '43605' AS text FROM e
    UNION ALL SELECT event_id, 'msg_id', id, CAST(id AS VARCHAR) FROM e
    UNION ALL SELECT event_id, 'event_id', event_id, CAST(event_id AS VARCHAR) FROM e
    UNION ALL SELECT event_id, 'user_id', user_id, CAST(user_id AS VARCHAR) FROM e
    UNION ALL SELECT event_id, 'value', cents * CAST(0.01 AS DOUBLE),
        rtrim(rtrim(printf('%.6f', cents * CAST(0.01 AS DOUBLE)), '0'), '.') FROM e
    UNION ALL SELECT event_id, 'ts_us', us, CAST(us AS VARCHAR) FROM e
    UNION ALL SELECT event_id, 'flags', event_id % 8, CAST(event_id % 8 AS VARCHAR) FROM e
    UNION ALL SELECT event_id, 'length', 24, '24' FROM e"""
)
def decode_long_events(spark, sf):
    """Mixed messages in one long schema."""
    datagrams = we.event_datagrams(we.events(spark, sf))
    layouts = [
        Message(m.name, m.port, m.length, m.fields[:-1], m.header) for m in we.event_messages()
    ]  # the checksum has its own query
    routed = route.route(datagrams, layouts, "first")
    out = decode.decode_long(routed, layouts)
    return out.select(F.col("packet_no").alias("event_id"), "field", "value", "text")


@query(
    """SELECT event_id, 'event_id' AS field, CAST(4 AS INTEGER) AS "offset", CAST(4 AS INTEGER) AS length,
        upper(printf('%08x', event_id)) AS slice FROM events
    UNION ALL SELECT event_id, 'user_id', 8, 2, upper(printf('%04x', user_id)) FROM events
    UNION ALL SELECT event_id, 'flags', 22, 1, upper(printf('%02x', event_id % 8)) FROM events
    UNION ALL SELECT event_id, 'tail', 23, 8, '18' FROM events
    UNION ALL SELECT event_id, 'beyond', 25, 4, '' FROM events"""
)
def field_slices(spark, sf):
    """Hex slices per field, clipped at the payload end."""
    fields = we.BASE_FIELDS[2:4] + we.BASE_FIELDS[6:7] + (Field("tail", 23, 8, "String"), Field("beyond", 25, 4))
    names = [Message(n, 0, 23, fields) for n in we.EVENT_TYPES]
    rows = we.event_datagrams(we.events(spark, sf)).withColumn("payload", F.substring("payload", 1, 23))
    rows = rows.withColumn("message", F.element_at(F.array(*[F.lit(n) for n in we.EVENT_TYPES]), F.col("dst_port") - 5000))
    from wirelens.plans.model import fields_frame

    out = decode.field_slices(rows, fields_frame(spark, names), ("packet_no",))
    return out.select(F.col("packet_no").alias("event_id"), "field", "offset", "length", "slice")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price,
    CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS discount, -l_quantity AS minus_quantity FROM lineitem"""
)
def float_roundtrip(spark, sf):
    """IEEE singles and doubles written and read back exactly."""
    layout = Message(
        "price", 0, 20, (Field("price", 1, 8, "Float64"), Field("discount", 9, 4, "Float32"), Field("minus_quantity", 13, 8, "Float64"))
    )
    rows = table(spark, sf, "lineitem")
    values = {"price": F.col("l_extendedprice"), "discount": F.col("l_discount"), "minus_quantity": -F.col("l_quantity")}
    built = encode.build_payloads(rows, layout, values)
    return decode.decode_fields(built, layout, values_only=True, keep=("l_orderkey", "l_linenumber", "l_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "price", "discount", "minus_quantity"
    )


@query(
    """SELECT o_orderkey, CAST(CAST(o_custkey AS HUGEINT) * 18446744073709551616 + o_orderkey AS VARCHAR) AS wide,
    CAST(CAST(o_orderkey AS HUGEINT) - 18446744073709551616 * (o_custkey + 1) AS VARCHAR) AS wide_signed,
    (CAST(o_custkey AS DOUBLE) * 18446744073709551616 + o_orderkey) * CAST(0.5 AS DOUBLE) AS scaled FROM orders"""
)
def wide_ints(spark, sf):
    """Twelve-byte integers, unsigned, signed and scaled."""
    low = by.int_hex(F.col("o_orderkey"), 8)
    wide = F.concat(by.int_hex(F.col("o_custkey"), 4), low)
    negative = F.concat(by.int_hex(-1 - F.col("o_custkey"), 4), low)
    rows = table(spark, sf, "orders").select("o_orderkey", F.unhex(F.concat(wide, negative)).alias("payload"))
    layout = Message(
        "wide",
        0,
        24,
        (
            Field("wide", 1, 12, "Uint64"),
            Field("wide_signed", 13, 12, "Int64"),
            Field("scaled", 1, 12, "RawUnsignedBE", 0.5),
        ),
    )
    out = decode.decode_fields(rows, layout, values_only=True, keep=("o_orderkey",))
    return out.select("o_orderkey", F.col("wide").cast("string"), F.col("wide_signed").cast("string"), "scaled")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey AS part_BE,
    (l_partkey % 256) * 16777216 + ((l_partkey // 256) % 256) * 65536 + ((l_partkey // 65536) % 256) * 256
        + (l_partkey // 16777216) AS part_LE,
    -l_suppkey AS supp_BE, l_extendedprice AS price_LE, 'True' AS part_EndianOK FROM lineitem"""
)
def endian_values(spark, sf):
    """Both byte orders of numeric fields."""
    fields = (Field("part", 1, 4, "Uint32"), Field("supp", 5, 4, "Int32"), Field("price", 9, 8, "Float64", little=True))
    layout = Message("line", 0, 16, fields)
    built = encode.build_payloads(
        table(spark, sf, "lineitem"),
        layout,
        {"part": F.col("l_partkey"), "supp": -F.col("l_suppkey"), "price": F.col("l_extendedprice")},
    )
    columns, _ = verify.check_endianness(fields, "BIG")
    wanted = ("part_BE", "part_LE", "supp_BE", "price_LE", "part_EndianOK")
    return verify.bind_endian(built, fields).select("l_orderkey", "l_linenumber", *[columns[c].alias(c) for c in wanted])


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' UTC' AS text FROM events"""
)
def packet_times(spark, sf):
    """Display time of captured packets."""
    rows = dissect.dissect_frames(we.event_frames(we.events(spark, sf)))
    return rows.select(F.col("packet_no").alias("event_id"), dissect.packet_time_text(F.col("ts")).alias("text"))


# ------------------------------------------------------- frames and dissection


@query(
    f"""SELECT event_id AS packet_no,
    '10.' || ((user_id >> 16) & 255) || '.' || ((user_id >> 8) & 255) || '.' || (user_id & 255) AS src_ip,
    '192.168.1.' || {TYPE_ID} AS dst_ip, CAST(40000 + user_id % 1000 AS INTEGER) AS src_port,
    CAST(5000 + {TYPE_ID} AS INTEGER) AS dst_port, CAST(24 AS INTEGER) AS payload_size FROM events"""
)
def frames_dissect(spark, sf):
    rows = dissect.valid_datagrams(dissect.dissect_frames(we.event_frames(we.events(spark, sf))))
    return rows.select("packet_no", "src_ip", "dst_ip", "src_port", "dst_port", "payload_size")


def damaged_frames(spark, sf):
    """Frames with one fault per event, chosen by the event id."""
    frames = we.event_frames(we.events(spark, sf))
    kind, f = F.pmod("packet_no", F.lit(16)), F.col("frame")

    def cut(n):
        return F.substring(f, 1, n)

    def patch(at, hexed):
        """Bytes put over the frame from a 0-based position."""
        text = F.unhex(F.lit(hexed))
        return F.concat(F.substring(f, 1, at), text, F.substr(f, F.lit(at + len(hexed) // 2 + 1)))

    vlan = F.concat(F.substring(f, 1, 12), F.unhex(F.lit("8100000A")), F.substr(f, F.lit(13)))
    faults = {
        2: cut(10),
        3: F.substring(vlan, 1, 16),
        4: patch(12, "86DD"),
        5: cut(30),
        6: patch(14, "65"),
        7: patch(14, "44"),
        8: F.substring(patch(14, "4F"), 1, 54),
        9: patch(16, "0014"),
        10: cut(62),
        11: patch(20, "2000"),
        12: patch(23, "06"),
        13: patch(38, "0007"),
        14: patch(38, "0021"),
        15: vlan,
    }
    pick = None
    for k, v in faults.items():
        pick = F.when(kind == k, v) if pick is None else pick.when(kind == k, v)
    return frames.withColumns(
        {"frame": pick.otherwise(f), "link_type": F.when(kind == 1, 101).otherwise(F.col("link_type"))}
    )


@query(
    """SELECT CASE event_id % 16 WHEN 1 THEN 'link_type' WHEN 2 THEN 'short_ethernet' WHEN 3 THEN 'short_vlan'
    WHEN 4 THEN 'not_ipv4' WHEN 5 THEN 'short_ipv4' WHEN 6 THEN 'ip_version' WHEN 7 THEN 'ip_header_length'
    WHEN 8 THEN 'truncated_ip_header' WHEN 9 THEN 'ip_total_length' WHEN 10 THEN 'truncated_ip'
    WHEN 11 THEN 'fragment' WHEN 12 THEN 'not_udp' WHEN 13 THEN 'udp_length' WHEN 14 THEN 'truncated_udp'
    ELSE 'valid' END AS drop_reason, COUNT(*) AS packets FROM events GROUP BY 1"""
)
def drop_reasons(spark, sf):
    return summary.drop_summary(dissect.dissect_frames(damaged_frames(spark, sf)))


@query(
    """WITH p AS (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS t FROM part),
    l AS (SELECT p_partkey, t, unnest(range(0, length(t), 16)) AS o FROM p),
    h AS (SELECT p_partkey, o, rpad(regexp_replace(hex(encode(substr(t, CAST(o AS INTEGER) + 1, 16))), '(..)', '\\1 ', 'g'), 48, ' ') AS x,
        substr(t, CAST(o AS INTEGER) + 1, 16) AS a FROM l)
    SELECT p_partkey, CAST(o AS INTEGER) AS line_offset,
        printf('%04x', o) || '  ' || substr(x, 1, 24) || ' ' || substr(x, 25, 24) || ' ' || a AS line FROM h"""
)
def hex_dump_lines(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_partkey", F.encode(F.concat_ws(" ", "p_name", "p_brand", "p_type"), "UTF-8").alias("payload")
    )
    return dissect.hex_dump(rows, keys=("p_partkey",))


@query(
    """WITH w AS (SELECT o_orderkey, o_custkey, length(o_orderpriority) AS n,
        list_sum(list_transform(range(1, length(o_orderpriority) + 1), lambda i:
            ascii(substr(o_orderpriority, CAST(i AS INTEGER), 1)) * CASE WHEN i % 2 = 1 THEN 256 ELSE 1 END)) AS words
        FROM orders),
    s AS (SELECT o_orderkey, n, 2560 + (o_custkey >> 16) + (o_custkey & 65535) + 49320 + 256 + 6 + 20 + n
        + 4096 + (o_orderkey & 65535) + 2 + 20504 + 65535 + words AS total FROM w),
    f AS (SELECT o_orderkey, n, (total & 65535) + (total >> 16) AS t FROM s)
    SELECT o_orderkey, CAST(54 + n AS INTEGER) AS frame_bytes,
        CAST(65535 - ((t & 65535) + (t >> 16)) AS BIGINT) AS tcp_checksum FROM f"""
)
def tcp_checksums(spark, sf):
    """TCP frames around a text of each order, read back by position."""
    ip = F.concat_ws(
        ".",
        F.lit("10"),
        *[F.shiftright("o_custkey", s).bitwiseAND(F.lit(255)).cast("string") for s in (16, 8, 0)],
    )
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.encode("o_orderpriority", "UTF-8").alias("payload"),
        ip.alias("src_ip"),
        F.lit("192.168.1.0").alias("dst_ip"),
        F.lit(4096).alias("src_port"),
        F.col("o_orderkey").bitwiseAND(F.lit(65535)).alias("dst_port"),
    )
    rows = tcp_frames(rows)
    return rows.select(
        "o_orderkey",
        F.octet_length("frame").alias("frame_bytes"),
        by.be_unsigned(F.col("frame"), 50, 2).alias("tcp_checksum"),
    )


# ------------------------------------------------------------------- routing


def order_datagrams(spark, sf):
    """One datagram per order: ports by key, two header bytes by customer."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        F.lit("orders").alias("file"),
        key.alias("packet_no"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        (F.lit(6000) + F.pmod(key, F.lit(5))).cast("int").alias("src_port"),
        (F.lit(6000) + F.pmod(cust, F.lit(7))).cast("int").alias("dst_port"),
        F.lit(8).alias("payload_size"),
        F.concat(F.unhex(by.int_hex(cust, 2)), F.unhex(F.lit("000000000000"))).alias("payload"),
        F.concat(F.lit("S"), F.pmod(cust, F.lit(3)).cast("string")).alias("connection_id"),
    )


def customer_messages(spark, sf, modulus: int = 65536):
    """One definition per customer."""
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("C"), key.cast("string")).alias("message"),
        key.alias("def_order"),
        (F.lit(6000) + F.pmod("c_nationkey", F.lit(5))).cast("int").alias("port"),
        F.lit(8).alias("payload_len"),
        F.unhex(by.int_hex(F.pmod(key, F.lit(modulus)), 2)).alias("header"),
        F.lit("HEX").alias("format"),
        F.lit("").alias("sentence"),
        F.when(F.pmod(key, F.lit(4)) == 0, "").otherwise(F.concat(F.lit("S"), F.pmod(key, F.lit(3)).cast("string"))).alias(
            "connection_id"
        ),
        F.array(F.concat(F.lit("S"), F.pmod(key, F.lit(200)).cast("string")), F.lit("S1")).alias("connection_ids"),
        (F.lit(0.25) + F.pmod(key, F.lit(7))).cast("double").alias("rate_hz"),
        (F.pmod(key, F.lit(10)) != 9).alias("enabled"),
    )


@query(
    """SELECT o_orderkey AS packet_no, 'C' || c_custkey AS message FROM orders JOIN customer
    ON c_custkey % 65536 = o_custkey % 65536
    WHERE c_nationkey % 5 = o_orderkey % 5 OR c_nationkey % 5 = o_custkey % 7"""
)
def route_fanout(spark, sf):
    """All-match routing of every order against every customer definition."""
    out = route.route(order_datagrams(spark, sf), customer_messages(spark, sf))
    return out.select("packet_no", "message")


@query(
    """WITH f AS (SELECT c_custkey % 1000 AS h, MIN(c_custkey) AS k FROM customer GROUP BY 1)
    SELECT o_orderkey AS packet_no, 'C' || k AS message FROM orders JOIN f ON h = o_custkey % 65536"""
)
def route_first(spark, sf):
    """First definition wins, ports unchecked."""
    out = route.route(order_datagrams(spark, sf), customer_messages(spark, sf, 1000), "first")
    return out.select("packet_no", "message")


@query(
    """SELECT o_orderkey AS order_key, 'C' || MIN(c_custkey) AS message FROM orders JOIN customer
    ON c_custkey % 65536 = o_custkey % 65536 GROUP BY 1"""
)
def route_first_many(spark, sf):
    """First match against every customer definition; files are missing and packet numbers repeat."""
    rows = order_datagrams(spark, sf).withColumn("order_key", F.col("packet_no"))
    rows = rows.withColumn("file", F.when(F.pmod("order_key", F.lit(3)) == 0, F.col("file"))).withColumn("packet_no", F.pmod("order_key", F.lit(100)))
    return route.route(rows, customer_messages(spark, sf), "first").select("order_key", "message")


@query(
    """SELECT o_orderkey AS order_key, CAST(CAST((o_orderkey + 1) * CAST(15312448733258088 AS DOUBLE) AS HUGEINT) AS VARCHAR) AS text FROM orders"""
)
def large_value_text(spark, sf):
    """Scaled values beyond 2^53 as display text, all digits."""
    scaled = by.scale(F.col("o_orderkey") + 1, 15312448733258088.0)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_key"), by.fixed6(scaled).alias("text"))


@query(
    """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'S' || c_custkey % 3 END AS link FROM customer)
    SELECT o_orderkey AS packet_no, 'C' || MIN(c_custkey) AS message FROM orders JOIN c
    ON c_custkey % 1000 = o_custkey % 65536 AND (link = '' OR link = 'S' || o_custkey % 3) GROUP BY 1"""
)
def route_connections(spark, sf):
    """First match among definitions of the datagram's connection or of none."""
    out = route.route(order_datagrams(spark, sf), customer_messages(spark, sf, 1000), "first", connection="connection_id")
    return out.select("packet_no", "message")


def _seven():
    extra = [Message("refund", 5006, 24, we.BASE_FIELDS), Message("ping", 5001, 23, we.BASE_FIELDS[:-1])]
    return we.event_messages() + extra


@query(
    """SELECT m AS message, EXISTS (SELECT 1 FROM events WHERE event_type = m) AS present FROM
    (SELECT unnest(['click','view','purchase','signup','error','refund','ping']) AS m)"""
)
def missing_messages(spark, sf):
    rows = we.event_datagrams(we.events(spark, sf))
    missing = route.messages_missing(rows, _seven()).select("message", F.lit(False).alias("present"))
    present = route.messages_present(rows, _seven()).select("message", F.lit(True).alias("present"))
    return missing.unionByName(present)


@query(
    """SELECT 'C' || c_custkey AS message, u AS connection_id FROM (
        SELECT c_custkey, unnest(list_distinct(['S' || c_custkey % 200, 'S1'])) AS u FROM customer)
    WHERE u IN (SELECT 'S' || s_suppkey FROM supplier)"""
)
def message_destinations(spark, sf):
    return route.message_destinations(customer_messages(spark, sf), supplier_connections(spark, sf)).select(
        "message", "connection_id"
    )


def supplier_connections(spark, sf):
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        key.alias("conn_order"), F.concat(F.lit("S"), key.cast("string")).alias("id"), F.lit("UDP").alias("transport")
    )


@query(
    """WITH m AS (SELECT 'S' || c_custkey % 300 AS link, 8 + (c_custkey // 300) % 2 AS n FROM customer),
    s AS (SELECT link, MIN(n) AS lo, MAX(n) AS hi FROM m GROUP BY 1)
    SELECT 'S' || s_suppkey AS connection_id, CAST(COALESCE(CASE WHEN lo = hi THEN lo END, 0) AS INTEGER) AS frame_length
    FROM supplier LEFT JOIN s ON link = 'S' || s_suppkey"""
)
def connection_frame_length(spark, sf):
    key = F.col("c_custkey")
    messages = table(spark, sf, "customer").select(
        F.lit("HEX").alias("format"),
        F.concat(F.lit("S"), F.pmod(key, F.lit(300)).cast("string")).alias("connection_id"),
        (F.lit(8) + F.pmod(F.floor(key / 300), F.lit(2))).cast("int").alias("payload_len"),
    )
    return route.connection_frame_length(messages, supplier_connections(spark, sf))


@query(
    """WITH k AS (SELECT CAST(p_partkey AS VARCHAR) AS t FROM part)
    SELECT hex(encode(a.t)) AS shorter, hex(encode(b.t)) AS longer FROM k a JOIN k b
    ON a.t <> b.t AND starts_with(b.t, a.t)"""
)
def header_overlaps(spark, sf):
    rows = table(spark, sf, "part").select(F.encode(F.col("p_partkey").cast("string"), "UTF-8").alias("header"))
    return route.header_overlaps(rows)


@query(
    """SELECT CAST(6000 + c_nationkey % 5 AS INTEGER) AS port,
    'HEX:8:' || lower(printf('%04x', c_custkey % 1000)) AS signature, COUNT(*) AS definitions
    FROM customer GROUP BY 1, 2 HAVING COUNT(*) > 1"""
)
def match_signatures(spark, sf):
    return route.match_signatures(customer_messages(spark, sf, 1000))


# ---------------------------------------------------------------------- bits


@query(
    """SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 'odd' ELSE 'even' END AS low_bit,
    CASE (event_id % 8) // 2 WHEN 0 THEN 'none' WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'UNKNOWN(11)' END AS upper,
    CAST(event_id % 8 % 2 * 4 + (event_id % 8) // 2 % 2 * 2 + (event_id % 8) // 4 AS BIGINT) AS reversed FROM events"""
)
def bit_flags(spark, sf):
    rows = we.event_payloads(we.events(spark, sf))
    h = by.slice_hex(F.col("payload"), 21, 1)
    low, upper = we.FLAG_RULES
    return rows.select(
        "event_id",
        fb.decode_bits(h, 1, low).alias("low_bit"),
        fb.decode_bits(h, 1, upper).alias("upper"),
        fb.bit_group(h, 1, (2, 1, 0)).alias("reversed"),
    )


@query(
    """SELECT event_id, CASE WHEN event_id % 8 IN (6, 7) THEN 'BOTH' ELSE 'OK' END AS pair,
    CASE WHEN event_id % 8 IN (0, 1, 2, 4) THEN 'OK' ELSE 'MANY' END AS any_two FROM events"""
)
def exclusive_bits(spark, sf):
    from wirelens.plans.model import Exclusion

    rows = we.event_payloads(we.events(spark, sf))
    h = by.slice_hex(F.col("payload"), 21, 1)
    return rows.select(
        "event_id",
        fb.exclusive_bits(h, 1, Exclusion((1, 2), "pair", "BOTH")).alias("pair"),
        fb.exclusive_bits(h, 1, Exclusion((0, 1, 2, 99), "any", "MANY")).alias("any_two"),
    )


@query(
    """SELECT event_id,
    CASE event_type WHEN 'click' THEN 'clicks' WHEN 'purchase' THEN 'buys' WHEN 'error' THEN 'faults'
        WHEN 'view' THEN 'UNKNOWN_CONTROLLER(0X2)' ELSE 'UNKNOWN_CONTROLLER(0X4)' END AS profile,
    CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 2 = 1 THEN 'on' ELSE 'off' END END AS armed,
    CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 8 >= 6 THEN 'BOTH SET' ELSE 'OK' END END AS pair,
    CASE WHEN event_type = 'purchase' THEN CASE event_id % 8 WHEN 0 THEN 'idle' WHEN 7 THEN 'full'
        ELSE ((event_id % 8) // 4) || '' || (((event_id % 8) // 2) % 2) || '' || (event_id % 2) END END AS mode,
    CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 8 = 1 THEN 'left' ELSE '' END END AS code FROM events"""
)
def profile_decode(spark, sf):
    """Bit columns chosen by the value of another field."""
    layout = Message("event", 0, 24, we.BASE_FIELDS)
    out = decode.decode_fields(we.event_payloads(we.events(spark, sf)).select("payload"), layout, values_only=True)
    return out.select(
        "event_id",
        F.col("flags_Profile").alias("profile"),
        F.col("flags_clicks_armed").alias("armed"),
        F.col("flags_clicks_Validation_pair").alias("pair"),
        F.col("flags_buys_mode").alias("mode"),
        F.col("flags_faults_code").alias("code"),
    )


@query(
    """WITH t AS (SELECT p_partkey AS k, p_partkey % 5 AS a, p_partkey % 4 AS n, 20 + p_partkey % 10 AS c FROM part)
    SELECT k AS p_partkey, CASE WHEN c < 24 THEN array_to_string(list_concat(range(a, a + n + 1), [c]), ',') END AS positions,
    CASE WHEN c >= 24 THEN 'position_out_of_range: ' || c || ' not in 0..23' END AS error FROM t"""
)
def bit_positions(spark, sf):
    k = F.col("p_partkey")
    a, n, c = F.pmod(k, F.lit(5)), F.pmod(k, F.lit(4)), F.lit(20) + F.pmod(k, F.lit(10))
    text = F.concat(a.cast("string"), F.lit("-"), (a + n).cast("string"), F.lit(" , "), c.cast("string"))
    rows = table(spark, sf, "part").select("p_partkey", fb.bit_positions(text, 24).alias("r"))
    return rows.select(
        "p_partkey", F.array_join(F.col("r.positions").cast("array<string>"), ",").alias("positions"), "r.error"
    )


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 6 <> 5 THEN CAST(p_size % 4 AS VARCHAR) || '=' || p_brand END AS meanings,
    CASE WHEN p_partkey % 6 <> 5 THEN CASE WHEN p_partkey % 2 = 0 THEN 'BLANK' ELSE 'UNKNOWN' END END AS unknown,
    CASE WHEN p_partkey % 6 = 5 THEN 'bad_mapping: rule 1' END AS error FROM part"""
)
def rules_from_json(spark, sf):
    """Rule texts parsed per part; a binary pattern outranks the decimal value."""
    k, size = F.col("p_partkey"), F.pmod("p_size", F.lit(4))
    binary = F.when(F.pmod(k, F.lit(6)) == 5, "012").otherwise(F.lpad(F.bin(size.cast("bigint")), 2, "0"))
    behaviour = F.when(F.pmod(k, F.lit(2)) == 0, " blank ").otherwise("whatever")
    text = F.format_string(
        '{"rules":[{"label":"r","bits":[0,1],"unknownBehavior":"%s","mappings":[{"value":"9","binary":"%s","meaning":"%s"}]}]}',
        behaviour,
        binary,
        F.col("p_brand"),
    )
    rows = table(spark, sf, "part").select("p_partkey", fb.rules_from_json(text).alias("r"))
    first = F.get("r.rules", F.lit(0))
    shown = F.transform(F.map_entries(first["meanings"]), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]))
    return rows.select(
        "p_partkey", F.array_join(shown, ";").alias("meanings"), first["unknown"].alias("unknown"), "r.error"
    )


# ------------------------------------------------------------ checks and rates


@query(
    """SELECT p_partkey, CAST(list_reduce(list_transform(string_split(t, ''), lambda c: ascii(c)), lambda a, b: xor(a, b)) AS BIGINT) AS x
    FROM (SELECT p_partkey, p_name || p_brand || p_type AS t FROM part)"""
)
def checksum_xor(spark, sf):
    raw = F.encode(F.concat("p_name", "p_brand", "p_type"), "UTF-8")
    rows = table(spark, sf, "part").select("p_partkey", raw.alias("payload"))
    return rows.select("p_partkey", by.xor_bytes(F.col("payload"), F.lit(0), F.octet_length("payload")).alias("x"))


@query(
    """SELECT doc_id, CAST(list_sum(list_transform(string_split(t, ''), lambda c: CASE
        WHEN unicode(c) < 128 THEN unicode(c)
        WHEN unicode(c) < 2048 THEN 192 + unicode(c) // 64 + 128 + unicode(c) % 64
        WHEN unicode(c) < 65536 THEN 224 + unicode(c) // 4096 + 128 + (unicode(c) // 64) % 64 + 128 + unicode(c) % 64
        ELSE 240 + unicode(c) // 262144 + 128 + (unicode(c) // 4096) % 64 + 128 + (unicode(c) // 64) % 64
            + 128 + unicode(c) % 64 END)) AS BIGINT) AS s
    FROM (SELECT doc_id, text AS t FROM documents)"""
)
def checksum_sum(spark, sf):
    """Byte sums of whole texts."""
    rows = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("payload"))
    return rows.select("doc_id", by.sum_bytes(F.col("payload"), F.lit(0), F.octet_length("payload")).alias("s"))


@query(
    f"""SELECT event_id, 'AA55' AS HeaderObserved, 'True' AS HeaderOK,
    CASE WHEN event_id % 7 = 0 THEN 'False' ELSE 'True' END AS ChecksumOK,
    CASE WHEN event_id % 5 = 0 THEN '23' ELSE '24' END AS DataLenStored,
    CASE WHEN event_id % 5 = 0 THEN 'False' ELSE 'True' END AS DataLenOK,
    '0x0' || {TYPE_ID} AS MsgIdObserved, CASE WHEN event_type = 'click' THEN 'True' ELSE 'False' END AS MsgIdOK,
    CAST(CASE WHEN event_id % 7 = 0 THEN 255 ELSE 0 END AS BIGINT) AS sum_difference,
    concat_ws('; ', CASE WHEN event_id % 7 = 0 THEN 'Checksum mismatch (computed, stored)' END,
        CASE WHEN event_id % 5 = 0 THEN 'DataLength mismatch (stored 23, computed 24)' END,
        CASE WHEN event_type <> 'click' THEN 'MessageId mismatch (got 0x0' || {TYPE_ID} || ', expected 0x01)' END) AS reason
    FROM events"""
)
def verify_events(spark, sf):
    """Header, checksum, length and id checks of payloads with planted faults."""
    body = F.col("payload")
    rows = we.event_payloads(we.events(spark, sf)).select("event_id", "payload")
    # A wrong length byte changes the XOR by 24 ^ 23; the checksum byte follows it.
    wrong_length = F.pmod("event_id", F.lit(5)) == 0
    wrong_sum = F.pmod("event_id", F.lit(7)) == 0
    stored = by.be_raw(body, 23, 1)
    stored = stored.bitwiseXOR(F.when(wrong_length, 24 ^ 23).otherwise(0)).bitwiseXOR(F.when(wrong_sum, 255).otherwise(0))
    length = F.when(wrong_length, F.unhex(F.lit("17"))).otherwise(F.unhex(F.lit("18")))
    spoiled = rows.select(
        "event_id", F.concat(F.substring(body, 1, 22), length, F.unhex(by.int_hex(stored, 1))).alias("payload")
    )
    layout = Message("event", 0, 24, we.BASE_FIELDS, checks=we.CHECKS)
    out = verify.verify(spoiled, layout)
    # The two checksum bytes of the reason differ by the planted bits; the rest of it is compared as it is.
    hexes = [F.conv(F.regexp_extract("CompareReason", r"Checksum mismatch \(computed (?:0x)?([0-9A-Fa-f]+), stored (?:0x)?([0-9A-Fa-f]+)\)", g), 16, 10).cast("bigint") for g in (1, 2)]
    has = F.contains(F.col("CompareReason"), F.lit("Checksum mismatch"))
    difference = F.when(has, hexes[0].bitwiseXOR(hexes[1])).otherwise(F.lit(0))
    reason = F.regexp_replace("CompareReason", r"computed (?:0x)?[0-9A-Fa-f]+, stored (?:0x)?[0-9A-Fa-f]+\)(; DataL|; Mess|$)", "computed, stored)$1")
    names = ("HeaderObserved", "HeaderOK", "ChecksumOK", "DataLenStored", "DataLenOK", "MsgIdObserved", "MsgIdOK")
    return out.select("event_id", *names, difference.alias("sum_difference"), reason.alias("reason"))


def _rated(spark, sf, ts):
    rows = we.events(spark, sf).select(
        F.col("event_id").alias("packet_no"), F.col("event_type").alias("message"), ts.alias("ts")
    )
    out = verify.refresh_rate(rows, ("message",), window_ms=3_600_000, bucket_ms=4 * 3_600_000)
    return out.select(F.col("packet_no").alias("event_id"), "refresh_hz")


@query(
    """SELECT event_id, COUNT(*) OVER (PARTITION BY event_type ORDER BY epoch_ms(ts)
    RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS refresh_hz FROM events"""
)
def refresh_rate(spark, sf):
    """Sliding arrivals per type, over an hour so that counts exceed one."""
    return _rated(spark, sf, F.col("ts"))


@query(
    """WITH e AS (SELECT event_id, event_type, epoch_ms(date_trunc('hour', ts)) AS ms FROM events)
    SELECT event_id, COUNT(*) OVER (PARTITION BY event_type ORDER BY ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW)
    - COUNT(*) OVER (PARTITION BY event_type, ms) + ROW_NUMBER() OVER (PARTITION BY event_type, ms ORDER BY event_id)
    AS refresh_hz FROM e"""
)
def refresh_rate_ties(spark, sf):
    """The same with equal timestamps, which count in arrival order."""
    return _rated(spark, sf, F.date_trunc("hour", "ts"))


def _queue_sql(ms: str) -> str:
    """The arrival queue by its definition: the front is the first row that reaches the largest stamp so far less the window."""
    return f"""WITH e AS (SELECT event_id, event_type, {ms} AS ms FROM events),
    m AS (SELECT *, ROW_NUMBER() OVER w AS place, MAX(ms) OVER w AS top FROM e WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
    r AS (SELECT event_type, top, MIN(place) AS place FROM m GROUP BY 1, 2)
    SELECT m.event_id, m.place - r.place + 1 AS refresh_hz FROM m ASOF JOIN r ON m.event_type = r.event_type AND m.top - 3600000 <= r.top"""


def _queue_rated(spark, sf, ms):
    rows = we.events(spark, sf).select(
        F.col("event_id").alias("packet_no"), F.col("event_type").alias("message"), F.timestamp_millis(ms).alias("ts")
    )
    out = verify.refresh_rate(rows, ("message",), window_ms=3_600_000, exact=True, bucket_ms=4 * 3_600_000)
    return out.select(F.col("packet_no").alias("event_id"), "refresh_hz")


@query(_queue_sql("epoch_ms(ts) - CASE WHEN event_id % 40 = 0 THEN (event_id * 7919) % 97 ELSE 0 END * 60000"))
def refresh_rate_exact(spark, sf):
    """Clocks that step back, following the arrival queue."""
    back = F.pmod(F.col("event_id") * 7919, F.lit(97)) * F.when(F.pmod("event_id", F.lit(40)) == 0, 1).otherwise(0)
    return _queue_rated(spark, sf, F.unix_millis("ts") - back * 60_000)


@query(_queue_sql("CASE WHEN event_id IN (SELECT MIN(event_id) + 5 FROM events) THEN 4102444800000 ELSE epoch_ms(ts) END"))
def refresh_rate_future(spark, sf):
    """One stamp in the year 2100 near the start: the queue of its key never empties again."""
    events = we.events(spark, sf)
    early = events.agg((F.min("event_id") + 5).alias("early"))
    ms = F.when(F.col("event_id") == F.lit(early.first()["early"]), F.lit(4_102_444_800_000)).otherwise(F.unix_millis("ts"))
    return _queue_rated(spark, sf, ms)


@query(
    """WITH t AS (SELECT event_type, epoch_ms(ts) - MAX(epoch_ms(ts)) OVER (PARTITION BY event_type ORDER BY event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM events)
    SELECT event_type AS message, COUNT(*) AS arrivals, 1000000.0::DOUBLE AS period_ms, COUNT(*) FILTER (gap BETWEEN 500000 AND 1500000) AS on_time,
    COUNT(*) FILTER (gap >= 0 AND gap < 500000) AS early, COUNT(*) FILTER (gap > 1500000) AS late,
    CAST(COALESCE(SUM(floor(gap / 1000000.0 + 0.5) - 1) FILTER (gap > 1500000), 0) AS BIGINT) AS missed, COUNT(*) FILTER (gap < 0) AS backwards
    FROM t GROUP BY 1"""
)
def arrival_periods(spark, sf):
    """Observed arrivals of each message against its nominal period."""
    messages = [Message(n, 5001 + i, 24, we.BASE_FIELDS, rate_hz=0.001) for i, n in enumerate(we.EVENT_TYPES)]
    rows = we.events(spark, sf).select(F.col("event_id").alias("packet_no"), F.col("event_type").alias("message"), "ts")
    return schedule.arrival_periods(rows, messages)


# ----------------------------------------------------------------- sentences


def event_sentences(spark, sf):
    """A position sentence per event; the latitude follows the user, the time the event."""
    rows = we.events(spark, sf)
    tokens = {
        1: F.format_string("%02d07.%03d", F.pmod("user_id", F.lit(90)), F.pmod("event_id", F.lit(1000))),
        2: F.lit("N"),
        3: F.format_string("%03d31.5", F.pmod("event_id", F.lit(180))),
        4: F.lit("E"),
        5: F.date_format("ts", "HHmmss"),
        6: F.lit("A"),
    }
    return nmea.build_sentences(rows, "GLL", tokens)


GLL = Message(
    "position",
    5001,
    0,
    (Field("lat", nmea_index=1), Field("lon", nmea_index=3), Field("utc", nmea_index=5), Field("mode", nmea_index=7)),
    format="NMEA",
    sentence="gll",
)


@query(
    """SELECT event_id, 'GP' AS talker, true AS checksum_ok, printf('%02d 07.%03d', user_id % 90, event_id % 1000) AS lat,
    printf('%03d 31.5', event_id % 180) AS lon, strftime(ts, '%H:%M:%S') AS utc, '' AS mode FROM events"""
)
def nmea_rows(spark, sf):
    out = nmea.nmea_rows(event_sentences(spark, sf).select("event_id", "payload"), GLL, keep=("event_id",))
    return out.select("event_id", "talker", "checksum_ok", "lat", "lon", "utc", "mode")


@query(
    """SELECT event_id, CAST(i AS INTEGER) AS idx, kind, CASE i WHEN 1 THEN printf('%02d 07.%03d', user_id % 90, event_id % 1000)
    WHEN 2 THEN 'N' WHEN 3 THEN printf('%03d 31.5', event_id % 180) WHEN 4 THEN 'E' WHEN 5 THEN strftime(ts, '%H:%M:%S')
    WHEN 6 THEN 'A' ELSE '' END AS value FROM events, (VALUES (1, 'Latitude'), (2, 'Char'), (3, 'Longitude'), (4, 'Char'),
    (5, 'Time'), (6, 'Status'), (7, 'Char')) t(i, kind)"""
)
def nmea_tokens(spark, sf):
    """Every token with the kind the registry gives its position."""
    tokens = nmea.sentence_fields(event_sentences(spark, sf), ["event_id"])
    out = nmea.token_values(tokens, nmea_registry(spark))
    return out.select("event_id", "idx", "kind", "value")


@query(
    """SELECT CASE event_id % 4 WHEN 0 THEN 'checksum_mismatch' WHEN 1 THEN 'missing_checksum' WHEN 2 THEN 'bad_address'
    ELSE 'skipped_formatter' END AS warning, COUNT(*) AS n FROM events GROUP BY 1"""
)
def nmea_bad_checksum(spark, sf):
    """Warnings of sentences with one planted fault each."""
    rows = event_sentences(spark, sf)
    text = st.latin1(F.col("payload"))
    kind = F.pmod("event_id", F.lit(4))
    spoiled = (
        F.when(kind == 0, F.regexp_replace(text, "[*]..", "*ZZ"))
        .when(kind == 1, F.regexp_replace(text, "[*]..", ""))
        .when(kind == 2, F.lit("noise$GP,1*0A\r\n"))
        .otherwise(F.lit("$GPGGA,1*4B\r\n"))
    )
    bad = rows.select("event_id", F.encode(spoiled, "ISO-8859-1").alias("payload"))
    out = nmea.nmea_warnings(bad, ["event_id"], "GLL")
    return out.groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT event_id AS packet_no, CASE WHEN event_id % 3 = 0 THEN 'gll' ELSE 'zda' END AS message FROM events
    UNION ALL SELECT event_id, 'zda' FROM events WHERE event_id % 3 = 0"""
)
def nmea_route(spark, sf):
    """Sentences matched by port and formatter; a datagram may hold several."""
    rows = event_sentences(spark, sf)
    zda = F.encode(F.lit("$GPZDA,,,,,,*48\r\n"), "US-ASCII")
    payload = F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat("payload", zda)).otherwise(zda)
    datagrams = rows.select(
        F.lit("f").alias("file"),
        F.col("event_id").alias("packet_no"),
        F.lit(5001).alias("src_port"),
        F.lit(9).alias("dst_port"),
        F.octet_length(payload).alias("payload_size"),
        payload.alias("payload"),
    )
    messages = [
        Message("gll", 5001, format="NMEA", sentence="GLL"),
        Message("zda", 5001, format="NMEA", sentence=" zda "),
        Message("elsewhere", 5002, format="NMEA", sentence="ZDA"),
    ]
    return route.route(datagrams, messages).select("packet_no", "message")


# ----------------------------------------------------------------- summaries


@query(
    """SELECT m AS message, CAST(p AS INTEGER) AS port, COALESCE(n, 0) AS exported_rows, n IS NULL AS missing FROM
    (VALUES ('click', 5001), ('view', 5002), ('purchase', 5003), ('signup', 5004), ('error', 5005), ('refund', 5006),
    ('ping', 5001)) t(m, p) LEFT JOIN (SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1) ON event_type = m"""
)
def message_summary(spark, sf):
    rows = route.route(we.event_datagrams(we.events(spark, sf)), _seven())
    return summary.message_summary(rows, _seven()).select("message", "port", "exported_rows", "missing")


@query(
    """SELECT COUNT(*) AS total_packets, COUNT(*) FILTER (event_id % 16 IN (0, 15)) AS valid_udp,
    COUNT(*) FILTER (event_id % 16 IN (0, 15) AND event_type IN ('click', 'view')) AS matched_packets,
    COUNT(*) FILTER (event_id % 16 IN (0, 15) AND event_type IN ('click', 'view'))
        + COUNT(*) FILTER (event_id % 16 IN (0, 15) AND event_type = 'click') AS exported_rows FROM events"""
)
def run_summary(spark, sf):
    """Totals of a run in which one type matches two definitions."""
    dissected = dissect.dissect_frames(damaged_frames(spark, sf))
    messages = we.event_messages()[:2] + [Message("any click", 5001, 24, we.BASE_FIELDS)]
    routed = route.route(dissect.valid_datagrams(dissected), messages)
    return summary.run_summary(dissected, routed)


@query(
    """WITH m AS (SELECT event_type, event_id % 16 IN (0, 15) AS ok FROM events),
    t(message, kind, own) AS (VALUES ('click', 'click', 1), ('view', 'view', 1), ('any click', 'click', 0))
    SELECT message, SUM(own) FILTER (ok) AS packets, SUM(own) FILTER (ok) AS valid_udp, SUM(own) FILTER (ok) AS matched_packets,
      COUNT(*) FILTER (ok) AS exported_rows FROM m JOIN t ON kind = event_type GROUP BY message HAVING COUNT(*) FILTER (ok) > 0
    UNION ALL SELECT NULL, COUNT(*), COUNT(*) FILTER (ok), 0, 0 FROM m WHERE NOT (ok AND event_type IN ('click', 'view'))"""
)
def run_report(spark, sf):
    """Run totals and exported rows of every message from one pass; one type matches two definitions."""
    messages = we.event_messages()[:2] + [Message("any click", 5001, 24, we.BASE_FIELDS), Message("ping", 5009, 24, we.BASE_FIELDS)]
    return summary.run_report(dissect.dissect_frames(damaged_frames(spark, sf)), messages)


@query(
    f"""SELECT event_id AS packet_no, {TYPE_ID} || ' | ' || event_id || ' | ' || user_id AS "values" FROM events
    ORDER BY event_id DESC LIMIT 200"""
)
def live_preview(spark, sf):
    """The newest rows of a stream over many batches, most of them smaller than the preview."""
    from wirelens.streaming import live

    layout = Message("event", 0, 24, we.BASE_FIELDS[1:4])
    path = work_path(spark, "newest")
    rows = we.event_payloads(we.events(spark, sf)).select(F.col("event_id").alias("packet_no"), "ts", "payload")

    def run(stream):
        decoded = decode.decode_fields(stream, layout, values_only=True, keep=("packet_no",))
        show = lambda df, _: df.write.mode("overwrite").parquet(path + "-shown")
        live.live_preview(decoded, ["msg_id", "event_id", "user_id"], show, path + "-state").awaitTermination()

    _in_steps(spark, rows, "ts", path, run, parts=8)
    return spark.read.parquet(path + "-shown")


@query(
    f"""SELECT event_id AS packet_no, {TYPE_ID} || ' | ' || event_id || ' | ' || user_id AS "values" FROM events
    ORDER BY event_id LIMIT 5000"""
)
def preview_topk(spark, sf):
    """The first rows of a run, the report the reader shows."""
    layout = Message("event", 0, 24, we.BASE_FIELDS[1:4])
    out = decode.decode_fields(we.event_datagrams(we.events(spark, sf)), layout, keep=())
    return summary.preview(out, ["msg_id", "event_id", "user_id"]).select("packet_no", "values")


@query(
    f"""SELECT event_id AS packet_no, {TYPE_ID} || ' | ' || event_id || ' | ' || user_id AS "values" FROM events
    ORDER BY event_id DESC LIMIT 200"""
)
def preview_latest(spark, sf):
    layout = Message("event", 0, 24, we.BASE_FIELDS[1:4])
    out = decode.decode_fields(we.event_datagrams(we.events(spark, sf)), layout, keep=())
    return summary.latest_preview(out, ["msg_id", "event_id", "user_id"]).select("packet_no", "values")


@query(
    """SELECT event_type AS message, COUNT(*) FILTER (event_id % 3 = 0) AS short_packets FROM events GROUP BY 1"""
)
def short_packets(spark, sf):
    """Datagrams that end before their last field."""
    from wirelens.plans.model import fields_frame

    size = F.when(F.pmod("event_id", F.lit(3)) == 0, 23).otherwise(24)
    rows = we.events(spark, sf).select(
        F.lit("f").alias("file"), F.col("event_id").alias("packet_no"), F.col("event_type").alias("message"), size.alias("payload_size")
    )
    return summary.short_packet_count(rows, fields_frame(spark, we.event_messages()))


# ------------------------------------------------------------ names and cells


@query(
    """SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url),
        '[\\\\/:*?"<>|]', '_', 'g'), '\\s+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'export') AS safe,
    coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'),
        '^_|_$', '', 'g'), ''), 'BITFIELD') AS label FROM pages"""
)
def safe_names(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", tx.safe_name(F.col("url")).alias("safe"), tx.column_label(F.col("url")).alias("label")
    )


@query(
    """WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents),
    s AS (SELECT doc_id, trim(w, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS w FROM t),
    n AS (SELECT doc_id, w, regexp_matches(w, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')
        AND (regexp_matches(w, '[eE]') OR length(regexp_replace(w, '[+\\-.]', '', 'g')) <= 15) AS is_number FROM s)
    SELECT doc_id, COUNT(*) AS cells, COUNT(*) FILTER (is_number) AS numbers,
    COALESCE(MAX(CASE WHEN is_number THEN TRY_CAST(w AS DOUBLE) END), 0) AS largest FROM n GROUP BY 1"""
)
def typed_cells(spark, sf):
    """Words of whole documents as cells: which of them are numbers."""
    cells = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ", -1)).alias("w"))
    typed = cells.select("doc_id", tx.typed_cell(F.col("w")).alias("c"))
    return typed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count("c.number").alias("numbers"),
        F.coalesce(F.max("c.number"), F.lit(0.0)).alias("largest"),
    )


LABELS = ["Unsigned Integer", "signed short value", " UCHAR ", "dword", "double precision", "Real (IEEE)", "ASCII text",
          "boolean flag", "long counter", "nothing known", "char field", "Signed Int"]


@query(
    """WITH t AS (SELECT p_partkey AS k, p_partkey % 12 AS l, p_size % 9 AS s FROM part)
    SELECT k AS p_partkey, CASE l WHEN 0 THEN 'Uint32' WHEN 1 THEN 'Int' || CASE WHEN s IN (1, 2, 4, 8) THEN s * 8 ELSE 16 END
    WHEN 2 THEN 'Uint8' WHEN 3 THEN 'Uint32' WHEN 4 THEN 'Float64' WHEN 5 THEN CASE WHEN s = 8 THEN 'Float64' ELSE 'Float32' END
    WHEN 6 THEN 'String' WHEN 7 THEN 'Bool' WHEN 8 THEN 'Uint' || CASE WHEN s IN (1, 2, 4, 8) THEN s * 8 ELSE 64 END
    WHEN 10 THEN 'Uint' || CASE WHEN s IN (1, 2, 4, 8) THEN s * 8 ELSE 8 END WHEN 11 THEN 'Int32' END AS kind FROM t"""
)
def type_labels(spark, sf):
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.pmod("p_partkey", F.lit(12)) + 1).cast("int"))
    return table(spark, sf, "part").select(
        "p_partkey", tx.type_from_label(label, F.pmod("p_size", F.lit(9)).cast("int")).alias("kind")
    )


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS DOUBLE) / 4
    WHEN 1 THEN CAST(1 AS DOUBLE) / (p_size + 1) WHEN 2 THEN pow(2.0, -(p_size % 10)) ELSE p_size * 2.0 + 1 END END AS solved,
    CASE WHEN p_partkey % 5 = 4 THEN 'division_by_zero' END AS solve_error FROM part"""
)
def resolution_expressions(spark, sf):
    """Arithmetic texts, each distinct one evaluated once."""
    size, kind = F.col("p_size"), F.pmod("p_partkey", F.lit(5))
    text = (
        F.when(kind == 0, F.concat(size.cast("string"), F.lit(" / 4")))
        .when(kind == 1, F.concat(F.lit("1/("), size.cast("string"), F.lit("+1)")))
        .when(kind == 2, F.concat(F.lit("2^-"), F.pmod(size, F.lit(10)).cast("string")))
        .when(kind == 3, F.concat(size.cast("string"), F.lit("*2 + 1")))
        .otherwise(F.concat(size.cast("string"), F.lit("/0")))
    )
    rows = table(spark, sf, "part").select("p_partkey", text.alias("expression"))
    return quality.solve_resolutions(rows).select("p_partkey", "solved", "solve_error")


@query(
    """SELECT p_partkey, CAST(2 * p_size - 1 AS INTEGER) AS byte, CAST(p_size AS INTEGER) AS word,
    CAST((p_size - 1) // 2 + 1 AS INTEGER) AS as_word FROM part"""
)
def offset_units(spark, sf):
    words = F.lit("words")
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey",
        tx.unit_to_byte(size, words).alias("byte"),
        tx.byte_to_unit(tx.unit_to_byte(size, words), words).alias("word"),
        tx.byte_to_unit(size, words).alias("as_word"),
    )


# ------------------------------------------------------------------ encoding


@query(
    """WITH t AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer),
    r AS (SELECT k, v, CAST(floor(v / CAST(0.01 AS DOUBLE) + 0.5) AS BIGINT) AS raw FROM t)
    SELECT k AS c_custkey,
    concat_ws('; ', CASE WHEN raw < -32768 * 16 OR raw > 32767 * 16 THEN NULL END,
        CASE WHEN raw > 32767 OR raw < -32768 THEN 'small: value does not fit' END,
        CASE WHEN v < 0 THEN 'plus: negative value in an unsigned field' END,
        CASE WHEN k % 3 = 2 THEN 'flag: not a bool value' END,
        CASE WHEN length(CAST(k AS VARCHAR)) > 3 THEN 'tag: text is too long' END) AS problems FROM r"""
)
def encode_problems(spark, sf):
    """Typed texts per customer and the reasons some cannot be sent."""
    layout = Message(
        "account",
        0,
        12,
        (
            Field("small", 1, 2, "Int16", 0.01),
            Field("plus", 3, 4, "Uint32", 0.01),
            Field("flag", 7, 1, "Bool"),
            Field("tag", 8, 3, "String"),
        ),
    )
    flag = F.element_at(F.array(F.lit("TRUE"), F.lit("0"), F.lit("maybe")), (F.pmod("c_custkey", F.lit(3)) + 1).cast("int"))
    money = F.format_string("%.2f", "c_acctbal")
    values = {"small": money, "plus": money, "flag": flag, "tag": F.col("c_custkey").cast("string")}
    out = encode.build_payloads(table(spark, sf, "customer"), layout, values, texts=True)
    return out.select("c_custkey", F.coalesce("problems", F.lit("")).alias("problems"))


@query("SELECT CAST(NULL AS BIGINT) AS event_id, '' AS field, '' AS sent, '' AS got WHERE false")
def roundtrip_check(spark, sf):
    """Values that do not survive encoding and decoding: there are none."""
    values = {
        "sync": F.lit(0xAA55),
        "msg_id": we.type_id(),
        "event_id": F.col("event_id"),
        "user_id": F.col("user_id"),
        "value": F.col("value"),
        "ts_us": F.unix_micros("ts"),
        "flags": F.pmod("event_id", F.lit(8)),
        "length": F.lit(24),
        "checksum": F.lit(7),
    }
    rows = we.events(spark, sf).withColumn("key", F.col("event_id"))
    out = schedule.roundtrip_check(rows, Message("event", 0, 24, we.BASE_FIELDS), ["key"], values)
    return out.select(F.col("key").alias("event_id"), "field", "sent", "got")


@query(
    """WITH m AS (SELECT c_custkey AS k, 0.25 + c_custkey % 7 AS hz, list_distinct(['S' || c_custkey % 200, 'S1']) AS ids
        FROM customer WHERE c_custkey % 10 <> 9),
    d AS (SELECT k, greatest(1, CAST(floor(1000.0 / hz + 0.5) AS BIGINT)) AS p, unnest(ids) AS c FROM m),
    v AS (SELECT * FROM d WHERE c IN (SELECT 'S' || s_suppkey FROM supplier))
    SELECT 'C' || k AS message, c AS connection_id, tick, tick * p AS at_ms
    FROM (SELECT k, c, p, unnest(range(0, 1 + 9999 // p)) AS tick FROM v)"""
)
def emission_schedule(spark, sf):
    """Ten seconds of sending by every enabled customer definition."""
    out = schedule.emission_schedule(customer_messages(spark, sf), supplier_connections(spark, sf), 10)
    return out.select("message", "connection_id", "tick", "at_ms")


# ------------------------------------------------------------ byte streams


@query(
    """WITH c AS (SELECT doc_id // 10 AS k, string_agg(hex(encode(text)), '' ORDER BY doc_id) AS h FROM documents GROUP BY 1),
    f AS (SELECT k, h, unnest(range(0, length(h) // 128)) AS i FROM c)
    SELECT k AS connection_id, i AS frame_no, md5(substr(h, CAST(i * 128 + 1 AS BIGINT), 128)) AS digest FROM f"""
)
def reframe_chunks(spark, sf):
    """Whole documents as chunks of byte streams, cut into frames of 64 bytes."""
    chunks = table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 10).alias("connection_id"),
        F.col("doc_id").alias("seq"),
        F.encode("text", "UTF-8").alias("chunk"),
        F.lit(None).cast("timestamp").alias("ts"),
    )
    frames, _ = reframe(chunks, 64)
    return frames.select("connection_id", "frame_no", F.md5(F.encode(F.hex("payload"), "UTF-8")).alias("digest"))


# ------------------------------------------------------- catalogue quality


def part_messages(spark, sf):
    """Parts as message definitions, many of them faulty."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.when(F.pmod(k, F.lit(50)) == 49, " ").otherwise(F.concat(F.lit("M"), F.floor(k / 2).cast("string"))).alias("message"),
        k.alias("def_order"),
        F.pmod("p_size", F.lit(3)).cast("int").alias("port"),
        (F.col("p_size") - 2).cast("int").alias("payload_len"),
        F.encode(F.floor(k / 3).cast("string"), "UTF-8").alias("header"),
        F.lit("HEX").alias("format"),
        F.lit("").alias("sentence"),
    )


@query(
    listed(
        """WITH m AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 50 = 49 THEN ' ' ELSE 'M' || p_partkey // 2 END AS message,
        p_size % 3 AS port, p_size - 2 AS n, lower(hex(encode(CAST(p_partkey // 3 AS VARCHAR)))) AS h FROM part)
    SELECT 'name_empty' AS rule, COUNT(*) AS violations FROM m WHERE trim(message) = ''
    UNION ALL SELECT 'port_zero', COUNT(*) FROM m WHERE port = 0
    UNION ALL SELECT 'length_not_positive', COUNT(*) FROM m WHERE n <= 0
    UNION ALL SELECT 'no_fields', COUNT(*) FROM m WHERE k % 7 = 3 AND NOT EXISTS (
        SELECT 1 FROM m f WHERE f.k % 7 <> 3 AND f.message = m.message)
    UNION ALL SELECT 'duplicate_signature', COUNT(*) FROM (SELECT 1 FROM m GROUP BY port, n, h HAVING COUNT(*) > 1)
    UNION ALL SELECT 'duplicate_name', COUNT(*) FROM (SELECT 1 FROM m GROUP BY port, lower(trim(message)) HAVING COUNT(*) > 1)"""
    )
)
def catalog_violations(spark, sf):
    """Rules over definitions, counted."""
    messages = part_messages(spark, sf)
    fields = messages.filter(F.pmod("def_order", F.lit(7)) != 3).select(
        "message", F.lit("f").alias("name"), F.lit(0).alias("ord"), F.lit(1).alias("nmea_index")
    )
    found = quality.check_messages(messages, fields)
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


@query(
    listed(
        """WITH f AS (SELECT l_orderkey AS k, l_linenumber AS o, 'f' || l_linenumber % 4 AS name, l_partkey % 9 - 1 AS off0,
        l_suppkey % 5 AS len, l_tax AS res FROM lineitem)
    SELECT 'duplicate_field' AS rule, COUNT(*) AS violations FROM (SELECT 1 FROM f GROUP BY k, name HAVING COUNT(*) > 1)
    UNION ALL SELECT 'offset_too_small', COUNT(*) FROM f WHERE off0 < 0
    UNION ALL SELECT 'length_invalid', COUNT(*) FROM f WHERE len <= 0
    UNION ALL SELECT 'resolution_not_positive', COUNT(*) FROM f WHERE res <= 0
    UNION ALL SELECT 'exceeds_payload', COUNT(*) FROM f WHERE off0 < 0 OR off0 + len > 10"""
    )
)
def field_violations(spark, sf):
    """Lines as fields of order messages."""
    fields = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("message"),
        F.col("l_linenumber").alias("ord"),
        F.concat(F.lit("f"), F.pmod("l_linenumber", F.lit(4)).cast("string")).alias("name"),
        (F.pmod("l_partkey", F.lit(9)) - 1).cast("int").alias("off0"),
        F.pmod("l_suppkey", F.lit(5)).cast("int").alias("len"),
        F.lit("Uint8").alias("type"),
        F.col("l_tax").alias("resolution"),
    )
    messages = fields.select("message").distinct().select("message", F.lit(10).alias("payload_len"), F.lit("HEX").alias("format"))
    found = quality.check_fields(fields, messages)
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


@query(
    listed(
        """WITH r AS (SELECT p_partkey AS k, p_partkey // 4 AS f, p_partkey % 20 AS a, p_partkey % 20 + p_size % 2 AS b,
        CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'r' || p_partkey % 3 END AS label, p_size % 6 AS v FROM part)
    SELECT 'rule_label_empty' AS rule, COUNT(*) AS violations FROM r WHERE label = ''
    UNION ALL SELECT 'bit_out_of_range', COUNT(*) FROM r WHERE b >= 16
    UNION ALL SELECT 'bit_repeated', COUNT(*) FROM r WHERE a = b
    UNION ALL SELECT 'meaning_too_wide', COUNT(*) FROM r WHERE v >= 4
    UNION ALL SELECT 'duplicate_rule_label', COUNT(*) FROM (SELECT 1 FROM r WHERE label <> '' GROUP BY f, label HAVING COUNT(*) > 1)
    UNION ALL SELECT 'bit_shared_by_rules', COUNT(*) FROM (SELECT 1 FROM (SELECT f, unnest(list_distinct([a, b])) AS bit FROM r)
        GROUP BY f, bit HAVING COUNT(*) > 1)"""
    )
)
def bit_rule_violations(spark, sf):
    """Four rules per field, each made from one part."""
    k = F.col("p_partkey")
    a = F.pmod(k, F.lit(20)).cast("int")
    rule = F.struct(
        F.when(F.pmod(k, F.lit(9)) == 0, "").otherwise(F.concat(F.lit("r"), F.pmod(k, F.lit(3)).cast("string"))).alias("label"),
        F.array(a, (a + F.pmod("p_size", F.lit(2))).cast("int")).alias("positions"),
        F.create_map(F.pmod("p_size", F.lit(6)).cast(by.U64), F.lit("m")).alias("meanings"),
        F.lit("UNKNOWN").alias("unknown"),
        F.lit(True).alias("enabled"),
        F.lit(False).alias("reserved"),
    )
    fields = (
        table(spark, sf, "part")
        .select(F.floor(k / 4).cast("string").alias("message"), rule.alias("r"))
        .groupBy("message")
        .agg(F.collect_list("r").alias("bit_rules"))
        .select("message", F.lit("f").alias("name"), F.lit(2).alias("len"), "bit_rules")
    )
    found = quality.check_bit_rules(fields)
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


@query(
    """WITH s AS (SELECT p_partkey // 8 AS sheet, p_partkey % 8 + 2 AS row, 'n' || p_partkey % (7 + p_partkey // 8 % 3) AS name,
        p_size - 1 AS off, CASE WHEN p_partkey % 61 = 0 THEN 'blob' ELSE 'Uint16' END AS t FROM part),
    e AS (SELECT *, t = 'blob' OR row > MIN(row) OVER (PARTITION BY sheet, name) AS bad FROM s)
    SELECT sheet, CAST(row AS INTEGER) AS row, name, CAST(off AS INTEGER) AS "offset", CAST(2 AS INTEGER) AS len, t AS type FROM e
    WHERE sheet NOT IN (SELECT sheet FROM e WHERE bad)"""
)
def field_sheets(spark, sf):
    """Parts as lines of field sheets; one bad line rejects its sheet."""
    k = F.col("p_partkey")
    sheet = F.floor(k / 8)
    rows = table(spark, sf, "part").select(
        sheet.alias("sheet"),
        (F.pmod(k, F.lit(8)) + 2).cast("int").alias("row"),
        F.concat(F.lit(" n"), F.pmod(k, F.lit(7) + F.pmod(sheet, F.lit(3))).cast("string")).alias("Field Name"),
        (F.col("p_size") - 1).cast("string").alias("Byte Offset"),
        F.when(F.pmod(k, F.lit(61)) == 0, "blob").otherwise("USHORT").alias("Data Type"),
    )
    fields, _ = read_field_sheets(rows, "sheet", "row")
    return fields.select("sheet", "row", "name", "offset", "len", "type")


@query(
    """SELECT p_partkey // 8 AS sheet, CAST(p_partkey % 8 + 2 AS INTEGER) AS row, 'n' || p_partkey AS name,
    CAST(p_size AS INTEGER) AS "offset", CAST(2 AS INTEGER) AS len, 'Uint16' AS type FROM part"""
)
def csv_sheets(spark, sf):
    """Parts as field sheets whose headers differ in order and wording from sheet to sheet."""
    k = F.col("p_partkey")
    lines = table(spark, sf, "part").select(
        F.floor(k / 8).alias("sheet"),
        (F.pmod(k, F.lit(8)) + 2).cast("int").alias("row"),
        F.concat(F.lit("n"), k.cast("string")).alias("name"),
        F.col("p_size").cast("string").alias("at"),
    )
    odd = F.pmod("sheet", F.lit(2)) == 1
    cells = F.when(odd, F.array(F.lit("USHORT"), F.lit("x"), "name", "at")).otherwise(F.array("at", "name", F.lit("USHORT")))
    head = F.when(odd, F.array(*map(F.lit, ("DataType", "note", " Name ", "offset")))).otherwise(
        F.array(*map(F.lit, ("Byte Offset", "field name", "TYPE")))
    )
    heads = lines.select("sheet").distinct().select("sheet", F.lit(1).alias("row"), head.alias("cells"))
    rows = sheets_by_header(lines.select("sheet", "row", cells.alias("cells")).unionByName(heads), "sheet", "row", "cells")
    fields, _ = read_field_sheets(rows, "sheet", "row")
    return fields.select("sheet", "row", "name", "offset", "len", "type")


@query(
    """SELECT c_custkey AS packet_no, 'N' || c_nationkey AS message, f AS field,
    CASE WHEN f = 'key' THEN CAST(c_custkey AS VARCHAR) ELSE CAST(c_custkey % 50 AS VARCHAR) END AS text
    FROM customer, (VALUES ('key'), ('rest')) v(f)"""
)
def catalog_decode(spark, sf):
    """A catalogue file per nation turned into definitions, which route and decode one datagram per customer."""
    n = F.col("n_nationkey").cast("string")
    head = F.lpad(F.hex("n_nationkey"), 2, "0")
    body = (
        '{"messageName": "N%s", "port": 7000, "payloadLengthBytes": 7, "optionalHeaderHex": "C0%s", "fields": ['
        '{"name": "key", "byteOffset": 3, "length": 4, "dataType": "Uint32"},'
        '{"name": "rest", "byteOffset": 7, "length": 1, "dataType": "Uint8"}]}'
    )
    files = table(spark, sf, "nation").select(F.concat(F.lit("f"), n).alias("file"), F.format_string(body, n, head).alias("value"))
    messages, fields, _ = parse_catalog(files)
    definitions = messages_from_catalog(messages, fields)
    key = F.col("c_custkey")
    payload = F.concat(
        F.unhex(F.lit("C0")), F.unhex(by.int_hex(F.col("c_nationkey"), 1)), F.unhex(by.int_hex(key, 4)), F.unhex(by.int_hex(F.pmod(key, F.lit(50)), 1))
    )
    rows = table(spark, sf, "customer").select(F.lit("c").alias("file"), key.alias("packet_no"), payload.alias("payload"), F.lit(7).alias("payload_size"))
    values = decode.decode_long(route.route(rows, definitions, "first"), definitions)
    return values.select("packet_no", "message", "field", "text")


# --------------------------------------------------------- interface documents


def part_grids(spark, sf):
    """Parts as tables of documents: 20 rows per table, 10 tables per document."""
    k = F.col("p_partkey")
    base = table(spark, sf, "part").select(
        F.floor(k / 200).alias("doc"),
        F.pmod(F.floor(k / 20), F.lit(10)).cast("int").alias("table_idx"),
        F.pmod(k, F.lit(20)).cast("int").alias("r"),
        "p_partkey",
        "p_name",
        "p_size",
    )
    heading = F.when(F.pmod("table_idx", F.lit(3)) == 2, "Message (cont.)").otherwise(
        F.concat(F.lit("Message "), F.floor(F.col("table_idx") / 4).cast("string"))
    )
    cells = F.array(
        F.concat(F.col("p_name"), F.lit(" "), F.pmod("p_partkey", F.lit(9)).cast("string")),
        (F.col("r") * 4 + 1).cast("string"),
        F.element_at(F.array(F.lit("Uint16"), F.lit("float"), F.lit("uint"), F.lit("odd")), (F.pmod("p_size", F.lit(4)) + 1)),
        F.when(F.pmod("p_size", F.lit(5)) == 0, "").otherwise(F.element_at(F.array(F.lit("2"), F.lit("4 bytes")), F.pmod("p_size", F.lit(2)) + 1)),
        F.lit("0.5"),
    )
    data = base.select("doc", "table_idx", heading.alias("heading"), (F.col("r") + 1).alias("row_idx"), cells.alias("cells"))
    titles = F.array(*[F.lit(t) for t in ("Field Name", "Byte Offset", "Data Type", "Length", "Resolution")])
    header = base.filter("r = 0").select("doc", "table_idx", heading.alias("heading"), F.lit(0).alias("row_idx"), titles.alias("cells"))
    return header.unionByName(data)


GRID = """SELECT p_partkey AS k, p_partkey // 200 AS doc, (p_partkey // 20) % 10 AS t, p_partkey % 20 AS r,
    p_name || ' ' || p_partkey % 9 AS name, (p_partkey % 20) * 4 + 1 AS off,
    CASE p_size % 4 WHEN 0 THEN 'Uint16' WHEN 1 THEN 'Float32' WHEN 2 THEN 'Uint32' END AS type,
    CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 2 ELSE 4 END AS given FROM part"""


@query(
    f"""WITH g AS ({GRID}), u AS (
    SELECT doc, t AS table_idx, 0 AS col, COUNT(*) AS non_empty, COUNT(*) AS "numeric", CAST(0 AS BIGINT) AS type_like,
        COUNT(DISTINCT name) AS "distinct", SUM(length(name)) AS text_len FROM g GROUP BY 1, 2
    UNION ALL SELECT doc, t, 1, COUNT(*), COUNT(*), 0, COUNT(DISTINCT off), SUM(length(CAST(off AS VARCHAR))) FROM g GROUP BY 1, 2
    UNION ALL SELECT doc, t, 2, COUNT(*), COUNT(CASE WHEN type = 'Uint16' THEN 1 END), COUNT(type),
        COUNT(DISTINCT coalesce(type, 'odd')),
        SUM(CASE coalesce(type, 'odd') WHEN 'Uint16' THEN 6 WHEN 'Float32' THEN 5 WHEN 'Uint32' THEN 4 ELSE 3 END) FROM g GROUP BY 1, 2
    UNION ALL SELECT doc, t, 3, COUNT(given), COUNT(given), 0, COUNT(DISTINCT given), COALESCE(SUM(CASE given WHEN 2 THEN 1 WHEN 4 THEN 7 END), 0) FROM g GROUP BY 1, 2
    UNION ALL SELECT doc, t, 4, COUNT(*), COUNT(*), 0, 1, COUNT(*) * 3 FROM g GROUP BY 1, 2)
    SELECT doc, CAST(table_idx AS INTEGER) AS table_idx, CAST(col AS INTEGER) AS col, non_empty, "numeric", type_like,
    "distinct", CAST(text_len AS BIGINT) AS text_len FROM u"""
)
def column_profile(spark, sf):
    """Shape of every column of every table."""
    out = icd.column_profile(part_grids(spark, sf))
    return out.select("doc", "table_idx", "col", "non_empty", "numeric", "type_like", "distinct", "text_len")


@query(
    """SELECT DISTINCT p_partkey // 200 AS doc, CAST((p_partkey // 20) % 10 AS INTEGER) AS table_idx,
    CAST(0 AS INTEGER) AS name_col, CAST(1 AS INTEGER) AS offset_col, CAST(2 AS INTEGER) AS type_col,
    CAST(3 AS INTEGER) AS length_col, CAST(4 AS INTEGER) AS resolution_col, CAST(-1 AS INTEGER) AS expression_col,
    CAST(1 AS INTEGER) AS offset_base FROM part"""
)
def column_roles(spark, sf):
    return icd.column_roles(icd.column_profile(part_grids(spark, sf)))


@query(
    """WITH t AS (SELECT DISTINCT p_partkey // 200 AS doc, (p_partkey // 20) % 10 AS t FROM part)
    SELECT doc, CAST(t AS INTEGER) AS table_idx, CAST(CASE WHEN t % 3 = 2 THEN t - 1 ELSE t END AS INTEGER) AS parent_idx,
    CAST(CASE WHEN t % 3 = 2 THEN 1 ELSE 0 END AS INTEGER) AS seq FROM t"""
)
def table_groups(spark, sf):
    out = icd.table_groups(icd.header_row(part_grids(spark, sf)))
    return out.select("doc", "table_idx", "parent_idx", "seq")


STRICT = f"""WITH g AS ({GRID}),
    k AS (SELECT *, COALESCE(given, CASE type WHEN 'Uint16' THEN 2 ELSE 4 END) AS len,
        CASE WHEN t % 3 = 2 THEN t - 1 ELSE t END AS parent, CASE WHEN t % 3 = 2 THEN 1 ELSE 0 END AS seq
        FROM g WHERE type IS NOT NULL),
    x AS (SELECT doc, t, MAX(off - 1 + len) AS ext FROM k GROUP BY 1, 2),
    l AS (SELECT doc, t, MIN(off - 1) AS low FROM g GROUP BY 1, 2),
    m AS (SELECT k.*, CASE WHEN seq = 1 AND l.low < COALESCE(x.ext, 0) THEN COALESCE(x.ext, 0) ELSE 0 END AS shift FROM k
        JOIN l ON l.doc = k.doc AND l.t = k.t LEFT JOIN x ON x.doc = k.doc AND x.t = k.parent AND seq = 1)"""


@query(
    f"""{STRICT} SELECT doc, CAST(parent AS INTEGER) AS parent_idx, CAST(off - 1 + shift AS INTEGER) AS off0,
    CAST(len AS INTEGER) AS len, type, CAST(0.5 AS DOUBLE) AS resolution,
    CASE WHEN n = 1 THEN name ELSE name || '_' || n END AS name FROM (SELECT *, ROW_NUMBER() OVER
    (PARTITION BY doc, parent, name ORDER BY k) AS n FROM m)"""
)
def strict_fields(spark, sf):
    """Mined fields with continuation tables rebased and names made unique."""
    fields, _ = icd.strict_fields(part_grids(spark, sf))
    return fields.select("doc", "parent_idx", "off0", "len", "type", "resolution", "name")


@query(
    f"""{STRICT} SELECT doc || '-' || parent AS message, CASE WHEN n = 1 THEN name ELSE name || '_' || n END AS field,
    CASE WHEN type = 'Float32' THEN CASE WHEN len = 4 THEN '0' END WHEN len = 2 THEN '128.5' ELSE '8421504.5' END AS text
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc, parent, name ORDER BY k) AS n FROM m)"""
)
def mined_decode(spark, sf):
    """Fields mined from all documents decode a datagram of each message; their resolutions scale the values."""
    fields, _ = icd.strict_fields(part_grids(spark, sf))
    named = fields.withColumn("message", F.concat_ws("-", "doc", "parent_idx"))
    payload = F.unhex(F.repeat(F.lit("01"), 400))
    rows = named.select("message").distinct().select("message", F.lit("f").alias("file"), payload.alias("payload"))
    return decode.decode_long(rows, named, keys=("file",)).select("message", "field", "text")


@query(
    f"""{STRICT}, e AS (SELECT doc, parent, MAX(off - 1 + shift + len) AS n, COUNT(*) AS f FROM m GROUP BY 1, 2),
    p AS (SELECT DISTINCT doc, t FROM g WHERE t % 3 <> 2),
    s AS (SELECT doc, t, 'Message ' || t // 4 AS base, ROW_NUMBER() OVER (PARTITION BY doc, t // 4 ORDER BY t) AS i FROM p)
    SELECT s.doc, CAST(s.t AS INTEGER) AS parent_idx, CASE WHEN i = 1 THEN base ELSE base || '_' || i END AS message,
    CAST(COALESCE(e.n, 0) AS INTEGER) AS payload_len, COALESCE(e.f, 0) AS n_fields FROM s LEFT JOIN e
    ON e.doc = s.doc AND e.parent = s.t"""
)
def strict_messages(spark, sf):
    out = icd.strict_messages(part_grids(spark, sf))
    return out.select("doc", "parent_idx", "message", "payload_len", "n_fields")


@query(
    f"""WITH g AS ({GRID}) SELECT doc, CAST(t AS INTEGER) AS table_idx, CAST(r + 1 AS INTEGER) AS row_idx, name,
    type, CAST(given AS INTEGER) AS len, type IS NULL AS unknown_type FROM g"""
)
def loose_fields(spark, sf):
    """Review drafts keep every row and blank what they cannot read."""
    drafts, _ = icd.loose_fields(part_grids(spark, sf))
    return drafts.select("doc", "table_idx", "row_idx", "name", "type", "len", F.col("type").isNull().alias("unknown_type"))


@query(
    """WITH d AS (SELECT o_custkey AS c, o_orderkey AS o, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n,
        CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 50 + 1 END AS off, o_orderkey % 3 + 1 AS len FROM orders),
    s AS (SELECT *, COUNT(off) OVER (PARTITION BY c ORDER BY n) AS g FROM d)
    SELECT c AS message, o AS ord, CAST(COALESCE(MAX(off) OVER (PARTITION BY c, g), 1) + COALESCE(SUM(len) OVER
        (PARTITION BY c, g ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS "offset",
    CAST(len AS INTEGER) AS len, CASE WHEN o % 5 = 0 AND o % 4 = 0 THEN 'field_' || n ELSE 'o' || o END AS name FROM s"""
)
def finalise_fields(spark, sf):
    """Orders as field drafts of their customer; gaps in offsets are filled."""
    k = F.col("o_orderkey")
    offset = F.when(F.pmod(k, F.lit(4)) == 0, F.pmod(k, F.lit(50)) + 1).cast("int")
    nameless = (F.pmod(k, F.lit(5)) == 0) & (F.pmod(k, F.lit(4)) == 0)
    drafts = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("message"),
        k.alias("draft_ord"),
        F.when(~nameless, F.concat(F.lit("o"), k.cast("string"))).alias("name"),
        offset.alias("offset"),
        (F.pmod(k, F.lit(3)) + 1).cast("int").alias("len"),
        F.lit("Uint8").alias("type"),
        F.lit(None).cast("double").alias("resolution"),
    )
    out = icd.finalise_fields(drafts, ("message",))
    return out.select("message", F.col("draft_ord").alias("ord"), "offset", "len", "name")


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey % 9 - 1 AS size FROM orders)
    SELECT o_custkey, o_orderkey, CASE WHEN size > 0 THEN 1 + CAST(COALESCE(SUM(greatest(size, 0)) OVER (PARTITION BY o_custkey
    ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS "offset" FROM o"""
)
def offsets_from_size(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", (F.pmod("o_orderkey", F.lit(9)) - 1).cast("int").alias("size")
    )
    return icd.offsets_from_size(rows, ["o_custkey"], "o_orderkey", "size").select("o_custkey", "o_orderkey", "offset")


@query(
    """WITH n AS (SELECT o_orderkey AS o, o_custkey AS c, lower(o_orderpriority) AS key, o_orderpriority AS p FROM orders)
    SELECT o AS ord, c AS message, CASE WHEN i = 1 THEN p ELSE p || '_' || i END AS name FROM
    (SELECT *, ROW_NUMBER() OVER (PARTITION BY c, key ORDER BY o) AS i FROM n)"""
)
def unique_names(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("message"), F.col("o_orderpriority").alias("name")
    )
    return icd.unique_names(rows, ["message"], "ord", "name", fold_case=True)


@query(
    """SELECT o_orderkey AS ord, o_custkey AS message, CASE WHEN n = 1 THEN 'p' ELSE 'p_' || n END AS name FROM
    (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)"""
)
def unique_names_taken(spark, sf):
    """Every second name is the number that the one before it would get: each is looked for behind the last."""
    n = F.row_number().over(Window.partitionBy("message").orderBy("ord"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("message")).withColumn("n", n)
    named = rows.select("ord", "message", F.when(F.pmod("n", F.lit(2)) == 1, "p").otherwise(F.concat(F.lit("p_"), "n")).alias("name"))
    return icd.unique_names(named, ["message"], "ord", "name")


@query(
    """SELECT p_partkey, 'status' AS label, CAST(CASE WHEN p_size % 7 >= 4 THEN 3 WHEN p_size % 7 >= 2 THEN 2 ELSE 1 END AS INTEGER) AS bits,
    CASE WHEN p_size % 7 = 0 THEN '0=' || p_brand || ' 300: extra' ELSE '0=' || p_brand || ' 300: extra;' || p_size % 7 || '=' || p_type END AS meanings
    FROM part WHERE p_size % 7 <> 0"""
)
def enum_mining(spark, sf):
    """Enumerations in prose; a number above 255 belongs to the text before it."""
    text = F.format_string("0 = %s 300: extra  %d) %s", F.col("p_brand"), F.pmod("p_size", F.lit(7)), F.col("p_type"))
    rows = bind(table(spark, sf, "part"), {"r": icd.enum_rules(text, F.lit(" status "))})
    shown = F.transform(F.map_entries("r.meanings"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]))
    return rows.filter("r is not null").select(
        "p_partkey", "r.label", F.size("r.positions").alias("bits"), F.array_join(shown, ";").alias("meanings")
    )


@query(
    """SELECT 'M' || p_partkey // 3 AS message, p_name AS field, CAST(0 AS INTEGER) AS rule_no, 'r' || p_size % 2 AS label,
    CASE WHEN p_size % 2 = 0 THEN 'SINGLE_BIT' ELSE 'GROUPED_BITS' END AS kind, CAST(p_size % 2 AS BIGINT) AS value,
    CASE WHEN p_size % 2 = 0 THEN '0' ELSE '01' END AS "binary", p_brand AS meaning FROM part WHERE p_partkey % 5 <> 0"""
)
def bit_rules_long(spark, sf):
    """Enabled rules as value rows."""
    k, two = F.col("p_partkey"), F.pmod("p_size", F.lit(2))
    rule = F.struct(
        F.concat(F.lit(" r"), two.cast("string")).alias("label"),
        F.when(two == 0, F.array(F.lit(3))).otherwise(F.array(F.lit(3), F.lit(1))).alias("positions"),
        F.create_map(two.cast(by.U64), F.col("p_brand")).alias("meanings"),
        F.lit("UNKNOWN").alias("unknown"),
        (F.pmod(k, F.lit(5)) != 0).alias("enabled"),
        F.lit(False).alias("reserved"),
    )
    fields = table(spark, sf, "part").select(
        F.concat(F.lit("M"), F.floor(k / 3).cast("string")).alias("message"),
        F.col("p_name").alias("name"),
        F.array(rule).alias("bit_rules"),
    )
    _, meanings = schedule.bit_rules_long(fields)
    return meanings.select("message", "field", "rule_no", "label", "kind", F.col("value").cast("bigint"), "binary", "meaning")


@query(
    listed(
        """WITH p AS (SELECT p_partkey AS k, p_size % 10 AS clen, p_partkey % 4 AS c, p_size % 3 AS v, p_partkey % 6 AS n FROM part)
    SELECT 'controller_empty' AS rule, COUNT(*) AS violations FROM p WHERE c = 3
    UNION ALL SELECT 'controller_is_itself', COUNT(*) FROM p WHERE c = 1
    UNION ALL SELECT 'controller_unknown', COUNT(*) FROM p WHERE c = 2
    UNION ALL SELECT 'controller_length', COUNT(*) FROM p WHERE c = 0 AND (clen < 1 OR clen > 8)
    UNION ALL SELECT 'duplicate_controller_value', COUNT(*) FROM p WHERE v = 1
    UNION ALL SELECT 'duplicate_profile_name', COUNT(*) FROM p WHERE n = 0
    UNION ALL SELECT 'profile_label_clash', COUNT(*) FROM p WHERE n IN (0, 1)
    UNION ALL SELECT 'profile_name_empty', COUNT(*) FROM p WHERE n = 2
    UNION ALL SELECT 'exclusion_needs_two_bits', COUNT(*) FROM p WHERE v = 0
    UNION ALL SELECT 'exclusion_bit_out_of_range', COUNT(*) FROM p WHERE v = 2"""
    )
)
def profile_violations(spark, sf):
    """Parts as fields decoded by the value of another field, many of them wrong."""
    k, v, n = F.col("p_partkey"), F.pmod("p_size", F.lit(3)), F.pmod("p_partkey", F.lit(6))
    none = F.array().cast("array<struct<label:string,positions:array<int>,meanings:map<decimal(20,0),string>,unknown:string,enabled:boolean,reserved:boolean>>")
    bits = F.when(v == 0, F.array(F.lit(1))).when(v == 2, F.array(F.lit(1), F.lit(70))).otherwise(F.array(F.lit(1), F.lit(2)))
    exclusion = F.struct(bits.alias("positions"), F.lit("x").alias("label"), F.lit("bad").alias("invalid"))
    no_exclusion = F.array().cast("array<struct<positions:array<int>,label:string,invalid:string>>")

    def profile(name, value, exclusions):
        return F.struct(name.alias("name"), value.cast(by.U64).alias("value"), none.alias("rules"), exclusions.alias("exclusions"))

    second = F.when(n == 0, "P 1").when(n == 1, "P_1").when(n == 2, "").otherwise("Q")
    profiles = F.array(profile(F.lit("P 1"), F.lit(1), no_exclusion), profile(second, v, F.array(exclusion)))
    base = table(spark, sf, "part").select(k.cast("string").alias("message"), k, "p_size", profiles.alias("profiles"))
    owner = base.select(
        "message",
        F.lit("f").alias("name"),
        F.lit(1).alias("ord"),
        F.lit(8).alias("len"),
        F.element_at(F.array(F.lit("c"), F.lit("f"), F.lit("zz"), F.lit("")), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int")).alias("controller"),
        "profiles",
    )
    other = base.select("message", F.lit("c").alias("name"), F.lit(0).alias("ord"), F.pmod("p_size", F.lit(10)).cast("int").alias("len"))
    found = quality.check_profiles(owner.unionByName(other, allowMissingColumns=True))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


@query(
    listed(
        """WITH f AS (SELECT p_partkey // 4 AS c, p_partkey % 3 AS label, p_size * 2000 AS port, p_size % 6 AS n FROM part),
    d AS (SELECT DISTINCT c, n FROM f WHERE n < 5), s AS (SELECT c, COUNT(*) AS m FROM f GROUP BY 1)
    SELECT 'port' AS mode, 'port_range' AS rule, COUNT(*) AS violations FROM f WHERE port > 65535
    UNION ALL SELECT 'port', 'duplicate_label', COUNT(*) FROM (SELECT 1 FROM f GROUP BY c, label HAVING COUNT(*) > 1)
    UNION ALL SELECT 'port', 'duplicate_port', COUNT(*) FROM (SELECT 1 FROM f GROUP BY c, port HAVING COUNT(*) > 1)
    UNION ALL SELECT 'header', 'port_range', COUNT(*) FROM f WHERE port > 65535
    UNION ALL SELECT 'header', 'duplicate_label', COUNT(*) FROM (SELECT 1 FROM f GROUP BY c, label HAVING COUNT(*) > 1)
    UNION ALL SELECT 'header', 'header_too_long', COUNT(*) FROM f WHERE n = 5
    UNION ALL SELECT 'header', 'duplicate_header', COUNT(*) FROM (SELECT 1 FROM f WHERE n < 5 GROUP BY c, n HAVING COUNT(*) > 1)
    UNION ALL SELECT 'header', 'empty_header_not_alone', COUNT(*) FROM d JOIN s USING (c) WHERE n = 0 AND m > 1
    UNION ALL SELECT 'header', 'header_overlap', COUNT(*) FROM d a JOIN d b ON a.c = b.c AND a.n < b.n"""
    )
)
def filter_violations(spark, sf):
    """Parts as lists of four port or header filters."""
    k = F.col("p_partkey")
    filters = table(spark, sf, "part").select(
        F.floor(k / 4).cast("string").alias("config"),
        F.pmod(k, F.lit(4)).alias("pos"),
        F.concat(F.lit("L"), F.pmod(k, F.lit(3)).cast("string")).alias("label"),
        (F.col("p_size") * 2000).alias("port"),
        F.repeat(F.lit("a B "), F.pmod("p_size", F.lit(6)).cast("int")).alias("header_text"),
    )
    parts = [quality.check_filters(filters, m).withColumn("mode", F.lit(m)) for m in ("port", "header")]
    return parts[0].unionByName(parts[1]).groupBy("mode", "rule").agg(F.count(F.lit(1)).alias("violations"))


@query(
    listed(
        """WITH m AS (SELECT c_custkey AS k, c_custkey % 1200 AS rate, 65500 + c_custkey % 20 AS n FROM customer WHERE c_custkey % 10 <> 9)
    SELECT 'rate_out_of_range' AS rule, COUNT(*) AS violations FROM m WHERE rate <= 0 OR rate > 1000
    UNION ALL SELECT 'no_fields', COUNT(*) FROM m WHERE k % 3 = 0
    UNION ALL SELECT 'datagram_too_large', COUNT(*) FROM m WHERE n > 65507"""
    )
)
def send_violations(spark, sf):
    """Customer definitions that cannot be sent."""
    k = F.col("def_order")
    messages = customer_messages(spark, sf).withColumns(
        {"rate_hz": F.pmod(k, F.lit(1200)).cast("double"), "payload_len": (F.lit(65500) + F.pmod(k, F.lit(20))).cast("int")}
    )
    fields = messages.filter(F.pmod(k, F.lit(3)) != 0).select("message")
    connections = supplier_connections(spark, sf)
    found = quality.check_sendable(messages, fields, route.message_destinations(messages, connections), connections)
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


def part_catalogs(spark, sf):
    """One message file per part, in the three shapes a file may have, some broken."""
    k = F.col("p_partkey")
    message = F.format_string(
        '{"messageName":"%s","port":%d,"payloadLengthBytes":4,"connectionId":"c%d","hasCompareOptions":true,"compareOptions":'
        '{"checkHeader":true,"headerByteOffset":%d,"headerLength":%d,"expectedHeaderText":"AA"},"fields":[{"name":"%s","byteOffset":%d,'
        '"dataType":"%s","resolution":0.5,"hasBitfieldDecoder":true},{"byteOffsetCorrect":9}]}',
        F.col("p_name"),
        F.lit(5000) + F.col("p_size"),
        F.pmod(k, F.lit(3)),
        F.pmod("p_size", F.lit(5)),
        F.pmod(k, F.lit(3)),
        F.col("p_brand"),
        F.col("p_size"),
        F.when(F.pmod(k, F.lit(2)) == 0, "Int16").otherwise("mystery"),
    )
    text = (
        F.when(F.pmod(k, F.lit(4)) == 0, F.concat(F.lit('{"messages":['), message, F.lit("]}")))
        .when(F.pmod(k, F.lit(4)) == 1, message)
        .when(F.pmod(k, F.lit(4)) == 2, F.concat(F.lit("["), message, F.lit("]")))
        .otherwise(F.concat(F.lit("{broken"), message))
    )
    return table(spark, sf, "part").select(k.cast("string").alias("file"), text.alias("value"))


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS file, CAST(i AS INTEGER) AS ord, p_name AS message, CAST(5000 + p_size AS INTEGER) AS port,
    CASE i WHEN 0 THEN p_brand ELSE '' END AS name, CAST(CASE i WHEN 0 THEN p_size - 1 ELSE 9 END AS INTEGER) AS off0,
    CASE WHEN i = 0 AND p_partkey % 2 = 0 THEN 'Int16' ELSE 'RawUnsignedBE' END AS type,
    CAST(CASE i WHEN 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS resolution, 'c' || p_partkey % 3 AS links
    FROM part, (VALUES (0), (1)) t(i) WHERE p_partkey % 4 <> 3"""
)
def catalog_json(spark, sf):
    """Message files to definitions and fields with their defaults."""
    messages, fields, _ = parse_catalog(part_catalogs(spark, sf))
    links = messages.select("file", "port", F.array_join("connection_ids", ",").alias("links"))
    out = fields.join(links, "file")
    return out.select("file", "ord", "message", "port", "name", "off0", "type", "resolution", "links")


@query(
    listed(
        """WITH p AS (SELECT p_size % 5 AS off, p_partkey % 3 AS n FROM part WHERE p_partkey % 4 <> 3)
    SELECT 'header_length' AS rule, COUNT(*) AS violations FROM p WHERE n = 0
    UNION ALL SELECT 'header_exceeds_payload', COUNT(*) FROM p WHERE off + n > 4
    UNION ALL SELECT 'header_length_differs', COUNT(*) FROM p WHERE n = 2"""
    )
)
def compare_violations(spark, sf):
    """Rules over the checks that message files declare."""
    messages, _, _ = parse_catalog(part_catalogs(spark, sf))
    return quality.check_compare_options(messages).groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS file, CAST(i AS INTEGER) AS ord, CASE i WHEN 0 THEN p_brand ELSE 'field_2' END AS name FROM part,
    (VALUES (0), (1)) t(i) WHERE p_partkey % 4 IN (0, 1)
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), CAST(0 AS INTEGER), p_name FROM part WHERE p_partkey % 4 = 2"""
)
def field_catalog_json(spark, sf):
    """Field lists out of whole messages or bare arrays; blank names are filled."""
    texts = part_catalogs(spark, sf).withColumn("value", F.regexp_replace("value", "^[\\[]([{].*)]$", "$1"))
    named = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("file"), "p_name", "p_partkey")
    bare = F.format_string('[{"name":"%s"}, 7]', F.col("p_name"))
    rows = texts.join(named, "file").select(
        "file", F.when(F.pmod("p_partkey", F.lit(4)) == 2, bare).otherwise(F.col("value")).alias("value")
    )
    fields, _ = parse_field_catalog(rows)
    return fields.select("file", "ord", "name")


# ------------------------------------------------- bounds, texts and problems


@query("SELECT event_id, event_id % 5 <> 0 AS pair, false AS low, CAST(NULL AS BOOLEAN) AS beyond FROM events")
def bool_values(spark, sf):
    """Bytes as truth values: any bit of a range counts, a range beyond the payload has no value."""
    raw = F.unhex(by.int_hex(F.pmod("event_id", F.lit(5)) * 256, 2))
    rows = table(spark, sf, "events").select("event_id", raw.alias("p"))
    return rows.select("event_id", *[by.be_bool(F.col("p"), *at).alias(n) for n, at in (("pair", (0, 2)), ("low", (1, 1)), ("beyond", (1, 2)))])


@query(
    """SELECT c_custkey, c_name || ' é' AS whole, substr(c_name, 4, 5) AS part, CAST(NULL AS VARCHAR) AS beyond,
    c_name || ' ' || chr(65533) AS cut FROM customer"""
)
def fixed_strings(spark, sf):
    """Texts in fixed fields: zeros at the end go, a character cut in two is marked."""
    raw = F.concat(F.encode(F.concat("c_name", F.lit(" é")), "UTF-8"), F.unhex(F.lit("00" * 8)))
    rows = table(spark, sf, "customer").select("c_custkey", raw.alias("p"), F.length("c_name").alias("n"))
    p, n = F.col("p"), F.col("n")
    return rows.select(
        "c_custkey", by.fixed_string(p, F.lit(0), n + 11).alias("whole"), by.fixed_string(p, 3, 5).alias("part"),
        by.fixed_string(p, F.lit(0), n + 12).alias("beyond"), by.fixed_string(p, F.lit(0), n + 2).alias("cut"),
    )


@query(
    """SELECT o_orderkey, CAST(CAST(o_orderkey AS HUGEINT) * 18446744073709551616 + o_custkey AS VARCHAR) AS plain,
    CAST(-o_orderkey - 1 AS VARCHAR) AS signed, CAST(CAST(o_orderkey AS HUGEINT) * 4294967296 AS VARCHAR) AS shorter FROM orders"""
)
def wide_texts(spark, sf):
    """Integers of 16 and 20 bytes, unsigned and signed, as exact digits."""
    high, low = by.int_hex(F.col("o_orderkey"), 8), by.int_hex(F.col("o_custkey"), 8)
    negative = F.concat(F.lit("FF" * 12), F.hex(-F.col("o_orderkey") - 1))
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.unhex(F.concat(high, low)).alias("p"), F.unhex(negative).alias("n"), F.unhex(F.concat(F.lit("00" * 8), high, F.lit("00" * 4))).alias("s")
    )
    columns = {"plain": by.wide_integer(F.col("p"), 0, 16), "signed": by.wide_integer(F.col("n"), 0, 20, True), "shorter": by.wide_integer(F.col("s"), 0, 20)}
    return rows.select("o_orderkey", *[c.cast("string").alias(n) for n, c in columns.items()])


@query(
    """SELECT event_id, CASE WHEN event_id % 9 >= 6 THEN 16843009 END AS four, CASE WHEN event_id % 9 >= 2 THEN 257 END AS two,
    CAST(NULL AS INTEGER) AS before, CASE WHEN event_id % 9 >= 8 THEN 72340172838076673 END AS eight FROM events"""
)
def field_bounds(spark, sf):
    """Fields of payloads of 0 to 8 bytes: a field that doesn't lie wholly inside has no value."""
    layout = Message("m", 1, 0, (Field("four", 3, 4, "Uint32"), Field("two", 1, 2, "Uint16"), Field("before", 0, 1, "Uint8"), Field("eight", 1, 8, "Int64")))
    raw = F.unhex(F.repeat(F.lit("01"), F.pmod("event_id", F.lit(9)).cast("int")))
    rows = table(spark, sf, "events").select("event_id", raw.alias("payload"))
    return decode.decode_fields(rows, layout, values_only=True, keep=("event_id",))


@query(
    """SELECT event_id, concat_ws('; ', CASE WHEN event_id % 5 = 0 THEN 'talker must be 2 letters or digits' END,
    CASE WHEN event_id % 3 = 0 THEN 'token 1 contains a delimiter' END,
    CASE WHEN event_id % 7 = 0 THEN 'token 2 is not printable ASCII' END) AS problems,
    event_id % 5 <> 0 AND event_id % 3 <> 0 AND event_id % 7 <> 0 AS built FROM events"""
)
def sentence_problems(spark, sf):
    """Sentences that cannot be written, with all their problems; they have no payload."""
    tokens = {
        1: F.when(F.pmod("event_id", F.lit(3)) == 0, "1,2").otherwise("12"),
        2: F.when(F.pmod("event_id", F.lit(7)) == 0, "é").otherwise("N"),
    }
    talker = F.when(F.pmod("event_id", F.lit(5)) == 0, "G").otherwise("GP")
    out = nmea.build_sentences(table(spark, sf, "events"), "GLL", tokens, talker)
    return out.select("event_id", F.coalesce("problems", F.lit("")).alias("problems"), F.col("payload").isNotNull().alias("built"))


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '0D0A' WHEN 1 THEN '4141' ELSE 'N/A' END AS "TerminatorObserved", '0D0A' AS "TerminatorExpected",
    CASE event_id % 3 WHEN 0 THEN 'True' ELSE 'False' END AS "TerminatorOK",
    CASE event_id % 3 WHEN 1 THEN 'Terminator mismatch (got 4141, expected 0D0A)' WHEN 2 THEN 'Terminator OutOfBounds' ELSE '' END AS reason FROM events"""
)
def terminators(spark, sf):
    """The last two bytes against carriage return and line feed; payloads of one byte have none."""
    kind = F.pmod("event_id", F.lit(3))
    raw = F.when(kind == 0, F.encode(F.lit("ab\r\n"), "US-ASCII")).when(kind == 1, F.encode(F.lit("xAA"), "US-ASCII")).otherwise(F.encode(F.lit("A"), "US-ASCII"))
    rows = table(spark, sf, "events").select("event_id", raw.alias("payload"))
    columns, reason = verify.check_terminator(F.col("payload"), -1, 2, b"\r\n")
    return rows.select("event_id", *[c.alias(n) for n, c in columns.items()], F.coalesce(reason, F.lit("")).alias("reason"))


@query(
    "SELECT event_id, 'real' AS field, '1.6777217E7' AS sent, '1.6777216E7' AS got FROM events WHERE event_id % 4 = 0"
)
def roundtrip_faults(spark, sf):
    """Planted values that single precision cannot hold come back changed, and only they are told."""
    layout = Message("m", 1, 12, (Field("whole", 1, 4, "Uint32"), Field("real", 5, 4, "Float32"), Field("scaled", 9, 4, "Int32", 0.5)))
    real = F.when(F.pmod("event_id", F.lit(4)) == 0, F.lit(16777217.0)).otherwise(F.pmod("event_id", F.lit(100)).cast("double"))
    values = {"whole": F.col("event_id"), "real": real, "scaled": F.pmod("event_id", F.lit(50)) / 2}
    out = schedule.roundtrip_check(table(spark, sf, "events"), layout, ["event_id"], values)
    return out.select("event_id", "field", "sent", "got")


@query(f"SELECT event_type AS message, event_id, {TYPE_ID} AS msg_id, user_id % 65536 AS user_id, 'True' AS \"ChecksumOK\" FROM events")
def decoded_outputs(spark, sf):
    """Every message's values and checks, written by one job and read back."""
    from wirelens.sources.sinks import write_decoded

    path = work_path(spark, "decoded")
    messages = [Message(m.name, m.port, m.length, m.fields[:5], header=m.header, checks=m.checks) for m in we.event_messages()]
    written = write_decoded(_routed(spark, sf), messages, path, "run", path + "-staged")
    parts = [spark.read.parquet(p).select(F.lit(m.name).alias("message"), "event_id", "msg_id", "user_id", "ChecksumOK") for p, m in zip(written, messages, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    f"""WITH e AS (SELECT *, event_id % 8 AS f FROM events), c AS (
    SELECT event_id, event_type, 'event_id' AS "column", CAST(event_id AS VARCHAR) AS text FROM e
    UNION ALL SELECT event_id, event_type, 'flags_low_bit', CASE f % 2 WHEN 0 THEN 'even' ELSE 'odd' END FROM e
    UNION ALL SELECT event_id, event_type, 'flags_upper', CASE f // 2 WHEN 0 THEN 'none' WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'UNKNOWN(11)' END FROM e
    UNION ALL SELECT event_id, event_type, 'HeaderOK', 'True' FROM e
    UNION ALL SELECT event_id, event_type, 'MsgIdOK', CASE event_type WHEN 'click' THEN 'True' ELSE 'False' END FROM e)
    SELECT event_id AS packet_no, event_type AS message, "column", text FROM c"""
)
def mixed_outputs(spark, sf):
    """Values, bit meanings and checks of all messages in one long table."""
    from wirelens.sources import sinks

    out = sinks.mixed_outputs(_routed(spark, sf), we.event_messages(), work_path(spark, "mixed"))
    shown = ("event_id", "flags_low_bit", "flags_upper", "HeaderOK", "MsgIdOK")
    return out.filter(F.col("column").isin(*shown)).select("packet_no", "message", "column", "text")


def _write_document(path: str):
    """Each document's tables as a file of the word processor's format, one file for each group."""

    def run(pdf):
        import io
        import zipfile
        from xml.sax.saxutils import escape

        import pandas as pd

        from wirelens.sources.captures import store_of

        body = []
        for _, rows in pdf.sort_values(["table_idx", "row_idx"]).groupby("table_idx"):
            cells = lambda r: "".join(f"<w:tc><w:p><w:r><w:t>{escape(c)}</w:t></w:r></w:p></w:tc>" for c in r)
            body.append(f"<w:p><w:r><w:t>{escape(rows['heading'].iloc[0])}</w:t></w:r></w:p>")
            body.append("<w:tbl>" + "".join(f"<w:tr>{cells(r)}</w:tr>" for r in rows["cells"]) + "</w:tbl>")
        space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{"".join(body)}</w:body></w:document>')
        store, root = store_of(path)
        store.create_dir(root)
        doc = int(pdf["doc"].iloc[0])
        with store.open_output_stream(f"{root}/d{doc}.docx") as out:
            out.write(held.getvalue())
        return pd.DataFrame({"doc": [doc]})

    return run


@query(
    """WITH g AS (SELECT p_partkey AS k, p_partkey // 200 AS doc, (p_partkey // 20) % 10 AS t, p_partkey % 20 AS r, p_name || ' ' || p_partkey % 9 AS name,
      CASE p_size % 4 WHEN 0 THEN 'Uint16' WHEN 1 THEN 'float' WHEN 2 THEN 'uint' ELSE 'odd' END AS type,
      CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 2 = 0 THEN '2' ELSE '4 bytes' END AS len FROM part),
    x AS (SELECT doc, t, CAST(r + 1 AS INTEGER) AS row_idx, name || '|' || (r * 4 + 1) || '|' || type || '|' || len || '|0.5' AS cells FROM g
      UNION ALL SELECT doc, t, 0, 'Field Name|Byte Offset|Data Type|Length|Resolution' FROM g WHERE r = 0),
    y AS (SELECT doc, t, row_idx, cells, CASE WHEN t % 3 = 2 THEN 'Message (cont.)' ELSE 'Message ' || t // 4 END AS heading FROM x)
    SELECT doc, CAST(dense_rank() OVER (PARTITION BY doc ORDER BY t) - 1 AS INTEGER) AS table_idx, heading,
    CAST(row_number() OVER (PARTITION BY doc, t ORDER BY row_idx) - 1 AS INTEGER) AS row_idx, cells FROM y"""
)
def document_tables(spark, sf):
    """Parts written as documents with tables, and read again with headings, places and cells."""
    path = work_path(spark, "documents")
    part_grids(spark, sf).groupBy("doc").applyInPandas(_write_document(path), "doc long").write.format("noop").mode("overwrite").save()
    rows, _ = read_icd_tables(spark, path)
    doc = F.regexp_extract("doc", "/d([0-9]+)[.]docx$", 1).cast("long")
    return rows.select(doc.alias("doc"), "table_idx", "heading", "row_idx", F.array_join("cells", "|").alias("cells"))


# ------------------------------------------------------- captures and streams


@query(
    f"""SELECT event_id, epoch_us(ts) AS us, CAST(5000 + {TYPE_ID} AS INTEGER) AS dst_port, CAST(24 AS INTEGER) AS payload_size FROM events"""
)
def capture_roundtrip(spark, sf):
    """Frames written as capture files, found, split, read and dissected again."""
    framed = udp_frames(we.event_datagrams(we.events(spark, sf)))
    path = work_path(spark, "captures")
    write_capture(framed, path)
    rows = dissect.valid_datagrams(dissect.dissect_frames(read_pcapng(spark, path, 1 << 18)))
    return rows.select(
        by.be_unsigned(F.col("payload"), 3, 4).alias("event_id"), F.unix_micros("ts").alias("us"), "dst_port", "payload_size"
    )


@query("""SELECT event_id, CAST(5000 + 1 AS INTEGER) AS dst_port FROM events""".replace("5000 + 1", f"5000 + {TYPE_ID}"))
def capture_append(spark, sf):
    """Two writes to one folder; every frame of both is read back."""
    framed = udp_frames(we.event_datagrams(we.events(spark, sf)))
    path = work_path(spark, "captures")
    even = F.pmod("packet_no", F.lit(2)) == 0
    write_capture(framed.filter(even), path)
    write_capture(framed.filter(~even), path)
    rows = dissect.valid_datagrams(dissect.dissect_frames(read_pcapng(spark, path, 1 << 18)))
    return rows.select(by.be_unsigned(F.col("payload"), 3, 4).alias("event_id"), "dst_port")


#: Kinds of captures: (little-endian, nanoseconds) of classic ones, None for blocks.
KINDS = {"pcap_le": (True, False), "pcap_be": (False, False), "pcap_le_ns": (True, True), "pcap_be_ns": (False, True), "pcapng": None}


def _kind(file: Column) -> Column:
    return F.regexp_extract(file, "/kind=([a-z_]+)/", 1)


def _captures_of_all_kinds(spark, sf, partitions: int = 3):
    """Every event in a capture of every kind, a few files each."""
    framed = udp_frames(we.event_datagrams(we.events(spark, sf)))
    path = work_path(spark, "kinds")
    for kind, classic in KINDS.items():
        write_capture(framed.repartitionByRange(partitions, "packet_no").sortWithinPartitions("packet_no"), f"{path}/kind={kind}", classic=classic)
    return path


def _event_ids(packets):
    return dissect.valid_datagrams(dissect.dissect_frames(packets)).withColumn("event_id", by.be_unsigned(F.col("payload"), 3, 4))


@query(
    f"""SELECT kind, event_id, epoch_us(ts) AS us, CAST(5000 + {TYPE_ID} AS INTEGER) AS dst_port FROM events,
    (VALUES ('pcap_le'), ('pcap_be'), ('pcap_le_ns'), ('pcap_be_ns'), ('pcapng')) v(kind)"""
)
def pcap_read(spark, sf):
    """Classic captures of both byte orders and resolutions, and block captures, through the data source."""
    path = _captures_of_all_kinds(spark, sf)
    packets = read_indexed(spark, path, path + "-index", range_bytes=1 << 17)
    return _event_ids(packets).select(_kind(F.col("file")).alias("kind"), "event_id", F.unix_micros("ts").alias("us"), "dst_port")


@query(
    """SELECT kind, 'PCAP' AS format, kind LIKE '%ns' AS nanoseconds, CASE WHEN kind LIKE '%be%' THEN '>' ELSE '<' END AS byte_order,
    1 AS link_type FROM (VALUES ('pcap_le'), ('pcap_be'), ('pcap_le_ns'), ('pcap_be_ns')) v(kind)
    UNION ALL SELECT 'pcapng', 'PCAPNG', false, '<', NULL"""
)
def capture_kinds(spark, sf):
    """Format, byte order and resolution that the heads of captures tell."""
    path = _captures_of_all_kinds(spark, sf, partitions=1)
    told = capture_format(index_captures(capture_files(spark, path), 1 << 17))
    return told.select(_kind(F.col("file")).alias("kind"), "format", "nanoseconds", "byte_order", "link_type").distinct()


@query(
    f"""WITH e AS (SELECT event_id, epoch_us(ts) AS us, CAST(5000 + {TYPE_ID} AS INTEGER) AS dst_port,
      ROW_NUMBER() OVER (ORDER BY ts, event_id) AS packet_no FROM events),
    w AS (SELECT quantile_disc(epoch_us(ts), 0.4) AS lo, quantile_disc(epoch_us(ts), 0.5) AS hi FROM events)
    SELECT event_id, us, dst_port, packet_no FROM e, w WHERE us >= lo AND us < hi AND dst_port IN (5001, 5004)"""
)
def capture_pruned(spark, sf):
    """A time window and two ports of one capture; filters reach the ranges, numbers are those of the whole capture."""
    events = we.events(spark, sf)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # events are put in order before they are encoded, so that the sample of the range cut doesn't encode them too
    ordered = events.repartitionByRange(parts, "ts", "event_id").sortWithinPartitions("ts", "event_id")
    path = work_path(spark, "pruned")
    write_capture(udp_frames(we.event_datagrams(ordered)), path, classic=(True, False), one_file=True)
    packets = read_indexed(spark, path, path + "-index", range_bytes=1 << 16)
    cuts = values_at(events, F.unix_micros("ts"), [0.4, 0.5])
    lo, hi = (F.timestamp_micros(F.lit(c or 0)) for c in cuts)
    some = packets.filter((F.col("ts") >= lo) & (F.col("ts") < hi) & F.col("dst_port").isin(5001, 5004))
    return _event_ids(some).select("event_id", F.unix_micros("ts").alias("us"), "dst_port", "packet_no")


@query(
    """WITH n AS (SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1),
    k(i, reason, cut, behind) AS (VALUES (0, 'truncated_packet_header', 9, 0), (1, 'bad_packet_size', 0, 8), (2, 'truncated_packet_data', 9, 16))
    SELECT event_type, n AS packets, reason, 24 + 82 * n + behind AS position FROM n CROSS JOIN k"""
)
def capture_faults(spark, sf):
    """A capture of each event type with a fault behind its last packet: where it is met, and that all packets before it are read."""
    events = we.events(spark, sf).withColumn("user_id", F.pmod("user_id", F.lit(65536)))  # users beyond the field's two bytes wrap
    datagrams = we.event_datagrams(events).withColumn("event_type", F.get(F.array(*map(F.lit, we.EVENT_TYPES)), F.col("dst_port") - 5001))
    framed = udp_frames(datagrams)
    path = work_path(spark, "faults")
    head = F.unhex(F.lit("00" * 8))
    tails = {"truncated_packet_header": F.unhex(F.lit("11" * 9)), "bad_packet_size": F.concat(head, F.unhex(F.lit("00" * 8))), "truncated_packet_data": F.concat(head, F.unhex(F.lit("32000000" * 2 + "AA" * 9)))}
    # encoded once for all fifteen captures
    kept = work_path(spark, "records")
    records = framed.select("event_type", F.col("packet_no").alias("at"), F.unhex(packet_record_hex(F.unix_micros("ts"), F.col("frame"))).alias("block"))
    records.write.partitionBy("event_type").parquet(kept)
    records = spark.read.schema(records.select("at", "block", "event_type").schema).parquet(kept)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for kind in we.EVENT_TYPES:
        own = records.filter((F.col("event_type") == kind) & F.col("block").isNotNull()).select("at", "block")
        for reason, tail in tails.items():
            whole = own.unionByName(own.limit(1).select(F.lit(1 << 62).alias("at"), tail.alias("block")))
            write_records(whole.repartitionByRange(parts, "at").sortWithinPartitions("at").select("block"), f"{path}/type={kind}/{reason}", one_file=True)
    files = capture_files(spark, path)
    index = index_captures(files, 1 << 16)
    read = read_captures(files, index).groupBy("file").agg(F.count("*").alias("packets"))
    told = capture_errors(index).join(read, "file")
    return told.select(F.regexp_extract("file", "/type=([a-z]+)/", 1).alias("event_type"), "packets", "reason", "position")


@query(
    f"""SELECT event_id, epoch_us(ts) AS us, CAST(5000 + {TYPE_ID} AS INTEGER) AS dst_port, 'line' || (event_id % 3) AS connection_id FROM events"""
)
def live_captures(spark, sf):
    """Captures that appear and a capture that grows between three starts of one streaming query; every packet once."""
    framed = udp_frames(we.event_datagrams(we.events(spark, sf)))
    path = work_path(spark, "incoming")
    out = path + "-out"
    for k in range(3):
        own = framed.filter(F.pmod("packet_no", F.lit(3)) == k)
        write_capture(own.coalesce(2), f"{path}/connection=line{k}", classic=(k == 0, k == 1) if k < 2 else None)
        packets = stream_captures(spark, path, positions=path + "-positions")
        rows = _event_ids(packets).select("event_id", F.unix_micros("ts").alias("us"), "dst_port", "connection_id")
        writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", path + "-state")
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of part files."""
    path = f"{sf}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a glob, as the source only takes folders and patterns: it fits the file or the folder's files
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


@query(
    """SELECT event_id AS packet_no, event_type AS message, CAST(user_id AS VARCHAR) AS text FROM events"""
)
def live_decode_events(spark, sf):
    """The event stream routed by first match and decoded in long form."""
    from wirelens.streaming import live

    events = stream_of(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    # Headers must tell the types apart when ports are not checked.
    layouts = [
        Message(n, 5001 + i, 24, we.BASE_FIELDS[3:4], bytes.fromhex(f"AA55{i + 1:02X}")) for i, n in enumerate(we.EVENT_TYPES)
    ]
    values = live.live_values(we.event_datagrams(events), layouts)
    path = work_path(spark, "live")
    writer = values.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("packet_no", "message", "text")


@query(
    """SELECT event_id, COUNT(*) OVER (PARTITION BY event_type ORDER BY epoch_ms(ts)
    RANGE BETWEEN 600000 PRECEDING AND CURRENT ROW) AS refresh_hz FROM events"""
)
def live_refresh_rate(spark, sf):
    """Arrivals per type in the last ten minutes, counted by the streaming operator."""
    from wirelens.streaming import live

    rows = stream_of(spark, sf, "events").select(
        F.col("event_id").alias("packet_no"), F.col("event_type").alias("message"), F.col("ts").cast("timestamp").alias("ts")
    )
    path = work_path(spark, "rates")
    live.live_refresh_rate(rows, path, path + "-state", window_ms=600_000).awaitTermination()
    return spark.read.parquet(path).select(F.col("packet_no").alias("event_id"), "refresh_hz")


@query(
    """WITH e AS (SELECT event_id, event_type, user_id, epoch_ms(ts) * 1000000 + event_id % 1000000 AS stamp FROM events)
    SELECT event_id, CAST(COALESCE(SUM(user_id) OVER w, 0) AS BIGINT) AS total, MAX(user_id) OVER w AS top FROM e
    WINDOW w AS (PARTITION BY event_type ORDER BY stamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def running_stamps(spark, sf):
    """Running totals over time stamps: no chunk of their values holds an even share, so rows are cut at sampled splitters."""
    at = F.unix_millis(F.col("ts").cast("timestamp")) * 1_000_000 + F.pmod("event_id", F.lit(1_000_000))
    rows = we.events(spark, sf).select("event_id", "event_type", "user_id", at.alias("at"))
    out = running(rows, ["event_type"], "at", {"total": ("sum", F.col("user_id")), "top": ("max", F.col("user_id"))}, chunk=None)
    return out.select("event_id", "total", "top")


def _in_steps(spark, rows, by_time, path: str, run, parts: int = 4) -> None:
    """Land rows in order of time, a part at a time, and ``run(stream)`` over what is there after each: a restart every time."""
    at = F.unix_micros(by_time)
    cuts = values_at(rows, at, [k / parts for k in range(1, parts)])
    edges = [None, *[c or 0 for c in cuts], None]
    for lo, hi in zip(edges, edges[1:], strict=False):
        some = rows if lo is None else rows.filter(at >= lo)
        (some if hi is None else some.filter(at < hi)).write.mode("append").parquet(path)
        run(spark.readStream.schema(rows.schema).parquet(path))


def _to_folder(frames, path: str) -> None:
    writer = frames.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").outputMode("append")
    writer.trigger(availableNow=True).start().awaitTermination()


@query(
    """WITH e AS (SELECT event_id, event_type, epoch_ms(ts) AS ms FROM events)
    SELECT event_id, COUNT(*) OVER (PARTITION BY event_type ORDER BY ms RANGE BETWEEN 600000 PRECEDING AND CURRENT ROW)
    - COUNT(*) OVER (PARTITION BY event_type, ms) + ROW_NUMBER() OVER (PARTITION BY event_type, ms ORDER BY event_id) AS refresh_hz FROM e"""
)
def live_rates(spark, sf):
    """Rates from the state store over four starts of a query; a row at the end of time brings out the last ones."""
    from wirelens.streaming import stateful

    rows = we.events(spark, sf).select(
        F.col("event_id").alias("packet_no"), F.col("event_type").alias("message"), F.col("ts").cast("timestamp").alias("ts")
    )
    path = work_path(spark, "arrivals")
    end = rows.limit(1).select(F.lit(-1).cast("long").alias("packet_no"), F.lit("").alias("message"), F.lit("2200-01-01").cast("timestamp").alias("ts"))

    def run(stream):
        _to_folder(stateful.stateful_refresh_rate(stream, window_ms=600_000, bucket_ms=6 * 3_600_000, delay="1 minute"), path + "-out")

    _in_steps(spark, rows, "ts", path, run)
    end.write.mode("append").parquet(path)
    run(spark.readStream.schema(rows.schema).parquet(path))
    return spark.read.parquet(path + "-out").filter("packet_no >= 0").select(F.col("packet_no").alias("event_id"), "refresh_hz")


def _live_outputs(spark, sf):
    """Events decoded live in four starts of one query; the path, the messages and the metrics of every batch."""
    import dataclasses

    from wirelens.streaming import live

    checks = dataclasses.replace(we.CHECKS, refresh_rate=(2, 1))
    layouts = [
        Message(n, 5001 + i, 24, we.BASE_FIELDS[:5], header=bytes.fromhex(f"AA55{i + 1:02X}"), checks=checks) for i, n in enumerate(we.EVENT_TYPES)
    ]
    path = work_path(spark, "live")
    metrics: list = []
    events = we.events(spark, sf).withColumn("user_id", F.pmod("user_id", F.lit(65536)))  # users beyond the field's two bytes wrap, as the SQL has it
    rows = we.event_datagrams(events).withColumn("connection_id", F.lit("c1"))

    def run(stream):
        query = live.live_decode(stream, layouts, path, path + "-state")
        query.awaitTermination()
        metrics.extend(live.metrics_of(query))

    _in_steps(spark, rows, "ts", path + "-in", run)
    return path, layouts, metrics


@query(
    f"""WITH e AS (SELECT *, epoch_ms(ts) AS ms FROM events), r AS (
      SELECT *, COUNT(*) OVER (PARTITION BY event_type ORDER BY ms RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW)
      - COUNT(*) OVER (PARTITION BY event_type, ms) + ROW_NUMBER() OVER (PARTITION BY event_type, ms ORDER BY event_id) AS hz FROM e)
    SELECT event_type AS message, event_id, {TYPE_ID} AS msg_id, user_id % 65536 AS user_id, 'True' AS "HeaderOK", 'True' AS "ChecksumOK",
    'True' AS "DataLenOK", hz AS refresh_hz, CASE WHEN abs(hz - 2) <= 1 THEN 'True' ELSE 'False' END AS "RefreshRateOK" FROM r"""
)
def live_decode(spark, sf):
    """Values and checks of every message, written live by one job a batch with one commit; rates carried across restarts."""
    from wirelens.sources.sinks import output_name

    path, layouts, _ = _live_outputs(spark, sf)
    out = None
    for m in layouts:
        rows = spark.read.parquet(f"{path}/{output_name(m, 'live')}").select(
            F.lit(m.name).alias("message"), "event_id", "msg_id", "user_id", "HeaderOK", "ChecksumOK", "DataLenOK",
            F.col("RefreshRateObservedHz").alias("refresh_hz"), "RefreshRateOK",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT COUNT(*) AS received, COUNT(*) AS matched, 0 AS short_packets, 4 AS batches FROM events")
def live_metrics(spark, sf):
    """What the running query told of itself: datagrams received and matched, and short packets, over its batches."""
    _, _, metrics = _live_outputs(spark, sf)
    told = spark.createDataFrame(metrics, "batch long, name string, metric string, value long").filter("value IS NOT NULL")
    sums = [F.sum(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ("received", "matched", "short_packets")]
    return told.agg(*sums, F.count_distinct(F.when(F.col("value") > 0, F.col("batch"))).alias("batches"))


@query(
    """WITH c AS (SELECT doc_id // 7 AS k, string_agg(hex(encode(text)), '' ORDER BY doc_id) AS h FROM documents GROUP BY 1),
    f AS (SELECT k, h, unnest(range(0, length(h) // 200)) AS i FROM c)
    SELECT k AS connection_id, i AS frame_no, md5(substr(h, CAST(i * 200 + 1 AS BIGINT), 200)) AS digest FROM f"""
)
def live_frames(spark, sf):
    """Documents arriving out of order as chunks of byte streams, framed from the state store over three starts of a query."""
    from wirelens.streaming import stateful

    sized = table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 7).cast("string").alias("connection_id"), "doc_id", F.encode("text", "UTF-8").alias("chunk")
    )
    # a stream here is seven documents, so a window over one is small
    before = Window.partitionBy("connection_id").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    position = F.coalesce(F.sum(F.coalesce(F.octet_length("chunk"), F.lit(0))).over(before), F.lit(0))
    rows = sized.select("connection_id", "doc_id", position.alias("position"), "chunk", F.timestamp_seconds(F.col("doc_id") + 1).alias("ts"))
    path = work_path(spark, "chunks")
    for k in (2, 0, 1):
        rows.filter(F.pmod("doc_id", F.lit(3)) == k).coalesce(2).write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        _to_folder(stateful.stateful_reframe(stream, 100, delay="36500 days"), path + "-out")
    done = spark.read.parquet(path + "-out").filter("complete")
    return done.select(F.col("connection_id").cast("long").alias("connection_id"), "frame_no", F.md5(F.encode(F.hex("payload"), "UTF-8")).alias("digest"))


@query(
    """WITH c AS (SELECT doc_id // 7 AS k, string_agg(hex(encode(text)), '' ORDER BY doc_id) AS h FROM documents GROUP BY 1),
    f AS (SELECT k, h, unnest(range(0, length(h) // 200)) AS i FROM c)
    SELECT k AS connection_id, i AS frame_no, md5(substr(h, CAST(i * 200 + 1 AS BIGINT), 200)) AS digest FROM f"""
)
def live_reframe(spark, sf):
    """Documents arriving as byte streams, framed by the streaming operator."""
    from wirelens.streaming import live

    chunks = stream_of(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 7).alias("connection_id"),
        F.col("doc_id").alias("seq"),
        F.encode("text", "UTF-8").alias("chunk"),
        F.lit(None).cast("timestamp").alias("ts"),
    )
    path = work_path(spark, "frames")
    live.live_reframe(chunks, 100, path, path + "-state").awaitTermination()
    rows = spark.read.parquet(path)
    return rows.select("connection_id", "frame_no", F.md5(F.encode(F.hex("payload"), "UTF-8")).alias("digest"))
