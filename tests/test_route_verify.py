import random
import struct
from collections import deque

from pyspark.sql import functions as F

from wirelens.operators import route, summary, verify
from wirelens.plans.model import Checks, Connection, Field, Message, check_headers, connections_frame, fields_frame, messages_frame

MESSAGES = [
    Message("plain", 5000, 4, (Field("a", 1, 2, "Uint16"),)),
    Message("headed", 5000, 4, (Field("a", 1, 2, "Uint16"),), header=b"\xaa\x55"),
    Message("long", 5000, 6, header=b"\xaa"),
    Message("other", 6000, 4, connection_id="c2"),
    Message("gga", 5000, format="NMEA", sentence="gga"),
    Message("zda", 6000, format="NMEA", sentence="ZDA", connection_id="c1"),
]
DATAGRAMS = [
    (1, 5000, 1, b"\xaa\x55\0\1", "c1"),
    (2, 1, 5000, b"\0\0\0\1", "c2"),
    (3, 5000, 6000, b"\0\0\0\1", None),
    (4, 7000, 7001, b"\xaa\x55\0\1", "c2"),
    (5, 5000, 5000, b"\xaa\1\2\3\4\5", ""),
    (6, 5000, 6000, b"x$$GPGGA,1*00\r\n$gpzda", "c1"),
    (7, 5000, 6000, b"$GPZDA,1", "c2"),
    (8, 5000, 5000, b"", "c1"),
    (9, 5000, 5000, b"\xff$\xdf\xdfgga", "c1"),
]


def datagrams(spark):
    rows = [("f", n, s, d, len(p), bytearray(p), c) for n, s, d, p, c in DATAGRAMS]
    return spark.createDataFrame(
        rows, "file string, packet_no long, src_port int, dst_port int, payload_size int, payload binary, connection_id string"
    )


def pairs(df):
    return sorted((r.packet_no, r.message) for r in df.collect())


ALL = [(1, "headed"), (1, "plain"), (2, "plain"), (3, "other"), (3, "plain"), (5, "long"), (6, "gga"), (6, "zda"), (7, "zda"), (9, "gga")]


def test_all_matches_in_both_join_forms(spark):
    df = datagrams(spark)
    assert pairs(route.route(df, MESSAGES)) == ALL
    table = messages_frame(spark, MESSAGES)
    assert pairs(route.route(df, table)) == ALL
    assert pairs(route.route(df, table, max_broadcast_rows=0)) == ALL


def test_first_match_by_definition_order(spark):
    df = datagrams(spark)
    free = [(1, "plain"), (2, "plain"), (3, "plain"), (4, "plain"), (5, "long"), (6, "gga"), (7, "zda"), (9, "gga")]
    bound = [(1, "plain"), (2, "plain"), (3, "plain"), (4, "plain"), (5, "long"), (6, "gga"), (9, "gga")]
    table = messages_frame(spark, MESSAGES)
    for defs in (MESSAGES, table):
        for bounded in (50_000, 0):
            assert pairs(route.route(df, defs, "first", max_broadcast_rows=bounded)) == free
            assert pairs(route.route(df, defs, "first", connection="connection_id", max_broadcast_rows=bounded)) == bound
    late = MESSAGES[3:4] + MESSAGES[:1]
    got = pairs(route.route(df, late, "first", connection="connection_id"))
    assert got == [(1, "plain"), (2, "other"), (3, "other"), (4, "other")]


def test_presence_destinations_and_frame_length(spark):
    df = datagrams(spark)
    extra = MESSAGES + [Message("never", 5000, 99)]
    assert [r.message for r in route.messages_missing(df, extra).collect()] == ["never"]
    assert route.messages_present(df, extra).count() == len(MESSAGES)
    conns = connections_frame(spark, [Connection("a", transport="UDP"), Connection("b"), Connection("c")])
    sends = messages_frame(
        spark,
        [
            Message("many", connection_ids=("b", "b", "zz", "a")),
            Message("single", connection_id="c"),
            Message("stale", connection_ids=("zz",)),
            Message("free"),
        ],
    )
    got = sorted((r.message, r.connection_id) for r in route.message_destinations(sends, conns).collect())
    assert got == [("free", "a"), ("many", "a"), ("many", "b"), ("single", "c"), ("stale", "a")]
    lengths = messages_frame(spark, [Message("x", 1, 8, connection_id="a"), Message("y", 1, 9, connection_id="b"), Message("z", 1, 9), Message("n", format="NMEA")])
    out = {r.connection_id: r.frame_length for r in route.connection_frame_length(lengths, conns).collect()}
    assert out == {"a": 0, "b": 9, "c": 9}


def test_signatures_and_overlaps(spark):
    defs = messages_frame(spark, [Message("a", 1, 8, header=b"\1"), Message("b", 1, 8, header=b"\1"), Message("c", 1, 8), Message("d", 1, format="NMEA", sentence="GGA"), Message("e", 1, format="NMEA", sentence="gga")])
    assert {(r.signature, r.definitions) for r in route.match_signatures(defs).collect()} == {("HEX:8:01", 2), ("NMEA:GGA", 2)}
    heads = spark.createDataFrame([(bytearray(h),) for h in (b"", b"\1", b"\1\2", b"\1\2\3", b"\2", b"\1")], "header binary")
    got = sorted((r.shorter, r.longer) for r in route.header_overlaps(heads).collect())
    assert got == [("", "01"), ("", "0102"), ("", "010203"), ("", "02"), ("01", "0102"), ("01", "010203"), ("0102", "010203")]


def queue_counts(times, window):
    queue, out = deque(), []
    for t in times:
        queue.append(t)
        while queue[0] < t - window:
            queue.popleft()
        out.append(len(queue))
    return out


def rates(spark, streams, window, **options):
    rows = [(f, m, n, t) for (f, m), times in streams.items() for n, t in enumerate(times)]
    df = spark.createDataFrame(rows, "file string, message string, packet_no long, ms long")
    df = df.repartition(5).withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    out = verify.refresh_rate(df, window_ms=window, **options)
    got = {}
    for r in out.orderBy("packet_no").collect():
        got.setdefault((r.file, r.message), []).append(r.refresh_hz)
    return got


def test_refresh_rate_of_ordered_clocks(spark):
    rng = random.Random(5)
    streams = {("f", m): sorted(rng.choices(range(6000), k=400)) for m in "abc"}
    streams["f", "stuck"] = [0] * 500
    streams["g", "a"] = [7, 7, 1007, 1008, 2008]
    want = {k: queue_counts(v, 1000) for k, v in streams.items()}
    assert rates(spark, streams, 1000, chunk=16, bucket_ms=1500) == want
    assert rates(spark, streams, 1000, bucket_ms=10) == want
    assert rates(spark, streams, 1000, exact=True, chunk=16, bucket_ms=1500) == want


def test_refresh_rate_when_clocks_step_back(spark):
    rng = random.Random(11)
    streams = {}
    for k in range(6):
        t, times = 0, []
        for _ in range(500):
            t += rng.randint(0, 60)
            times.append(max(0, t - (rng.randint(1, 5000) if rng.random() < 0.03 * k else 0)))
        streams["f", str(k)] = times
    want = {k: queue_counts(v, 1000) for k, v in streams.items()}
    assert rates(spark, streams, 1000, exact=True, chunk=32, bucket_ms=2000) == want


def test_one_stamp_far_in_the_future(spark):
    """The queue of the key never empties again; no task gets the rest of the key."""
    rng = random.Random(2)
    times = [i * 40 - rng.randrange(300) for i in range(1000, 5000)]
    times[25] = 4_102_444_800_000
    streams = {("f", "a"): times, ("f", "b"): [0] * 300, ("f", "c"): [5], ("g", "a"): times[:20]}
    want = {k: queue_counts(v, 1000) for k, v in streams.items()}
    assert rates(spark, streams, 1000, exact=True, chunk=64, bucket_ms=4000) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame([("f", "a", i, t) for i, t in enumerate(times)], "file string, message string, packet_no long, ms long")
        out = verify.refresh_rate(df.withColumn("ts", F.timestamp_millis("ms")), window_ms=1000, exact=True, chunk=64, bucket_ms=4000)
        shares = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(shares) == len(times) and len(shares) == 8 and max(shares) < 2.5 * len(times) / 8


def test_check_columns(spark):
    checks = Checks(
        header=(0, 2), expected_header=b"\xaa\x55", terminator=(-1, 1), expected_terminator=b"\x0d",
        checksum=("SUM", 0, 4, 4, 2), refresh_rate=(3, 1), endianness="LITTLE", data_length=(2, 1, 1), message_id=(3, 1, 0x1F),
    )
    m = Message("m", 1, 7, (Field("v", 1, 2, "Int16"), Field("b", 3, 1, "Uint8")), checks=checks)
    good = bytes.fromhex("AA55061F") + (0xAA + 0x55 + 6 + 0x1F).to_bytes(2, "big") + b"\x0d"
    bad = bytes.fromhex("AB550500000000")
    rows = [("f", i, "m", bytearray(p), 7) for i, p in enumerate([good, bad, good[:2]])]
    df = spark.createDataFrame(rows, "file string, packet_no long, message string, payload binary, payload_size int")
    df = df.withColumn("ts", F.timestamp_millis(F.col("packet_no") * 10))
    a, b, c = verify.verify(df, m).select("packet_no", *check_headers(m)).orderBy("packet_no").collect()
    assert (a.HeaderOK, a.TerminatorOK, a.ChecksumOK, a.DataLenOK, a.MsgIdOK, a.RefreshRateObservedHz, a.RefreshRateOK) == ("True",) * 5 + (1, "False")
    assert (a.ChecksumComputed, a.MsgIdObserved, a.v_BE, a.v_LE, a.v_EndianOK) == ("0x0124", "0x1F", -21931, 21930, "False")
    endian = "Endian configured LITTLE but project decodes BIG (field v)"
    assert a.CompareReason == f"RefreshRate 1Hz outside 3+/-1Hz; {endian}"
    assert b.CompareReason == (
        "Header mismatch (got AB55, expected AA55); Terminator mismatch (got 00, expected 0D); "
        f"Checksum mismatch (computed 0x0105, stored 0x0000); {endian}; DataLength mismatch (stored 5, computed 6); "
        "MessageId mismatch (got 0x00, expected 0x1F)"
    )
    assert c.CompareReason == (
        "Terminator mismatch (got 55, expected 0D); "
        f"Checksum OutOfBounds; {endian}; DataLength OutOfBounds; MessageId OutOfBounds"
    )
    assert (c.ChecksumComputed, c.DataLenStored, c.DataLenComputed, c.v_BE) == ("N/A", "N/A", "1", -21931)


def test_summaries(spark):
    df = datagrams(spark)
    routed = route.route(df, MESSAGES)
    dissected = df.withColumn("drop_reason", F.when(F.col("packet_no") == 8, "fragment"))
    row = summary.run_summary(dissected, routed).first()
    assert tuple(row) == (9, 8, 7, 10)
    counts = {r.message: (r.exported_rows, r.missing) for r in summary.message_summary(routed, MESSAGES + [Message("none", 1, 1)]).collect()}
    assert counts["plain"] == (3, False) and counts["none"] == (0, True)
    short = summary.short_packet_count(routed, fields_frame(spark, [Message("plain", fields=(Field("x", 4, 2, "Uint16"),))]))
    assert short.first().short_packets == 3


def test_byte_order_texts(spark):
    m = Message("m", 1, 6, (Field("f", 1, 4, "Float32"), Field("n", 5, 2, "Int16")), checks=Checks(endianness=""))
    df = spark.createDataFrame([(0, bytearray.fromhex("3F8CCCCD0001")), (1, bytearray(2))], "packet_no long, payload binary").coalesce(1)
    rows = verify.verify(df, m, text_parity=True).orderBy("packet_no").select("f_BE", "f_LE", "n_BE", "n_LE").collect()
    assert [tuple(r) for r in rows] == [("1.1", f"{struct.unpack('<f', bytes.fromhex('3F8CCCCD'))[0]:.7g}", "1", "256"), ("N/A", "N/A", "N/A", "N/A")]


def _definitions(n):
    from wirelens import Field, Message

    own = [
        Message("late", 1, 6, (Field("v", 0, 1, "Uint8"),), header=b"\x01"),
        Message("bound", 1, 6, (Field("v", 0, 1, "Uint8"),), header=b"\x01\x02", connection_id="S1"),
        Message("free", 1, 5, (Field("v", 0, 1, "Uint8"),)),
        Message("text", 1, 0, (), format="NMEA", sentence="GGA"),
        Message("mine", 1, 0, (), format="NMEA", sentence="GLL", connection_id="S2"),
    ]
    filler = [Message(f"f{i}", 1, 40 + i, (Field("v", 0, 1, "Uint8"),), header=bytes([9, i % 256])) for i in range(n - len(own))]
    return own[:1] + filler + own[1:]


FIRST_ROWS = [
    (None, 1, b"\x01\x02\x03\x04\x05\x06", "S1"),
    ("f", 7, b"\x01\x02\x03\x04\x05\x06", "S2"),
    ("f", 7, b"\x05\x02\x03\x04\x05", None),
    ("f", 7, b"\x05\x02", ""),
    ("f", 8, b"$GPGGA,1*00\r\n$GPGLL,1*00\r\n", "S1"),
    ("f", 8, b"$GPGLL,1*00\r\n", "S1"),
    ("f", 8, b"$GPGLL,1*00\r\n", "S2"),
    ("f", 8, b"$GPGLL,1*00\r\n", ""),
    ("f", 9, None, "S1"),
]


def test_first_match_is_the_same_for_any_number_of_definitions(spark):
    from wirelens.operators.route import route
    from wirelens.plans.model import messages_frame

    rows = spark.createDataFrame(FIRST_ROWS, "file string, packet_no int, payload binary, connection_id string")
    rows = rows.selectExpr("*", "octet_length(payload) AS payload_size", "1 AS src_port", "1 AS dst_port")
    want = sorted([(None, 1, "late"), ("f", 7, "late"), ("f", 7, "free"), ("f", 8, "text"), ("f", 8, "mine"), ("f", 8, "mine")], key=repr)
    for n in (128, 129):
        for bound in (50_000, 3):
            for defs in (_definitions(n), messages_frame(spark, _definitions(n)))[: 1 if bound == 3 else 2]:
                out = route(rows, defs, "first", connection="connection_id", max_broadcast_rows=bound).collect()
                assert sorted(((r.file, r.packet_no, r.message) for r in out), key=repr) == want
    keyless = route(rows.select("payload", "payload_size"), _definitions(129), "first").collect()
    assert sorted(r.message for r in keyless) == ["free", "late", "late", "mine", "mine", "mine", "text"]


def test_first_match_on_a_stream_with_many_definitions(spark, tmp_path):
    from wirelens.operators.route import route

    rows = spark.createDataFrame(FIRST_ROWS, "file string, packet_no int, payload binary, connection_id string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    routed = route(stream, _definitions(129), "first", connection="connection_id").select("message")
    q = routed.writeStream.format("memory").queryName("first_many").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.message for r in spark.table("first_many").collect()) == ["free", "late", "late", "mine", "mine", "text"]


def test_report_equals_two_pass_summary(spark, monkeypatch):
    """Sentences and headers, several matches, equal ports, no keys; and definitions beyond a broadcast."""
    from wirelens.operators import route as rt
    from wirelens.operators import summary

    messages = [
        Message("a", 10, 4, (), header=b"\x01"), Message("b", 10, 4, ()), Message("c", 20, 4, (), header=b"\x01\x02"), Message("t", 20, format="NMEA", sentence="gll"),
        Message("u", 10, format="NMEA", sentence="GLL"), Message("never", 99, 4, ()),
    ]
    rng = random.Random(1)
    rows = []
    for i in range(400):
        payload = rng.choice([b"\x01\x02\x03\x04", b"\x01\x00\x00\x00", b"\x05\x00\x00\x00", b"$GPGLL,1*00$GPGLL,2", b"$GPZDA,1", b"\x01"])
        rows.append(("f", i, rng.choice([10, 20, 30]), rng.choice([10, 20]), bytearray(payload), len(payload), rng.choice([None, None, None, "not_udp"])))
    df = spark.createDataFrame(rows, "file string, packet_no long, src_port int, dst_port int, payload binary, payload_size int, drop_reason string")
    routed = rt.route(df.filter("drop_reason IS NULL"), messages)
    want = summary.run_summary(df, routed).collect()
    counts = {r.message: r["count"] for r in routed.groupBy("message").count().collect()}
    for small in (True, False):
        if not small:
            monkeypatch.setattr(rt, "match_lists", lambda *_: None)
        report = summary.run_report(df, messages)
        assert summary.report_totals(report).collect() == want
        assert {r.message: r.exported_rows for r in report.collect() if r.message} == counts
    assert summary.report_totals(summary.run_report(df.limit(0), messages)).collect() == [(0, 0, 0, 0)]
