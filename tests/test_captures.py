import struct
import tempfile

import pytest
from pyspark.sql import functions as F

from wirelens.operators.dissect import dissect_frames, hex_dump, valid_datagrams
from wirelens.operators.frames import tcp_frames, udp_frames
from wirelens.sources import captures as cap


def folder():
    return tempfile.mkdtemp(prefix="wirelens-", dir="/tmp")


def pcap(packets, order="<", nano=False, link=1):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for sec, sub, data in packets:
        out += struct.pack(order + "4I", sec, sub, len(data), len(data)) + data
    return out


def block(order, kind, body):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(order + "2I", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def section(order):
    return block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))


def interface(order, link=1, resolution=None):
    options = b"" if resolution is None else struct.pack(order + "HHB3x", 9, 1, resolution) + struct.pack(order + "HH", 0, 0)
    return block(order, 1, struct.pack(order + "HHI", link, 0, 65535) + options)


def packet(order, which, ticks, data):
    head = struct.pack(order + "5I", which, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data))
    return block(order, 6, head + data)


def write(path, name, content):
    with open(f"{path}/{name}", "wb") as f:
        f.write(content)


def rows(df):
    out = df.orderBy("file", "packet_no").collect()
    return [(r.file.rsplit("/", 1)[-1], r.packet_no, r.ts_sec, r.ts_usec, r.link_type, bytes(r.frame)) for r in out]


def body(i, n=None):
    return bytes((i * 7 + k) % 256 for k in range(n or 20 + i % 90))


@pytest.mark.parametrize("width", [64 << 20, 257])
def test_classic_captures(spark, width):
    path = folder()
    packets = [(1700000000 + i, i * 1000, body(i)) for i in range(200)]
    write(path, "a.pcap", pcap(packets))
    write(path, "b.PCAP", pcap(packets, ">", True))
    write(path, "c.pcap", pcap(packets[:3], link=101))
    write(path, "skip.txt", b"text")
    write(path, "empty.pcap", b"")
    files = cap.capture_files(spark, path)
    assert files.count() == 3
    listed = {r.path.rsplit("/", 1)[-1]: r.reason for r in cap.capture_files(spark, path, 5000, True).collect()}
    assert listed["skip.txt"] == "suffix" and "empty.pcap" not in listed and listed["a.pcap"] == "too_large"
    index = cap.index_captures(files, width)
    got = rows(cap.read_captures(files, index))
    want = [("a.pcap", i + 1, s, u, 1, d) for i, (s, u, d) in enumerate(packets)]
    want += [("b.PCAP", i + 1, s, u // 1000, 1, d) for i, (s, u, d) in enumerate(packets)]
    want += [("c.pcap", i + 1, s, u, 101, d) for i, (s, u, d) in enumerate(packets[:3])]
    assert got == want
    formats = {r.file.rsplit("/", 1)[-1]: (r.format, r.byte_order, r.nanoseconds, r.link_type) for r in cap.capture_format(index).collect()}
    assert formats == {"a.pcap": ("PCAP", "<", False, 1), "b.PCAP": ("PCAP", ">", True, 1), "c.pcap": ("PCAP", "<", False, 101)}
    assert cap.capture_errors(index).count() == 0


@pytest.mark.parametrize("width", [64 << 20, 311])
def test_block_captures(spark, width):
    path = folder()
    content, want = b"", []

    def emit(sec, usec, data):
        want.append(("m.pcapng", len(want) + 1, sec, usec, 1, data))

    for part, order in enumerate("<>><"):
        content += section(order) + interface(order) + interface(order, 113) + interface(order, 1, 0x80 | 10) + block(order, 99, b"skip me")
        for i in range(40):
            micros = (1700000000 + part) * 1_000_000 + i
            content += packet(order, 0, micros, body(i))
            emit(1700000000 + part, i, body(i))
            content += packet(order, 1, 5, b"not ethernet") + packet(order, 7, 5, b"no interface")
            content += packet(order, 2, 1024 * 50 + 512, body(i, 31))
            emit(50, 500000, body(i, 31))
        content += block(order, 3, struct.pack(order + "I", 9) + b"123456789")
        emit(0, 0, b"123456789")
    write(path, "m.pcapng", content)
    files = cap.capture_files(spark, path)
    index = cap.index_captures(files, width)
    assert rows(cap.read_captures(files, index)) == want
    assert cap.capture_format(index).first().format == "PCAPNG"


def test_a_packet_that_looks_like_records_does_not_mislead(spark):
    """Payloads made of plausible record headers force wrong guesses, which must be repaired."""
    path = folder()
    decoy = b"".join(struct.pack("<4I", 1, 2, 4, 4) + b"abcd" for _ in range(60))
    packets = [(i, i, decoy) for i in range(20)]
    write(path, "decoy.pcap", pcap(packets))
    files = cap.capture_files(spark, path)
    got = rows(cap.read_captures(files, range_bytes=500))
    assert [r[1:] for r in got] == [(i + 1, s, u, 1, d) for i, (s, u, d) in enumerate(packets)]


@pytest.mark.parametrize("width", [64 << 20, 100])
def test_faults_end_a_file(spark, width):
    path = folder()
    good = pcap([(1, 2, body(i)) for i in range(10)])
    last = 20 + 9 % 90
    write(path, "cut.pcap", good[:-3])
    write(path, "cuthead.pcap", good[: -last - 10])
    write(path, "zero.pcap", good + struct.pack("<4I", 1, 1, 0, 0) + good[24:])
    write(path, "tiny.pcap", b"abc")
    write(path, "magic.pcap", b"\1\2\3\4" * 8)
    write(path, "order.pcapng", b"\x0a\x0d\x0d\x0a" + b"\0" * 24)
    bad_block = section("<") + interface("<") + packet("<", 0, 1, body(1)) + block("<", 6, b"\0" * 20)[:-4] + b"\1\0\0\0"
    write(path, "trailer.pcapng", bad_block)
    files = cap.capture_files(spark, path)
    index = cap.index_captures(files, width)
    reasons = {r.file.rsplit("/", 1)[-1]: r.reason for r in cap.capture_errors(index).collect()}
    assert reasons == {
        "cut.pcap": "truncated_packet_data",
        "cuthead.pcap": "truncated_packet_header",
        "zero.pcap": "bad_packet_size",
        "tiny.pcap": "too_small",
        "magic.pcap": "bad_magic",
        "order.pcapng": "bad_byte_order_magic",
        "trailer.pcapng": "block_length_mismatch",
    }
    counts = {r.file.rsplit("/", 1)[-1]: r["count"] for r in cap.read_captures(files, index).groupBy("file").count().collect()}
    assert counts == {"cut.pcap": 9, "cuthead.pcap": 9, "zero.pcap": 10, "trailer.pcapng": 1}


def checksum(data):
    data += b"\0" * (len(data) % 2)
    total = sum(struct.unpack(f">{len(data) // 2}H", data))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return ~total & 0xFFFF


def test_frames_written_and_read_back(spark):
    payload = bytes.fromhex("AA55001002BCDEF0010203040506070809")
    base = spark.createDataFrame(
        [(bytearray(payload), "192.168.1.10", 49152, "192.168.1.20", 5000), (bytearray(payload[:-1]), "junk", 1, "10.0.0.255", 2)],
        "payload binary, src_ip string, src_port int, dst_ip string, dst_port int",
    )
    udp = base.transform(udp_frames).collect()
    for r in udp:
        frame = bytes(r.frame)
        assert frame[:14].hex() == "0200000000020200000000010800" and checksum(frame[14:34]) == 0
        assert frame[42:] == bytes(r.payload) and frame[26:30] == (b"\xc0\xa8\1\x0a" if r.src_port > 1 else bytes(4))
    for r in base.transform(tcp_frames).collect():
        frame = bytes(r.frame)
        segment = frame[34:]
        pseudo = frame[26:34] + b"\0\6" + struct.pack(">H", len(segment))
        assert checksum(frame[14:34]) == 0 and checksum(pseudo + segment) == 0
    path = folder() + "/out"
    both = base.transform(udp_frames).unionByName(base.transform(tcp_frames))
    timed = both.withColumn("ts", F.timestamp_micros(F.lit(1_700_000_000_123_456))).coalesce(1)
    cap.write_capture(timed, path)
    back = cap.read_pcapng(spark, path)
    assert {(r.ts_sec, r.ts_usec) for r in back.collect()} == {(1700000000, 123456)}
    dissected = dissect_frames(back)
    assert sorted(r.drop_reason or "" for r in dissected.collect()) == ["", "", "not_udp", "not_udp"]
    kept = valid_datagrams(dissected).filter("dst_port = 5000").first()
    assert (bytes(kept.payload), kept.src_ip, kept.dst_ip, kept.payload_size) == (payload, "192.168.1.10", "192.168.1.20", 17)


def test_hex_dump_lines(spark):
    raw = bytes(range(0x18, 0x18 + 20))
    df = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray())], "k int, payload binary")
    lines = [r.line for r in hex_dump(df, keys=("k",)).orderBy("line_offset").collect()]
    assert lines == [
        "0000  18 19 1A 1B 1C 1D 1E 1F  20 21 22 23 24 25 26 27  ........ !\"#$%&'",
        "0010  28 29 2A 2B" + " " * 39 + "()*+",
    ]


def test_second_write_adds_and_overwrite_replaces(spark, tmp_path):
    from wirelens.sources.captures import read_pcapng, write_capture

    def frames(a, b):
        return spark.range(a, b).selectExpr("timestamp_seconds(id) AS ts", "to_binary(lpad(hex(id), 28, '0'), 'hex') AS frame").repartition(2)

    path = str(tmp_path / "captures")
    write_capture(frames(0, 10), path)
    write_capture(frames(10, 20), path)
    assert read_pcapng(spark, path).count() == 20
    write_capture(frames(20, 25), path, mode="overwrite")
    assert read_pcapng(spark, path).count() == 5


def test_one_capture_of_many_tasks_without_null_records(spark, tmp_path):
    """Records of all partitions in order behind one head; a row without a record is skipped."""
    path = str(tmp_path / "one")
    record = F.unhex(F.concat(F.lit("01000000020000000400000004000000"), F.lpad(F.hex("id"), 8, "0")))
    rows = spark.range(0, 1000, 1, 7).select(F.when(F.col("id") % 10 != 3, record).alias("block"))
    cap.write_records(rows, path, one_file=True)
    files = cap.capture_files(spark, path)
    assert files.count() == 1
    got = [int.from_bytes(r.frame) for r in cap.read_captures(files, range_bytes=512).orderBy("packet_no").collect()]
    assert got == [i for i in range(1000) if i % 10 != 3]
    cap.write_records(rows.limit(5), path, mode="overwrite", one_file=True)
    assert cap.read_pcap(spark, path).count() == 4
    cap.write_records(rows, str(tmp_path / "many"))
    assert cap.read_pcap(spark, str(tmp_path / "many")).count() == 900


def test_ranges_of_captures_are_spread_over_tasks(spark):
    """Their table is small, so it was put into one task, which then read all captures."""
    ranges = spark.range(500).select(F.lit("f").alias("file"), F.col("id").alias("part"))
    joined = ranges.join(ranges.withColumn("n", F.lit(1)).hint("merge"), ["file", "part"])
    for some in (ranges, joined):
        assert cap.spread_ranges(some, "file", "part").select(F.spark_partition_id().alias("p")).distinct().count() == 8


def test_frames_are_not_made_again_for_the_null_filter(spark, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(cap, "write_records", lambda blocks, *_: plans.append(blocks._jdf.queryExecution().optimizedPlan().toString()))
    rows = spark.range(5).select(F.timestamp_seconds("id").alias("ts"), F.encode(F.reverse(F.col("id").cast("string")), "UTF-8").alias("frame"))
    cap.write_capture(rows, str(tmp_path / "x"))
    assert plans[0].count("reverse(") == 1
