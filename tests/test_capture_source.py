"""Captures as a data source: pruning by a sidecar index, and growing files as a stream."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F
from test_captures import body, folder, interface, packet, pcap, rows, section, write

from wirelens.operators.dissect import dissect_frames, valid_datagrams
from wirelens.operators.frames import udp_frames
from wirelens.sources import capture_source as src
from wirelens.sources import captures as cap


def datagrams(spark, n=600):
    df = spark.range(n).select(
        F.col("id"),
        F.timestamp_micros(1_700_000_000_000_000 + F.col("id") * 1_000_000).alias("ts"),
        F.lit("10.0.0.1").alias("src_ip"),
        F.lit("10.0.0.2").alias("dst_ip"),
        F.lit(40000).alias("src_port"),
        (5000 + F.floor(F.col("id") / 100)).cast("int").alias("dst_port"),
        F.encode(F.format_string("payload %05d", "id"), "UTF-8").alias("payload"),
    )
    return udp_frames(df.coalesce(1).sortWithinPartitions("id"))


@pytest.mark.parametrize("classic", [None, (True, False), (False, False), (True, True), (False, True)])
def test_all_kinds_by_index(spark, classic):
    path, sidecar = folder(), folder() + "/s"
    cap.write_capture(datagrams(spark), path, classic=classic)
    full = cap.read_pcap(spark, path)
    got = src.read_indexed(spark, path, sidecar, range_bytes=4096)
    assert rows(got) == rows(full) and got.count() == 600
    back = valid_datagrams(dissect_frames(got)).orderBy("packet_no").collect()
    assert [bytes(r.payload) for r in back] == [b"payload %05d" % i for i in range(600)]
    assert back[7].ts.timestamp() == 1_700_000_007


def scanned(df):
    """Rows that left the scan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    stack, found = [plan], 0
    while stack:
        node = stack.pop()
        if "Scan" in node.nodeName():
            found += node.metrics().get("numOutputRows").get().value()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            stack.append(node.executedPlan())
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return found


def test_filters_reach_the_ranges(spark):
    path, sidecar = folder(), folder() + "/s"
    cap.write_capture(datagrams(spark), path, classic=(True, False))
    all_rows = src.read_indexed(spark, path, sidecar, range_bytes=2048)
    ranges = spark.read.parquet(sidecar)
    assert ranges.count() > 20 and ranges.agg(F.sum("packets")).first()[0] == 600
    full = {r.packet_no: bytes(r.frame) for r in all_rows.collect()}
    cuts = [
        ("dst_port = 5003", range(301, 401)),
        ("dst_port IN (5000, 5005)", [*range(1, 101), *range(501, 601)]),
        ("ts >= '2023-11-14 22:15:00' AND ts < '2023-11-14 22:15:30'", range(101, 131)),
        ("packet_no > 590", range(591, 601)),
        ("dst_port > 5004 AND ts <= '2023-11-14 22:21:50'", range(501, 512)),
        ("dst_port = 80", []),
    ]
    for where, want in cuts:
        df = spark.read.format("wirelens_capture").option("sidecar", sidecar).load(path).filter(where)
        assert {r.packet_no: bytes(r.frame) for r in df.collect()} == {i: full[i] for i in want}, where
        assert scanned(df) == len(want), where
    # whole ranges are left out, not only rows: a changed file is noticed only where it is read
    reader = src.CaptureReader({"sidecar": sidecar, "path": path, "taskbytes": "1"})
    assert len(reader.partitions()) == ranges.count()
    reader.conditions = [("dst_port", "=", 5003)]
    assert len(reader.partitions()) < ranges.count() / 4


def test_undated_and_odd_packets_stay_out_of_time_filters(spark):
    path, sidecar = folder(), folder() + "/s"
    write(path, "a.pcap", pcap([(0, 0, body(1)), (5, 0, body(2)), (0, 0, body(3))]))
    got = src.read_indexed(spark, path, sidecar)
    assert [r.ts is None for r in got.orderBy("packet_no").collect()] == [True, False, True]
    assert [r.packet_no for r in got.filter("ts < '2000-01-01'").collect()] == [2]
    assert got.filter("ts IS NULL").count() == 2 and got.filter("dst_port IS NULL").count() == 3


def test_stale_index_is_refused(spark):
    path, sidecar = folder(), folder() + "/s"
    write(path, "a.pcap", pcap([(1, 0, body(1))]))
    assert src.read_indexed(spark, path, sidecar).count() == 1
    write(path, "a.pcap", pcap([(1, 0, body(1)), (2, 0, body(2))]))
    with pytest.raises(Exception, match="build the index again"):
        src.read_indexed(spark, path, sidecar, build=False).count()
    assert src.read_indexed(spark, path, sidecar).count() == 2


def growing():
    """A classic and a block capture as bytes, and the packets they hold."""
    rng = random.Random(4)
    packets = [(1700000000 + i, i, rng.randbytes(rng.randrange(1, 90))) for i in range(90)]
    blocks = b""
    for order in "<>":
        blocks += section(order) + interface(order) + interface(order, 101)
        for i, (s, u, d) in enumerate(packets[:45] if order == "<" else packets[45:]):
            blocks += packet(order, 0, s * 1_000_000 + u, d)
            if i % 7 == 0:
                blocks += packet(order, 1, 5, b"not ethernet") + interface(order)
    return pcap(packets, ">"), blocks, packets


def run(spark, path, out, check, **options):
    stream = src.stream_captures(spark, path, **options)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination(120)


@pytest.mark.parametrize("kept", [True, False])
def test_growing_files_across_restarts(spark, kept):
    """Files cut anywhere, also inside a record: every packet once, in three and more starts of the query."""
    path, out, check, positions = folder(), folder(), folder(), folder()
    classic, blocks, packets = growing()
    os.makedirs(f"{path}/connection=c7")
    cuts = [10, 700, 701, 2500, None]
    for n in cuts:
        write(f"{path}/connection=c7", "a.pcap", classic[:n])
        write(path, "b.pcapng", blocks[: None if n is None else n + 13])
        run(spark, path, out, check, positions=positions if kept else None)
    run(spark, path, out, check, positions=positions if kept else None)
    got = spark.read.parquet(out).orderBy("file", "packet_no").collect()
    want = [(i + 1, s, u, d) for i, (s, u, d) in enumerate(packets)]
    for name, connection in (("b.pcapng", None), ("a.pcap", "c7")):
        own = [r for r in got if r.file.endswith(name)]
        assert [(r.packet_no, r.ts_sec, r.ts_usec, bytes(r.frame)) for r in own] == want
        assert {r.connection_id for r in own} == {connection}


def test_growth_within_one_query(spark):
    """One running query over five batches, a file that comes later, and small steps."""
    path, out, check, positions = folder(), folder(), folder(), folder()
    classic, _, packets = growing()
    write(path, "a.pcap", classic[:400])
    stream = src.stream_captures(spark, path, positions, max_bytes=700)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(processingTime="300 milliseconds").start()
    try:
        for n in (900, 1500, 3000, len(classic)):
            query.processAllAvailable()
            write(path, "a.pcap", classic[:n])
        write(path, "z.pcap", classic)
        for _ in range(12):
            query.processAllAvailable()
        batches = {p["batchId"] for p in query.recentProgress if p["numInputRows"]}
    finally:
        query.stop()
    got = spark.read.parquet(out).orderBy("file", "packet_no").collect()
    for name in ("a.pcap", "z.pcap"):
        assert [(r.packet_no, bytes(r.frame)) for r in got if r.file.endswith(name)] == [(i + 1, d) for i, (_, _, d) in enumerate(packets)]
    assert len(batches) >= 5


def test_faults_stop_one_file_only(spark):
    path, out, check = folder(), folder(), folder()
    classic, _, packets = growing()
    write(path, "bad.pcap", classic[:500] + b"\0" * 400)
    write(path, "odd.pcap", b"no capture at all" * 9)
    write(path, "good.pcap", classic)
    run(spark, path, out, check)
    got = spark.read.parquet(out).collect()
    assert sum(r.file.endswith("good.pcap") for r in got) == len(packets)
    assert 0 < sum(r.file.endswith("bad.pcap") for r in got) < 12
    reader = src.CaptureStreamReader({"path": path})
    faults = {k.rsplit("/", 1)[-1]: v["fault"] for k, v in json.loads(reader.latestOffset()["files"]).items()}
    assert faults["good.pcap"] is None and faults["odd.pcap"] == "bad_magic" and faults["bad.pcap"]


def test_marks_split_a_long_backlog(spark):
    classic, blocks, packets = growing()
    path = folder()
    write(path, "a.pcap", classic)
    write(path, "b.pcapng", blocks)
    for name, content in (("a.pcap", classic), ("b.pcapng", blocks)):
        marks, fault = src.advance(f"{path}/{name}", len(content), src._Position().plain(), mark_bytes=300)
        assert fault is None and len(marks) > 10 and marks[-1][:2] == [len(content), len(packets)]
    reader = src.CaptureStreamReader({"path": path, "taskbytes": "300"})
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    assert len(parts) > 20 and reader.partitions(end, end) == []
    read = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    for name in ("a.pcap", "b.pcapng"):
        own = sorted((r for r in read if r["file"].endswith(name)), key=lambda r: r["packet_no"])
        assert [(r["packet_no"], r["frame"]) for r in own] == [(i + 1, d) for i, (_, _, d) in enumerate(packets)]
    assert isinstance(read[0]["ts"], datetime.datetime)
