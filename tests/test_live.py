import random
import tempfile
from collections import deque

from pyspark.sql import functions as F

from wirelens.operators.reframe import reframe
from wirelens.plans.model import Checks, Field, Message
from wirelens.sources.sinks import output_name, write_decoded, write_decoded_long
from wirelens.streaming import live


def folder():
    return tempfile.mkdtemp(prefix="wirelens-", dir="/tmp")


MESSAGES = [
    Message("Nav Data", 5000, 4, (Field("a", 1, 2, "Uint16", 0.5), Field("b", 3, 4, "Uint32")), checks=Checks(refresh_rate=(2, 1))),
    Message("text", 5000, fields=(Field("t", nmea_index=1),), format="NMEA", sentence="ZDA"),
]


def landed(spark, path, batches):
    n = 0
    for batch in batches:
        rows = []
        for ms, payload in batch:
            rows.append(("live", n, ms, "10.0.0.1", "10.0.0.2", 5000, 1, len(payload), bytearray(payload), "c1"))
            n += 1
        df = spark.createDataFrame(rows, "file string, packet_no long, ms long, src_ip string, dst_ip string, src_port int, dst_port int, payload_size int, payload binary, connection_id string")
        df.withColumn("ts", F.timestamp_millis("ms")).select(*live.DATAGRAM_SCHEMA.names).coalesce(1).write.mode("append").parquet(path)


def test_live_decoding_carries_rates_across_batches(spark):
    source, out, check = folder(), folder(), folder()
    batches = [[(i * 300 + b * 1500, b"\0\3\0" + bytes([i])) for i in range(5)] + [(9999, b"$GPZDA,7*00"), (9999, b"?")] for b in range(3)]
    landed(spark, source, batches)
    stream = live.stream_datagrams(spark, source, files_per_trigger=1)
    query = live.live_decode(stream, MESSAGES, out, check)
    query.awaitTermination(240)
    assert query.exception() is None
    rows = spark.read.parquet(f"{out}/{output_name(MESSAGES[0], 'live')}").orderBy("packet_no").collect()
    queue, want = deque(), []
    for t in [t for b in batches for t, p in b if len(p) == 4]:
        queue.append(t)
        while queue[0] < t - 1000:
            queue.popleft()
        want.append(len(queue))
    assert [r.RefreshRateObservedHz for r in rows] == want and {r.a for r in rows} == {1.5} and {r.b for r in rows} == {None}
    assert spark.read.parquet(f"{out}/{output_name(MESSAGES[1], 'live')}").count() == 3
    seen = [p["observedMetrics"] for p in query.recentProgress if p["observedMetrics"]]
    assert sum(m["received"].received for m in seen) == 21 and sum(m["live"].matched for m in seen) == 18
    assert sum(m["live"].short_packets for m in seen) == 15


def test_long_form_stream_and_preview(spark):
    source, out, check = folder(), folder(), folder()
    landed(spark, source, [[(i, b"\0\3\0" + bytes([i])) for i in range(5)]])
    values = live.live_values(live.stream_datagrams(spark, source), MESSAGES[:1])
    q = values.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.packet_no, r.field): r.text for r in spark.read.parquet(out).collect()}
    assert got[0, "a"] == "1.5" and len(got) == 10
    seen = []
    routed = live.live_route(live.stream_datagrams(spark, source), MESSAGES[:1]).select("packet_no", "payload_size")
    live.live_preview(routed, ["payload_size"], lambda df, _: seen.extend(df.collect()), folder(), 2).awaitTermination(120)
    assert [(r.packet_no, r["values"]) for r in seen] == [(4, "4"), (3, "4")]


def chunks(spark, streams, columns="connection_id string, seq long, chunk binary"):
    rows = [(k, i, bytearray(c)) for k, cs in streams.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, columns).repartition(4).withColumn("ts", F.timestamp_millis("seq"))


def test_frames_of_byte_streams(spark):
    rng = random.Random(1)
    streams = {k: [rng.randbytes(rng.choice([0, 1, 3, 7, 40])) for _ in range(80)] for k in "abc"}
    frames, rest = reframe(chunks(spark, streams), 8, chunk=7)
    got = {(r.connection_id, r.frame_no): bytes(r.payload) for r in frames.collect()}
    left = {r.connection_id: bytes(r.rest) for r in rest.collect()}
    for k, parts in streams.items():
        whole = b"".join(parts)
        n = len(whole) // 8
        assert [got[k, i] for i in range(n)] == [whole[8 * i : 8 * i + 8] for i in range(n)]
        assert left.get(k, b"") == whole[8 * n :]
    assert len(got) == sum(len(b"".join(p)) // 8 for p in streams.values())
    each, _ = reframe(chunks(spark, streams), 0)
    assert each.count() == sum(1 for p in streams.values() for c in p if c)


def test_live_frames_wait_for_their_bytes(spark):
    source, out, check = folder(), folder(), folder()
    rng = random.Random(2)
    streams = {k: [rng.randbytes(rng.randint(1, 9)) for _ in range(30)] for k in "ab"}
    df = chunks(spark, streams).persist()
    for lo in (0, 10, 20):
        df.filter((F.col("seq") >= lo) & (F.col("seq") < lo + 10)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = live.live_reframe(stream, 5, out, check)
    query.awaitTermination(200)
    rows = spark.read.parquet(out).orderBy("batch", "frame_no").collect()
    for k, parts in streams.items():
        whole = b"".join(parts)
        assert b"".join(bytes(r.payload) for r in rows if r.connection_id == k) == whole[: len(whole) // 5 * 5]
        assert [r.frame_no for r in rows if r.connection_id == k] == list(range(len(whole) // 5))


def test_outputs_per_message(spark):
    from wirelens.operators.route import route

    source = folder()
    landed(spark, source, [[(i * 10, b"\0\3\0" + bytes([i])) for i in range(5)] + [(1, b"$GPZDA,7*00")]])
    routed = route(spark.read.parquet(source), MESSAGES)
    written = write_decoded(routed, MESSAGES, folder(), "s", folder() + "/staged")
    assert [w.rsplit("/", 1)[-1] for w in written] == ["Nav_Data_4_5000_s", "text_0_5000_s"]
    nav = spark.read.parquet(written[0])
    assert nav.count() == 5 and "RefreshRateOK" in nav.columns
    assert spark.read.parquet(written[1]).first().t == "7"
    path = folder()
    write_decoded_long(routed.filter("format = 'HEX'"), MESSAGES[:1], path, "s")
    assert {r.message_key for r in spark.read.parquet(path).select("message_key").distinct().collect()} == {"Nav_Data_4_5000_s"}


def test_preview_keeps_rows_over_small_batches_and_restarts(spark):
    """Batches smaller than the preview; a batch that is given twice changes nothing."""
    source, check = folder(), folder()
    rng = random.Random(6)
    seen = {}
    numbers = list(range(60))
    rng.shuffle(numbers)
    for k in range(0, 60, 6):
        rows = spark.createDataFrame([(i, f"v{i}") for i in numbers[k : k + 6]], "packet_no long, a string").coalesce(1)
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        live.live_preview(stream, ["a"], lambda df, e: seen.__setitem__(e, [(r.packet_no, r["values"]) for r in df.collect()]), check, 15).awaitTermination(120)
        assert seen[k // 6] == [(i, f"v{i}") for i in sorted(numbers[: k + 6], reverse=True)[:15]]
    assert len(seen) == 10
