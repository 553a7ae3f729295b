"""Operators on the state store against the batch operators: several batches, restarts, late rows, state that goes."""

import random

import pytest
from pyspark.sql import functions as F
from test_captures import folder
from test_route_verify import queue_counts

from wirelens.operators.reframe import reframe
from wirelens.operators.verify import refresh_rate
from wirelens.streaming import stateful


def land(spark, path, rows, schema, ts="ms"):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    df.withColumn("ts", F.timestamp_millis(ts)).drop(ts).write.mode("append").parquet(path)


def run(spark, make, source, out, check, stop_after=None):
    """Start the query over what has landed, one file a batch."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    writer = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return query


def state_rows(query):
    return [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]


def test_rates_equal_batch_across_batches_and_restarts(spark):
    """Rows out of order within the delay, a hot key, ties; four starts of the query."""
    rng = random.Random(3)
    times = sorted(rng.randrange(0, 90_000) for _ in range(900))
    rows = [("hot" if i % 3 else f"k{i % 5}", i, t) for i, t in enumerate(times)]
    rows = [r for r in rows] + [(None, 5000 + i, 40_000) for i in range(5)]
    rows.sort(key=lambda r: r[2] + rng.randrange(0, 4000))
    source, out, check = folder(), folder() + "/o", folder()
    make = lambda s: stateful.stateful_refresh_rate(s, ("message",), window_ms=1000, bucket_ms=7000, delay="5 seconds")
    peak = []
    for i in range(0, len(rows), 190):
        land(spark, source, rows[i : i + 190], "message string, packet_no long, ms long")
        peak += state_rows(run(spark, make, source, out, check))
    land(spark, source, [("~", 9999, 10_000_000)], "message string, packet_no long, ms long")
    last = run(spark, make, source, out, check)
    got = {r.packet_no: (r.message, r.refresh_hz, r.ts) for r in spark.read.parquet(out).collect()}
    df = spark.createDataFrame(rows, "message string, packet_no long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    want = {r.packet_no: (r.message, r.refresh_hz, r.ts) for r in refresh_rate(df, ("message",), window_ms=1000).collect()}
    assert got == want and max(hz for _, hz, _ in got.values()) > 5
    # a stretch's state goes when the watermark has passed it
    assert state_rows(last)[-1] < max(peak) / 3


def test_late_rows_count_nowhere(spark):
    source, out, check = folder(), folder() + "/o", folder()
    make = lambda s: stateful.stateful_refresh_rate(s, ("message",), window_ms=1000, bucket_ms=2000, delay="1 second")
    on_time = [("a", i, 10_000 + 500 * i) for i in range(40)]
    for part in (on_time[:20], on_time[20:] + [("a", 100, 30)], [("a", 101, 9000)], [("a", 999, 900_000)]):
        land(spark, source, part, "message string, packet_no long, ms long")
        run(spark, make, source, out, check)
    got = {r.packet_no: r.refresh_hz for r in spark.read.parquet(out).collect()}
    assert got == dict(enumerate(queue_counts([t for _, _, t in on_time], 1000)))


@pytest.mark.parametrize("stripe", [3, 4096])
def test_frames_equal_batch_across_batches_and_restarts(spark, stripe):
    rng = random.Random(7)
    rows, streams = [], {}
    for k in ("hot", "b", "c"):
        at, parts = 0, []
        for i in range(240 if k == "hot" else 60):
            data = rng.randbytes(rng.choice([1, 3, 7, 16, 40]))
            parts.append((k, i, at, bytearray(data), 1000 + 100 * i))
            at += len(data)
        streams[k] = parts
        rows += parts
    rows.sort(key=lambda r: r[4] + rng.randrange(0, 3000))
    rows += rows[5:9]  # sent again
    source, out, check = folder(), folder() + "/o", folder()
    schema = "connection_id string, seq long, position long, chunk binary, ms long"
    make = lambda s: stateful.stateful_reframe(s, 16, wait_ms=20_000, delay="5 seconds", stripe_frames=stripe)
    for i in range(0, len(rows), 110):
        land(spark, source, rows[i : i + 110], schema)
        run(spark, make, source, out, check)
    land(spark, source, [("~", 0, 0, bytearray(16), 10_000_000)], schema)
    last = run(spark, make, source, out, check)
    got = spark.read.parquet(out).filter("connection_id <> '~'").collect()
    whole = {(r.connection_id, r.frame_no): bytes(r.payload) for r in got if r.complete}
    df = spark.createDataFrame([r for p in streams.values() for r in p], schema).withColumn("ts", F.timestamp_millis("ms"))
    frames, rest = reframe(df, 16)
    assert whole == {(r.connection_id, r.frame_no): bytes(r.payload) for r in frames.collect()}
    given_up = {r.connection_id: bytes(r.payload) for r in got if not r.complete}
    assert given_up == {r.connection_id: bytes(r.rest) for r in rest.collect() if r.rest}
    assert state_rows(last)[-1] == 0
