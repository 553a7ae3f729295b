"""Live decoding on Structured Streaming.

Stateless work (routing, decoding, checks) is the batch plan on a stream. The
two stateful operators keep their state as a small table per batch: counts per
millisecond of the last window, or the unfinished bytes of each connection.
Each micro-batch then runs the skew-safe batch operator, so one hot message or
connection is still spread over many tasks, and a replayed batch starts from
the state of the batch before it and overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wirelens.functions.bytes import fits
from wirelens.operators.decode import decode_long
from wirelens.operators.reframe import reframe
from wirelens.operators.route import route
from wirelens.operators.summary import latest_preview
from wirelens.operators.verify import WINDOW_MS, millis_counts, refresh_rate
from wirelens.plans.model import Message
from wirelens.sources.outputs import write_outputs
from wirelens.sources.sinks import staged_outputs

DATAGRAM_SCHEMA = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("packet_no", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("payload_size", T.IntegerType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("connection_id", T.StringType()),
    ]
)


def stream_datagrams(
    spark: SparkSession, path: str, schema: T.StructType = DATAGRAM_SCHEMA, files_per_trigger: int | None = None
) -> DataFrame:
    """Datagrams landed as Parquet, in the schema of the batch source."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def live_route(stream: DataFrame, messages: list[Message]) -> DataFrame:
    """First match per datagram, isolated by connection; no state is needed."""
    return route(stream, messages, "first", connection="connection_id" if "connection_id" in stream.columns else None)


def live_values(stream: DataFrame, messages: list[Message]) -> DataFrame:
    """Streaming long form: one row per (datagram, field)."""
    return decode_long(live_route(stream, messages), messages, ("file", "packet_no", "ts", "src_ip", "src_port"))


def with_metrics(routed: DataFrame, messages: list[Message], name: str = "live") -> DataFrame:
    """Observe matched datagrams and short packets while the stream runs.

    The numbers arrive in ``StreamingQueryProgress.observedMetrics[name]``.
    """
    needed = {m.name: max((f.off0 + f.size for f in m.fields if f.off0 >= 0 and f.size > 0), default=0) for m in messages}
    need = F.create_map(*[F.lit(x) for pair in needed.items() for x in pair])[F.col("message")]
    return routed.observe(
        name,
        F.count(F.lit(1)).alias("matched"),
        F.count_if((F.col("format") != "NMEA") & ~fits(F.col("payload"), F.lit(0), F.greatest(need, F.lit(1)))).alias("short_packets"),
    )


def with_received(stream: DataFrame, name: str = "received") -> DataFrame:
    return stream.observe(name, F.count(F.lit(1)).alias("received"))


def metrics_of(query: StreamingQuery) -> list[tuple[int, str, str, int]]:
    """(batch, name, metric, value) of everything that ``with_metrics`` and ``with_received`` observed in a query's recent batches."""
    told = []
    for progress in query.recentProgress:
        for name, row in progress["observedMetrics"].items():
            told += [(progress["batchId"], name, metric, value) for metric, value in row.asDict().items()]
    return told


def live_decode(
    stream: DataFrame,
    messages: list[Message],
    path: str,
    checkpoint: str,
    stamp: str = "live",
    state: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Write each message's rows (values, then checks) to its own folder per batch.

    A batch is evaluated once, into a staging folder partitioned by message; one
    job then writes all messages' outputs, which become visible together. A
    repeated batch replaces its own output. Messages with a refresh-rate check
    share one state table under ``state``.
    """
    rated = [m.name for m in messages if m.checks is not None and m.checks.refresh_rate]
    where = state or f"{checkpoint.rstrip('/')}/rates"
    watched = with_metrics(live_route(with_received(stream), messages), messages)

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        staging = f"{checkpoint.rstrip('/')}/staged/batch={epoch}"
        rates: list[DataFrame] = []

        def with_rate(rows: DataFrame, i: int) -> DataFrame:
            if messages[i].name not in rated:
                return rows
            if not rates:
                all_rows = spark.read.schema(batch.schema).parquet(staging)
                rates.append(_rated_batch(all_rows.filter(F.col("message").isin(*rated)), where, epoch, ("message",)))
            return rates[0].filter(F.col("message") == messages[i].name)

        outputs = staged_outputs(batch, messages, staging, stamp, ready=with_rate)
        write_outputs(spark, outputs, path, into=f"batch={epoch}")
        _remove(spark, staging)

    return watched.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**_once(trigger)).start()


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _once(trigger: dict) -> dict:
    return trigger or {"availableNow": True}


# ------------------------------------------------------------ state as tables


def _state_path(state: str, epoch: int) -> str:
    return f"{state.rstrip('/')}/epoch={epoch}"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _read_state(spark: SparkSession, state: str, epoch: int) -> DataFrame | None:
    """State left by the batch before ``epoch``; a state that should be there and isn't is an error."""
    if epoch == 0:
        return None
    path = _state_path(state, epoch - 1)
    if not _exists(spark, path):
        raise FileNotFoundError(f"the state of batch {epoch - 1} is missing: {path}")
    return spark.read.parquet(path)


def _forget_state(spark: SparkSession, state: str, epoch: int) -> None:
    """Remove what no batch needs again: a repeated batch reads only the state before it."""
    if epoch > 1:
        _remove(spark, _state_path(state, epoch - 2))


def _rated_batch(rows: DataFrame, state: str, epoch: int, keys: tuple[str, ...], window_ms: int = WINDOW_MS) -> DataFrame:
    """Refresh rates of a batch; writes the counts the next batch needs."""
    spark = rows.sparkSession
    before = _read_state(spark, state, epoch)
    out = refresh_rate(rows, keys, window_ms=window_ms, seed=before)
    counts = millis_counts(rows, list(keys))
    if before is not None:
        counts = counts.unionByName(before)
    merged = counts.groupBy(*keys, "_ms").agg(F.sum("_n").alias("_n"))
    newest = merged.groupBy(*keys).agg(F.max("_ms").alias("_top"))
    tail = merged.join(newest, list(keys)).filter(F.col("_ms") >= F.col("_top") - window_ms).drop("_top")
    tail.write.mode("overwrite").parquet(_state_path(state, epoch))
    _forget_state(spark, state, epoch)
    return out


def live_refresh_rate(
    routed: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("message",), window_ms: int = WINDOW_MS, **trigger
) -> StreamingQuery:
    """Sliding arrivals per key, carried across batches."""
    state = f"{checkpoint.rstrip('/')}/rates"

    def write(batch: DataFrame, epoch: int) -> None:
        out = _rated_batch(batch, state, epoch, keys, window_ms)
        out.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={epoch}")

    return routed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**_once(trigger)).start()


def live_reframe(
    chunks: DataFrame,
    frame_len: int,
    path: str,
    checkpoint: str,
    keys: tuple[str, ...] = ("connection_id",),
    order: str = "seq",
    **trigger,
) -> StreamingQuery:
    """Fixed-length frames of byte streams; unfinished bytes wait for the next batch.

    ``frame_no`` counts a connection's frames from the start of the stream: the
    state holds each connection's waiting bytes and its next number.
    """
    state = f"{checkpoint.rstrip('/')}/bytes"

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = _read_state(spark, state, epoch)
        rows = batch.select(*keys, order, "chunk", "ts")
        if before is not None:
            # Waiting bytes come before anything that arrived in this batch.
            rows = rows.unionByName(before.select(*keys, F.lit(-1).cast("bigint").alias(order), F.col("rest").alias("chunk"), "ts"))
        frames, rest = reframe(rows, frame_len, keys, order)
        done = None if before is None else before.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("next_no").alias("_next"))
        if done is not None:
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            numbered = frames.join(done, same, "left").withColumn("frame_no", F.col("frame_no") + F.coalesce("_next", F.lit(0)))
            frames = numbered.select(*frames.columns)
        target = f"{path.rstrip('/')}/batch={epoch}"
        frames.write.mode("overwrite").parquet(target)
        if frame_len > 0:
            made = spark.read.schema(frames.schema).parquet(target).select(*keys, (F.col("frame_no") + 1).alias("n"))
            nexts = made.unionByName(rest.select(*keys, F.lit(0).cast("bigint").alias("n")))
            if before is not None:
                nexts = nexts.unionByName(before.select(*keys, F.col("next_no").alias("n")))
            nexts = nexts.groupBy(*keys).agg(F.max("n").cast("bigint").alias("next_no"))
            waiting = rest.select(*[F.col(k).alias(f"_{k}") for k in keys], "rest")
            kept = nexts.join(waiting, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").select(
                *keys, F.coalesce("rest", F.lit(b"")).alias("rest"), F.lit(None).cast("timestamp").alias("ts"), "next_no"
            )
            kept.write.mode("overwrite").parquet(_state_path(state, epoch))
            _forget_state(spark, state, epoch)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**_once(trigger)).start()


def live_preview(
    decoded: DataFrame, values: list[str], on_rows: Callable[[DataFrame, int], None], checkpoint: str, n: int = 200, order: str = "packet_no", **trigger
) -> StreamingQuery:
    """Hand the newest ``n`` rows of the whole stream so far, newest first, to a callback after every batch.

    The rows are kept between batches as a table of at most ``n``: the newest of
    the batch and of the table before it. A repeated batch starts from the same
    table and gives the same rows.
    """
    state = f"{checkpoint.rstrip('/')}/newest"

    def show(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = _read_state(spark, state, epoch)
        newest = latest_preview(batch, values, n, order)
        if before is not None:
            newest = newest.unionByName(before).orderBy(F.col(order).desc()).limit(n)
        path = _state_path(state, epoch)
        newest.write.mode("overwrite").parquet(path)
        _forget_state(spark, state, epoch)
        on_rows(spark.read.schema(newest.schema).parquet(path).orderBy(F.col(order).desc()), epoch)

    return decoded.writeStream.foreachBatch(show).option("checkpointLocation", checkpoint).trigger(**_once(trigger)).start()
