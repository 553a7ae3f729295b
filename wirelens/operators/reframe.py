"""Byte streams cut into frames of fixed length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.operators.scan import CHUNK, running


def _pieces(
    chunks: DataFrame, frame_len: int, keys: list[str], order: str, data: str, ts: str, chunk: int | None
) -> DataFrame:
    size = F.octet_length(data).cast("bigint")
    placed = running(chunks.filter(size > 0), keys, order, {"_start": ("sum", size)}, chunk)
    start, end = F.col("_start"), F.col("_start") + size
    first, last = F.floor(start / frame_len), F.floor((end - 1) / frame_len)
    parts = placed.withColumn("frame_no", F.explode(F.sequence(first, last)))
    lo = F.greatest(start, F.col("frame_no") * frame_len)
    hi = F.least(end, (F.col("frame_no") + 1) * frame_len)
    cut = F.substring(F.col(data), (lo - start + 1).cast("int"), (hi - lo).cast("int"))
    return parts.select(*keys, "frame_no", lo.alias("_at"), cut.alias("_piece"), F.col(ts).alias(ts))


def reframe(
    chunks: DataFrame,
    frame_len: int,
    keys: tuple[str, ...] = ("connection_id",),
    order: str = "seq",
    data: str = "chunk",
    ts: str = "ts",
    chunk: int | None = CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """Complete frames (keys, frame_no, payload, ts), and the rest of each stream.

    A length of 0 or less makes every chunk a frame. The byte position of a
    chunk is a running total made without sorting a connection in one task;
    frames inside one chunk are cut in place and only frames that span chunks
    are gathered, at most ``frame_len`` bytes each. Put a session id in ``keys``
    when a reconnect must drop unfinished bytes.
    """
    keys = list(keys)
    if frame_len <= 0:
        whole = chunks.filter(F.octet_length(data) > 0)
        frames = whole.select(*keys, F.col(order).alias("frame_no"), F.col(data).alias("payload"), F.col(ts).alias(ts))
        rest = chunks.select(*keys).distinct().withColumn("rest", F.lit(b""))
        return frames, rest
    pieces = _pieces(chunks, frame_len, keys, order, data, ts, chunk)
    inside = pieces.filter(F.octet_length("_piece") == frame_len)
    broken = pieces.filter(F.octet_length("_piece") < frame_len)
    gathered = broken.groupBy(*keys, "frame_no").agg(
        F.array_sort(F.collect_list(F.struct("_at", "_piece"))).alias("_parts"), F.max_by(ts, "_at").alias(ts)
    )
    joined = gathered.withColumn(
        "payload", F.unhex(F.array_join(F.transform("_parts", lambda p: F.hex(p["_piece"])), ""))
    ).drop("_parts")
    complete = joined.filter(F.octet_length("payload") == frame_len)
    columns = [*keys, "frame_no", "payload", ts]
    frames = inside.select(*keys, "frame_no", F.col("_piece").alias("payload"), ts).unionByName(complete.select(*columns))
    rest = joined.filter(F.octet_length("payload") < frame_len).select(*keys, "frame_no", F.col("payload").alias("rest"))
    return frames, rest
