"""Event-time operators on Spark's state store: rates and frames that equal the batch operators.

Both wait for the watermark. A rate counts rows by time whatever their order of
arrival, so it is known once no earlier row can come; a frame is known when its
bytes are there. Keys are spread: the rate's state is kept by key and stretch of
time, the frames' by connection and stretch of bytes, so a key with a third of
all rows is many groups, and a group's state goes by a timer when its stretch is
over. Rows behind the watermark are late and count nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from wirelens.operators.verify import WINDOW_MS

BUCKET_MS = 60_000
# Columns on their way to a processor must not begin with an underscore: rows come as named tuples.

#: Frames of one connection whose pieces are one group.
STRIPE_FRAMES = 4096
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """State with timers and lists needs the store that keeps them on disk; queries take the setting when they start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _pack(*columns) -> bytes:
    import numpy as np

    return np.stack([np.asarray(c, np.int64) for c in columns]).tobytes()


def _unpack(data: bytes, columns: int = 2):
    import numpy as np

    return np.frombuffer(data, np.int64).reshape(columns, -1)


class _Rates(StatefulProcessor):
    """State of (key, stretch of time): rows that wait for the watermark, and counts per millisecond of those before them.

    ``waiting`` is a list with an entry for each batch, appended without reading
    the others; ``counts`` one value, cut to what a later row's window reaches.
    """

    def __init__(self, keys: list[str], order: str, window_ms: int, bucket_ms: int):
        self.keys, self.order, self.window_ms, self.bucket_ms = keys, order, window_ms, bucket_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.counts = handle.getValueState("counts", "per_ms binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        import numpy as np

        mark = timerValues.getCurrentWatermarkInMs()
        fresh = pd.concat([pdf[["x_us", "x_ms", "x_own", self.order]] for pdf in rows])
        fresh = fresh[fresh["x_ms"] >= mark]
        if len(fresh):
            own, before = fresh[fresh["x_own"]], fresh[~fresh["x_own"]]
            if len(own):
                self.waiting.appendValue((_pack(own["x_us"], own[self.order]),))
            if len(before):
                ms, n = np.unique(before["x_ms"].to_numpy(np.int64), return_counts=True)
                self._count(ms, n, mark)
            self.handle.registerTimer((int(key[-1]) + 1) * self.bucket_ms)
        yield from self._ready(key, mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._ready(key, timerValues.getCurrentWatermarkInMs())
        self.waiting.clear()
        self.counts.clear()

    def _count(self, ms, n, mark: int):
        """Add to the counts; those out of reach of rows from ``mark`` on go. Returns all before they go."""
        import numpy as np

        if self.counts.exists():
            old = _unpack(self.counts.get()[0])
            ms, n = np.append(old[0], ms), np.append(old[1], n)
        each, place = np.unique(ms, return_inverse=True)
        total = np.bincount(place, n, len(each)).astype(np.int64)
        live = each >= mark - self.window_ms
        self.counts.update((_pack(each[live], total[live]),))
        return each, total

    def _ready(self, key, mark: int) -> Iterator[pd.DataFrame]:
        """Rows that no earlier one can join any more, with their counts."""
        import numpy as np

        if not self.waiting.exists():
            return
        us, order = np.concatenate([_unpack(r[0]) for r in self.waiting.get()], axis=1)
        done = us // 1000 < mark
        if not done.any():
            return
        if done.all():
            self.waiting.clear()
        else:
            self.waiting.put([(_pack(us[~done], order[~done]),)])
        sort = np.lexsort((order[done], us[done] // 1000))
        us, order = us[done][sort], order[done][sort]
        ms = us // 1000
        each, own = np.unique(ms, return_counts=True)
        every, total = self._count(each, own, mark)
        upto = np.append(0, np.cumsum(total))
        before = upto[np.searchsorted(every, ms)] - upto[np.searchsorted(every, ms - self.window_ms)]
        rank = np.arange(len(ms)) - np.searchsorted(ms, ms) + 1
        out = {k: [key[i]] * len(ms) for i, k in enumerate(self.keys)}
        yield pd.DataFrame({**out, self.order: order, "x_us": us, "refresh_hz": before + rank})

    def close(self) -> None:
        pass


def stateful_refresh_rate(
    stream: DataFrame,
    keys: tuple[str, ...] = ("message",),
    ts: str = "ts",
    order: str = "packet_no",
    window_ms: int = WINDOW_MS,
    bucket_ms: int = BUCKET_MS,
    delay: str = "10 seconds",
) -> DataFrame:
    """(keys, order, ts, refresh_hz) of a stream: arrivals of the key in [ts - window, ts], as ``verify.refresh_rate`` counts them.

    A row comes out when the watermark, ``delay`` behind the newest time, has
    passed it. Rows without a time count as never seen here.
    """
    use_state_store(stream.sparkSession)
    bucket_ms = max(bucket_ms, window_ms)
    timed = stream.select(*keys, order, ts).filter(F.col(ts).isNotNull()).withWatermark(ts, delay)
    ms = F.unix_millis(ts)
    home = F.floor(ms / bucket_ms)
    both = F.when(ms >= (home + 1) * bucket_ms - window_ms, F.array(home, home + 1)).otherwise(F.array(home))
    spread = timed.select("*", F.unix_micros(ts).alias("x_us"), ms.alias("x_ms"), F.explode(both).alias("x_bucket"))
    spread = spread.withColumn("x_own", F.col("x_bucket") == F.floor(F.col("x_ms") / bucket_ms))
    fields = [stream.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField(order, T.LongType()), T.StructField("x_us", T.LongType()), T.StructField("refresh_hz", T.LongType())])
    rated = spread.groupBy(*keys, "x_bucket").transformWithStateInPandas(
        _Rates(list(keys), order, window_ms, bucket_ms), schema, outputMode="Append", timeMode="EventTime"
    )
    return rated.select(*keys, order, F.timestamp_micros("x_us").alias(ts), "refresh_hz")


class _Frames(StatefulProcessor):
    """State of (connection, stretch of bytes): pieces of frames that aren't whole, and the time they are given up."""

    def __init__(self, keys: list[str], frame_len: int, wait_ms: int):
        self.keys, self.frame_len, self.wait_ms = keys, frame_len, wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "frame_no long, at long, us long, piece binary")
        self.until = handle.getValueState("until", "ms long")

    def _out(self, key, rows: list[tuple]) -> pd.DataFrame:
        out = {k: [key[i]] * len(rows) for i, k in enumerate(self.keys)}
        names = ("frame_no", "payload", "x_us", "complete")
        return pd.DataFrame({**out, **{n: [r[i] for r in rows] for i, n in enumerate(names)}})

    def _joined(self, frame_no: int, parts: list[tuple]) -> tuple | None:
        """The frame, if its pieces cover it; of bytes that came twice the first piece by place counts."""
        at, data = frame_no * self.frame_len, b""
        for _, lo, _, piece in sorted(parts, key=lambda p: (p[1], -len(p[3]))):
            if lo > at + len(data):
                return None
            data += bytes(piece)[at + len(data) - lo :]
        return (frame_no, data, max(p[2] for p in parts), True) if len(data) >= self.frame_len else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple]] = {}
        for frame_no, at, us, piece in self.pieces.get() if self.pieces.exists() else ():
            held.setdefault(frame_no, []).append((frame_no, at, us, piece))
        newest = 0
        for pdf in rows:
            for frame_no, at, us, piece in zip(pdf["frame_no"], pdf["x_at"], pdf["x_us"], pdf["x_piece"], strict=True):
                held.setdefault(int(frame_no), []).append((int(frame_no), int(at), int(us), bytes(piece)))
                newest = max(newest, int(us) // 1000)
        done = {n: f for n, parts in held.items() if (f := self._joined(n, parts))}
        left = [p for n, parts in held.items() if n not in done for p in parts]
        if left:
            self.pieces.put(left)
            until = newest + self.wait_ms
            if self.until.exists():
                until = max(until, self.until.get()[0])
                self.handle.deleteTimer(self.until.get()[0])
            until = max(until, timerValues.getCurrentWatermarkInMs() + 1)
            self.until.update((until,))
            self.handle.registerTimer(until)
        elif self.until.exists():
            self.handle.deleteTimer(self.until.get()[0])
            self.until.clear()
            self.pieces.clear()
        if done:
            yield self._out(key, [done[n] for n in sorted(done)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What has come of frames that are given up, from their first byte on as far as it goes."""
        held: dict[int, list[tuple]] = {}
        for p in self.pieces.get() if self.pieces.exists() else ():
            held.setdefault(p[0], []).append(p)
        rows = []
        for n, parts in sorted(held.items()):
            data = b""
            for _, lo, _, piece in sorted(parts, key=lambda p: (p[1], -len(p[3]))):
                if lo <= n * self.frame_len + len(data):
                    data += bytes(piece)[n * self.frame_len + len(data) - lo :]
            rows.append((n, data, max(p[2] for p in parts), False))
        self.pieces.clear()
        self.until.clear()
        if rows:
            yield self._out(key, rows)

    def close(self) -> None:
        pass


def stateful_reframe(
    chunks: DataFrame,
    frame_len: int,
    keys: tuple[str, ...] = ("connection_id",),
    position: str = "position",
    data: str = "chunk",
    ts: str = "ts",
    wait_ms: int = 60_000,
    delay: str = "10 seconds",
    stripe_frames: int = STRIPE_FRAMES,
) -> DataFrame:
    """(keys, frame_no, payload, ts, complete): frames of ``frame_len`` bytes from chunks with their byte position in the stream.

    Chunks may come in any order and repeatedly. Frames that lie in one chunk
    need no state; the pieces of the others wait for each other, at most ``wait_ms``
    beyond the newest of them, and then come out with ``complete`` false.
    """
    if frame_len <= 0:
        raise ValueError("frames need a length")
    use_state_store(chunks.sparkSession)
    timed = chunks.filter(F.octet_length(data) > 0).withWatermark(ts, delay)
    start = F.col(position)
    end = start + F.octet_length(data)
    placed = timed.withColumn("frame_no", F.explode(F.sequence(F.floor(start / frame_len), F.floor((end - 1) / frame_len))))
    lo = F.greatest(start, F.col("frame_no") * frame_len)
    hi = F.least(end, (F.col("frame_no") + 1) * frame_len)
    piece = F.substring(F.col(data), (lo - start + 1).cast("int"), (hi - lo).cast("int"))
    cut = placed.select(*keys, "frame_no", lo.alias("x_at"), F.unix_micros(ts).alias("x_us"), piece.alias("x_piece"), ts, (hi - lo == frame_len).alias("x_whole"))
    fields = [chunks.schema[k] for k in keys]
    rest = T.StructType.fromDDL("frame_no long, payload binary, x_us long, complete boolean").fields
    stripes = cut.filter(~F.col("x_whole")).withColumn("x_stripe", F.floor(F.col("frame_no") / stripe_frames))
    joined = stripes.groupBy(*keys, "x_stripe").transformWithStateInPandas(
        _Frames(list(keys), frame_len, wait_ms), T.StructType([*fields, *rest]), outputMode="Append", timeMode="EventTime"
    )
    whole = cut.filter("x_whole").select(*keys, "frame_no", F.col("x_piece").alias("payload"), "x_us", F.lit(True).alias("complete"))
    both = whole.unionByName(joined)
    return both.select(*keys, "frame_no", "payload", F.timestamp_micros("x_us").alias(ts), "complete")
