"""Verification columns: headers, checksums, lengths, ids, byte order, refresh rate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.functions import bytes as by
from wirelens.functions.bind import bind
from wirelens.operators.scan import CHUNK, running
from wirelens.plans.model import MULTI_BYTE, Field, Message, check_headers

WINDOW_MS = 1000
BUCKET_MS = 60_000

# Column names and reason texts of the checks are an output format; parsers of written reports rely on them.


def hex_fixed(value: Column, size: int) -> Column:
    """``0x`` and at least two hex digits per byte of ``size``."""
    width = 2 * size if size > 0 else 2
    return F.concat(F.lit("0x"), F.lpad(F.hex(value.cast("bigint")), width, "0"))


def _flag(ok: Column) -> Column:
    return F.when(ok, "True").otherwise("False")


# The compare functions take observed values as columns, so that ``verify`` can
# bind each slice once; the public checks read them from a payload.


def _compare_bytes(label: str, got: Column, expected: bytes) -> tuple[dict[str, Column], Column | None]:
    columns = {f"{label}Observed": F.coalesce(got, F.lit("N/A"))}
    if not expected:
        return columns, None
    want = expected.hex().upper()
    columns[f"{label}Expected"] = F.lit(want)
    columns[f"{label}OK"] = _flag(got.eqNullSafe(F.lit(want)))
    reason = F.when(got.isNull(), f"{label} OutOfBounds").when(
        got != want, F.concat(F.lit(f"{label} mismatch (got "), got, F.lit(f", expected {want})"))
    )
    return columns, reason


def _terminator_slice(payload: Column, off0: int, length: int) -> Column:
    """Offset -1 places the terminator at the end of the payload."""
    return by.slice_hex(payload, F.octet_length(payload) - length if off0 < 0 else off0, length)


def check_header(payload: Column, off0: int, length: int, expected: bytes = b""):
    return _compare_bytes("Header", by.slice_hex(payload, off0, length), expected)


def check_terminator(payload: Column, off0: int, length: int, expected: bytes = b""):
    return _compare_bytes("Terminator", _terminator_slice(payload, off0, length), expected)


def checksum_value(payload: Column, algorithm: str, start: int, end: int, size: int) -> Column:
    """XOR or SUM over [start, end) cut to ``size`` bytes; NULL when out of bounds."""
    if start < 0 or start >= end:
        return F.lit(None).cast("bigint")
    total = (by.xor_bytes if algorithm == "XOR" else by.sum_bytes)(payload, start, end)
    if 0 < size < 8:
        total = total.bitwiseAND(F.lit((1 << (8 * size)) - 1))
    # Adding NULL or 0 keeps the sum itself outside any conditional.
    return total + F.when(F.octet_length(payload) >= end, F.lit(0))


def _compare_checksum(computed: Column, stored: Column, size: int):
    shown, kept = hex_fixed(computed, size), hex_fixed(stored, size)
    columns = {
        "ChecksumComputed": F.coalesce(shown, F.lit("N/A")),
        "ChecksumStoredInPayload": F.coalesce(kept, F.lit("N/A")),
        "ChecksumOK": _flag(F.coalesce(computed == stored, F.lit(False))),
    }
    reason = F.when(computed.isNull() | stored.isNull(), "Checksum OutOfBounds").when(
        computed != stored, F.concat(F.lit("Checksum mismatch (computed "), shown, F.lit(", stored "), kept, F.lit(")"))
    )
    return columns, reason


def check_checksum(payload: Column, algorithm: str, start: int, end: int, off0: int, size: int):
    computed = checksum_value(payload, algorithm, start, end, size)
    return _compare_checksum(computed, by.be_raw(payload, off0, size), size)


def _compare_length(stored: Column, payload: Column, adjust: int):
    computed = (F.octet_length(payload) - adjust).cast("bigint")
    columns = {
        "DataLenStored": F.coalesce(stored.cast("string"), F.lit("N/A")),
        "DataLenComputed": computed.cast("string"),
        "DataLenOK": _flag(F.coalesce(stored == computed, F.lit(False))),
    }
    reason = F.when(stored.isNull(), "DataLength OutOfBounds").when(
        stored != computed, F.format_string("DataLength mismatch (stored %s, computed %s)", stored, computed)
    )
    return columns, reason


def check_data_length(payload: Column, off0: int, size: int, adjust: int):
    return _compare_length(by.be_raw(payload, off0, size), payload, adjust)


def _compare_id(observed: Column, size: int, expected: int):
    want = f"0x{expected:0{2 * size if size > 0 else 2}X}"
    shown = hex_fixed(observed, size)
    ok = observed == (expected - (1 << 64) if expected >= 1 << 63 else expected)
    columns = {
        "MsgIdObserved": F.coalesce(shown, F.lit("N/A")),
        "MsgIdExpected": F.lit(want),
        "MsgIdOK": _flag(F.coalesce(ok, F.lit(False))),
    }
    reason = F.when(observed.isNull(), "MessageId OutOfBounds").when(
        ~ok, F.concat(F.lit("MessageId mismatch (got "), shown, F.lit(f", expected {want})"))
    )
    return columns, reason


def check_message_id(payload: Column, off0: int, size: int, expected: int):
    return _compare_id(by.be_raw(payload, off0, size), size, expected)


def endian_values(h: Column, f: Field) -> tuple[Column, Column]:
    """Big- and little-endian reading of a multi-byte numeric field from its hex slice."""
    n = f.size
    if f.type in ("Float32", "Float64"):
        need = 4 if f.type == "Float32" else 8
        if n < need:
            return F.lit(None).cast("double"), F.lit(None).cast("double")
        head = F.substring(h, 1, 2 * need) if n > need else h
        return by.float_of(head, need), by.float_of(by.swap_hex(head, need), need)
    read = by.signed_of if f.type.startswith("Int") else by.unsigned_of
    return read(h, n), read(by.swap_hex(h, n), n)


@F.pandas_udf(T.StringType())
def short_number(value: pd.Series, digits: pd.Series) -> pd.Series:
    """Shortest general form with the given significant digits, as C prints it."""
    return pd.Series(
        [None if v is None else f"{v:.{d}g}" for v, d in zip(value.astype(object), digits)], dtype=object
    )


def bind_endian(rows: DataFrame, fields: tuple[Field, ...], payload: str = "payload") -> DataFrame:
    """Bind both byte orders of every multi-byte numeric field as ``<name>_BE`` and ``<name>_LE``."""
    numeric = [f for f in fields if f.type in MULTI_BYTE]
    if not numeric:
        return rows
    cut = bind(rows, {f"_e{i}": by.slice_hex(F.col(payload), f.off0, f.size) for i, f in enumerate(numeric)})
    both: dict[str, Column] = {}
    for i, f in enumerate(numeric):
        both[f"{f.name}_BE"], both[f"{f.name}_LE"] = endian_values(F.col(f"_e{i}"), f)
    return bind(cut, both).drop(*[f"_e{i}" for i in range(len(numeric))])


def check_endianness(fields: tuple[Field, ...], expected: str):
    """Columns over bound readings; decoding is big-endian, so only BIG is OK."""
    columns: dict[str, Column] = {}
    reasons = []
    for f in fields:
        if f.type not in MULTI_BYTE:
            continue
        columns[f"{f.name}_BE"], columns[f"{f.name}_LE"] = F.col(f"`{f.name}_BE`"), F.col(f"`{f.name}_LE`")
        if expected:
            columns[f"{f.name}_EndianOK"] = F.lit("True" if expected == "BIG" else "False")
            if expected != "BIG":
                reasons.append(F.lit(f"Endian configured {expected} but project decodes BIG (field {f.name})"))
    if expected:
        columns["EndianConfigured"] = F.lit(expected)
    return columns, reasons


def _general6(value: float) -> str:
    return f"{value:.6g}"


def _endian_texts(rows: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """Readings as display text: integers in full, floats with 7 or 15 digits."""
    texts = {}
    for f in fields:
        for side in ("BE", "LE") if f.type in MULTI_BYTE else ():
            value = F.col(f"`{f.name}_{side}`")
            digits = {"Float32": 7, "Float64": 15}.get(f.type)
            text = short_number(value, F.lit(digits)) if digits else value.cast("string")
            # Arrow turns a missing double into NaN, so absence is decided outside the function.
            texts[f"{f.name}_{side}"] = F.when(value.isNull(), "N/A").otherwise(text)
    return rows.withColumns(texts) if texts else rows


def verify(
    routed: DataFrame,
    message: Message,
    payload: str = "payload",
    observed_hz: str = "refresh_hz",
    text_parity: bool = False,
) -> DataFrame:
    """Add the message's check columns; sentence messages get none.

    Every check but the refresh rate is a projection. The refresh rate reads the
    column ``observed_hz`` and is computed here when the input lacks it.
    """
    c = message.checks
    rows = routed.filter(F.col("message") == message.name) if "message" in routed.columns else routed
    if c is None or message.format == "NMEA":
        return rows
    if c.refresh_rate and observed_hz not in rows.columns:
        rows = refresh_rate(rows, name=observed_hz)
    data = F.col(payload)
    parts: dict[str, Column] = {}
    if c.header:
        parts["_header"] = by.slice_hex(data, *c.header)
    if c.terminator:
        parts["_terminator"] = _terminator_slice(data, *c.terminator)
    if c.checksum:
        parts["_computed"] = checksum_value(data, *c.checksum[:3], c.checksum[4])
        parts["_stored"] = by.be_raw(data, *c.checksum[3:])
    if c.data_length:
        parts["_length"] = by.be_raw(data, *c.data_length[:2])
    if c.message_id:
        parts["_ident"] = by.be_raw(data, *c.message_id[:2])
    rows = bind(rows, parts) if parts else rows
    if c.endianness is not None:
        rows = bind_endian(rows, message.fields, payload)
    columns: dict[str, Column] = {}
    reasons: list[Column] = []

    def add(result):
        columns.update(result[0])
        extra = result[1] if isinstance(result[1], list) else [result[1]]
        reasons.extend(r for r in extra if r is not None)

    if c.header:
        add(_compare_bytes("Header", F.col("_header"), c.expected_header))
    if c.terminator:
        add(_compare_bytes("Terminator", F.col("_terminator"), c.expected_terminator))
    if c.checksum:
        add(_compare_checksum(F.col("_computed"), F.col("_stored"), c.checksum[4]))
    if c.refresh_rate:
        expected, tolerance = c.refresh_rate
        seen = F.col(observed_hz)
        columns["RefreshRateObservedHz"] = seen
        if expected > 0:
            bad = F.abs(seen - expected) > tolerance
            columns["RefreshRateExpectedHz"] = F.lit(_general6(expected))
            columns["RefreshRateOK"] = _flag(~bad)
            tail = f"Hz outside {_general6(expected)}+/-{_general6(tolerance)}Hz"
            reasons.append(F.when(bad, F.concat(F.lit("RefreshRate "), seen.cast("string"), F.lit(tail))))
    if c.endianness is not None:
        add(check_endianness(message.fields, c.endianness))
    if c.data_length:
        add(_compare_length(F.col("_length"), data, c.data_length[2]))
    if c.message_id:
        add(_compare_id(F.col("_ident"), *c.message_id[1:]))
    if c.compares:
        columns["CompareReason"] = F.concat_ws("; ", *reasons) if reasons else F.lit("")
    ordered = {n: columns[n] for n in check_headers(message)}
    out = bind(rows, ordered).drop(*parts)
    return _endian_texts(out, message.fields) if text_parity and c.endianness is not None else out


# -------------------------------------------------------------- refresh rate


def _millis(ts: str) -> Column:
    return F.coalesce(F.unix_millis(F.col(ts)), F.lit(0).cast("bigint"))


def _join_keys(left_keys: list[str], prefix: str) -> Column:
    same = F.lit(True)
    for k in left_keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return same


def millis_counts(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Arrivals per millisecond: the only state a sliding rate needs."""
    return df.groupBy(*keys, _millis(ts).alias("_ms")).agg(F.count(F.lit(1)).alias("_n"))


def refresh_rate(
    df: DataFrame,
    keys: tuple[str, ...] = ("file", "message"),
    ts: str = "ts",
    order: str = "packet_no",
    window_ms: int = WINDOW_MS,
    name: str = "refresh_hz",
    seed: DataFrame | None = None,
    exact: bool = False,
    chunk: int | None = CHUNK,
    bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Arrivals of the same key in [now - window, now] up to and including this one.

    Rows are reduced to counts per millisecond before any window runs; the
    windows run over time buckets with an overlap of one window length, and
    equal timestamps are ranked in chunks of the (unique integer) order column.
    No step holds a whole key. ``seed`` adds earlier counts (keys, _ms, _n).

    Timestamps that step back follow the arrival queue only with ``exact=True``
    (``_queue_rate``), which takes no ``seed``, and with ``chunk`` None any order.
    """
    keys = [k for k in keys if k in df.columns]
    bucket_ms = max(bucket_ms, window_ms)  # a window must not reach past the bucket before
    staged = df.withColumn("_ms", _millis(ts))
    if exact:
        if seed is not None:
            raise ValueError("exact rates take no counts of earlier rows")
        return _queue_rate(staged, keys, order, window_ms, name, chunk, bucket_ms).drop("_ms")
    return _ordered_rate(staged, staged, keys, order, window_ms, name, seed, chunk or CHUNK, bucket_ms).drop("_ms")


def _queue_rate(df: DataFrame, keys: list[str], order: str, window_ms: int, name: str, chunk: int, bucket_ms: int) -> DataFrame:
    """Length of the arrival queue after each row, as prefix scans.

    A row is appended, then rows older than its window leave from the front; a
    late row in front keeps all behind it. So the front of row i is the first
    row j of all with ms_j >= m_i - window, m_i the largest ms up to i: rows
    before the front were below an earlier bound, and bounds only grow by m. The
    first row to reach a value is a record (larger than all before it), and m
    changes at records only, so

    - a scan gives every row its place and m,
    - rows where m changes, and the first row of each chunk, are steps; at most
      one per millisecond and chunk, they find their front among the steps of
      the window before them, in buckets of time,
    - a row has the front of the step of its chunk with the same m: one join,
      in which no key has more rows than a chunk.

    Summaries of chunks are combined by maximum and sum, whatever the clocks do:
    after one stamp far in the future nothing but a number is carried on.
    """
    totals = {"_top": ("max", F.col("_ms")), "_place": ("sum", F.lit(1).cast("bigint"))}
    # rows of equal order in order of time: the scan is made twice, for the steps and for the rows, and must come out the same
    placed = running(df, keys, order, totals, chunk, ties=("_ms",), piece="_piece")
    placed = placed.withColumn("_now", F.greatest("_top", "_ms")).drop("_top")
    ahead = F.lag("_now").over(Window.partitionBy(*keys, "_piece").orderBy(order, "_ms"))
    steps = placed.select(*keys, order, "_ms", "_piece", "_now", "_place").withColumn("_ahead", ahead).filter("_ahead IS NULL OR _ahead < _now")
    home = F.floor(F.col("_now") / bucket_ms)
    reach = F.when(F.col("_now") >= (home + 1) * bucket_ms - window_ms, F.array(home, home + 1)).otherwise(F.array(home))
    spread = steps.select(*keys, "_piece", "_now", "_place", F.explode(reach).alias("_bucket"))
    recent = Window.partitionBy(*keys, "_bucket").orderBy("_now").rangeBetween(-window_ms, 0)
    by = [*keys, "_piece", "_now"]
    fronts = (
        spread.withColumn("_front", F.min("_place").over(recent))
        .filter(F.col("_bucket") == home)
        .select(*[F.col(k).alias(f"_k_{k}") for k in by], "_front")
    )
    known = placed.join(fronts, _join_keys(by, "_k_"), "left")
    return known.withColumn(name, F.col("_place") - F.col("_front") + 1).drop("_place", "_front", "_piece", "_now", *[f"_k_{k}" for k in by])


def _ordered_rate(df, counted, keys, order, window_ms, name, seed, chunk, bucket_ms) -> DataFrame:
    slot = F.floor(F.col(order) / chunk)
    counts = counted.groupBy(*keys, "_ms", slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
    if seed is not None:
        counts = counts.unionByName(seed.select(*keys, "_ms", F.lit(-(1 << 62)).alias("_slot"), "_n"))
    earlier = Window.partitionBy(*keys, "_ms").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("_same", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    per_ms = counts.groupBy(*keys, "_ms").agg(F.sum("_n").alias("_n"))
    home = F.floor(F.col("_ms") / bucket_ms)
    reach = F.when(F.col("_ms") >= (home + 1) * bucket_ms - window_ms, F.array(home, home + 1)).otherwise(F.array(home))
    spread = per_ms.withColumn("_bucket", F.explode(reach))
    recent = Window.partitionBy(*keys, "_bucket").orderBy("_ms").rangeBetween(-window_ms, -1)
    prior = (
        spread.withColumn("_prior", F.coalesce(F.sum("_n").over(recent), F.lit(0)))
        .filter(F.col("_bucket") == home)
        .select(*[F.col(k).alias(f"_j_{k}") for k in keys + ["_ms"]], "_prior")
    )
    base = inside.join(prior, _join_keys(keys + ["_ms"], "_j_")).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys + ["_ms"]],
        F.col("_slot").alias("_k__slot"),
        (F.col("_prior") + F.col("_same")).alias("_base"),
    )
    rank = F.row_number().over(Window.partitionBy(*keys, "_ms", "_slot").orderBy(order))
    rows = df.withColumn("_slot", slot)
    out = rows.join(base, _join_keys(keys + ["_ms", "_slot"], "_k_"))
    scratch = ["_slot", "_base", "_k__slot", "_k__ms"] + [f"_k_{k}" for k in keys]
    return out.withColumn(name, F.col("_base") + rank).drop(*scratch)
