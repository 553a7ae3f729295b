"""Payload bytes to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.functions import bits
from wirelens.functions import bytes as by
from wirelens.functions.bind import bind
from wirelens.operators.joins import lookup_join
from wirelens.plans.model import SIGNED, UNSIGNED, Field, Message, fields_frame, value_headers

META = ("file", "packet_no", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "payload_size", "connection_id")


def field_value(h: Column, f: Field) -> Column:
    """Typed value of a field from the hex of its slice; NULL stays NULL."""
    n = f.size
    if n <= 0:
        return F.lit(None).cast("string")
    if f.type == "String":
        return by.string_of(h)
    if n > 8:
        if f.type not in UNSIGNED + SIGNED:
            return F.lit(None).cast("double")
        return by.scale(by.wide_of(h, n, f.type in SIGNED), f.resolution)
    if f.type in UNSIGNED:
        return by.scale(by.unsigned_of(h, n), f.resolution)
    if f.type in SIGNED:
        return by.scale(by.signed_of(h, n), f.resolution)
    if f.type in ("Float32", "Float64"):
        if n != (4 if f.type == "Float32" else 8):
            return F.lit(None).cast("double")
        return by.scale(by.float_of(h, n), f.resolution)
    return by.raw_of(h) != 0


def _as_text(value: Column, f: Field) -> Column:
    if f.type == "String":
        text = value
    elif f.type == "Bool":
        text = F.when(value, "true").otherwise("false")
        text = F.when(value.isNotNull(), text)
    elif f.type in ("Float32", "Float64") or by.has_scale(f.resolution):
        text = by.fixed6(value.cast("double"))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("N/A"))


def bind_slices(df: DataFrame, message: Message, payload: str = "payload") -> DataFrame:
    """Bind the hex slice of every field as ``_f<i>``: bytes are cut once per row."""
    data = F.col(payload)
    return bind(df, {f"_f{i}": by.slice_hex(data, f.off0, f.size) for i, f in enumerate(message.fields)})


def value_columns(message: Message, text_parity: bool = False) -> list[Column]:
    """Value, bit-rule and profile columns over bound slices, aliased in header order."""
    slot = {f.name: i for i, f in enumerate(message.fields)}  # a repeated name: the last one controls
    out = []
    for i, f in enumerate(message.fields):
        h = F.col(f"_f{i}")
        value = field_value(h, f)
        out.append(_as_text(value, f) if text_parity else value)
        extra = [bits.decode_bits(h, f.size, r) for r in f.bit_rules]
        if f.profiles:
            j = slot.get(f.profiles.controller)
            usable = j is not None and 1 <= message.fields[j].size <= 8
            extra += bits.decode_profiles(h, f.size, by.raw_of(F.col(f"_f{j}")) if usable else None, f.profiles)
        out += [F.coalesce(c, F.lit("")) for c in extra] if text_parity else extra
    return [c.alias(n) for c, n in zip(out, value_headers(message))]


def decode_fields(
    routed: DataFrame,
    message: Message,
    payload: str = "payload",
    values_only: bool = False,
    text_parity: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows of one message, one column per value in declared order."""
    rows = routed.filter(F.col("message") == message.name) if "message" in routed.columns else routed
    meta = [] if values_only else [c for c in META if c in routed.columns and c not in value_headers(message)]
    bound = bind_slices(rows.select(*meta, *keep, F.col(payload).alias("_payload")), message, "_payload")
    return bound.select(*meta, *keep, *value_columns(message, text_parity))


def field_slices(datagrams: DataFrame, fields: DataFrame, keys: tuple[str, ...], payload: str = "payload") -> DataFrame:
    """Long form per field: 1-based offset, length, type and the hex slice clipped at the end."""
    pairs = lookup_join(
        datagrams.select(*keys, "message", F.col(payload).alias("_p")), fields, ["message"], spread=list(keys)
    )
    inside = (F.col("off0") >= 0) & (F.col("off0") < F.octet_length("_p"))
    return pairs.select(
        *keys,
        "message",
        "ord",
        F.col("name").alias("field"),
        (F.col("off0") + 1).alias("offset"),
        F.col("len").alias("length"),
        F.col("type"),
        F.when(inside, F.hex(by.cut(F.col("_p"), F.col("off0"), F.col("len")))).otherwise("").alias("slice"),
    )


def decode_long(
    routed: DataFrame, fields, keys: tuple[str, ...] = ("file", "packet_no"), payload: str = "payload"
) -> DataFrame:
    """One row per (datagram, field) with ``value`` (double) and ``text``.

    ``fields`` is the ``fields`` dimension or a list of messages. Offsets and
    lengths are columns, so messages of any layout share one schema and one plan.
    """
    if isinstance(fields, DataFrame):
        dim, rows = fields, None
        # wide integers are exact texts made in Python, so rows go there only when some field needs it
        any_wide = not fields.filter((F.col("len") > 8) & (F.col("type") != "String")).isEmpty()
    else:
        messages = list(fields)
        dim = fields_frame(routed.sparkSession, messages)
        rows = sum(len(m.fields) for m in messages)
        any_wide = any(f.size > 8 and f.type != "String" for m in messages for f in m.fields)
    keys = tuple(k for k in keys if k in routed.columns)
    dim = dim.select("message", "ord", "name", "off0", "len", "type", "resolution")
    pairs = lookup_join(
        routed.select(*keys, "message", F.col(payload).alias("_p")), dim, ["message"], spread=list(keys), dim_rows=rows
    )
    n, off = F.col("len"), F.col("off0")
    inside = by.fits(F.col("_p"), off, n)
    number = ~F.col("type").isin("String") & inside & (n <= 8)
    staged = bind(
        pairs,
        {
            "_hex": F.when(number, by.cut_hex(F.col("_p"), off, n)),
            "_text": F.when(F.col("type") == "String", by.slice_hex(F.col("_p"), off, n)),
        },
    )
    staged = bind(staged, {"_raw": by.raw_of(F.col("_hex"))})
    signed, plain = F.col("type").isin(*SIGNED), F.col("type").isin(*UNSIGNED)
    shift = (64 - n * 8).cast("int")
    extended = F.when(n == 8, F.col("_raw")).otherwise(
        F.call_function("shiftright", F.call_function("shiftleft", F.col("_raw"), shift), shift)
    )
    real = (
        F.when((F.col("type") == "Float32") & (n == 4), by.float32_from_bits(F.col("_raw")))
        .when((F.col("type") == "Float64") & (n == 8), by.float64_from_bits(F.col("_raw")))
    )
    exact = F.when(plain, F.conv("_hex", 16, 10).cast(by.U64)).when(signed, extended.cast(by.U64))
    whole_text = exact.cast("string")
    if any_wide:
        wide = (plain | signed) & inside & (n > 8)
        wide_text = by.wide_integer_text(F.when(wide, by.cut(F.col("_p"), off, n)), signed)
        whole_text = F.coalesce(whole_text, wide_text)
    res = F.col("resolution")
    scaled = F.abs(res - 1.0) > by.ONE_TOLERANCE * F.least(F.abs(res), F.lit(1.0))
    if any_wide:
        # Python columns cannot be bound; the projection below keeps them apart.
        staged = staged.withColumns({"_whole": whole_text, "_real": real})
    else:
        staged = bind(staged, {"_whole": whole_text, "_real": real})
    base = F.coalesce(F.col("_real"), F.col("_whole").cast("double"))
    staged = bind(staged, {"_value": F.when(scaled, base * res).otherwise(base)})
    value = F.col("_value")
    flag = F.when(F.col("type") == "Bool", F.col("_raw") != 0)
    text = (
        F.when(F.col("type") == "String", by.string_of(F.col("_text")))
        .when(F.col("type") == "Bool", F.when(F.col("_raw") != 0, "true").when(F.col("_raw") == 0, "false"))
        .when(F.col("_real").isNotNull() | scaled, by.fixed6(value))
        .otherwise(F.col("_whole"))
    )
    return staged.select(
        *keys,
        "message",
        "ord",
        F.col("name").alias("field"),
        F.coalesce(value, flag.cast("double")).alias("value"),
        text.alias("text"),
    )


def column_types(message: Message, routed: DataFrame) -> T.StructType:
    """Schema of the decoded columns, resolved without running a job."""
    return decode_fields(routed, message, values_only=True).schema
