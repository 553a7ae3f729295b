"""When messages are sent and arrive, and whether values survive encoding and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.functions.bits import binary_text
from wirelens.operators.decode import decode_fields
from wirelens.operators.encode import build_payloads
from wirelens.operators.route import message_destinations
from wirelens.operators.scan import running
from wirelens.plans.model import Message


def emission_schedule(messages: DataFrame, connections: DataFrame, seconds: float) -> DataFrame:
    """One row per frame: message, connection, millisecond, tick.

    Enabled messages send at 0 and then every max(1, round(1000 / Hz)) ms, one
    frame per destination. Ticks are made from the sequence of each message.
    """
    live = messages.filter(F.col("enabled") & (F.col("rate_hz") > 0))
    period = F.greatest(F.lit(1), F.floor(1000.0 / F.col("rate_hz") + 0.5)).cast("bigint")
    targets = message_destinations(live, connections)
    timed = live.select("message", "rate_hz", period.alias("period_ms")).join(targets, "message")
    last = F.lit(int(seconds * 1000)).cast("bigint")
    # Ticks come in stretches of at most a thousand so that no row grows an unbounded array.
    per = 1000
    ticks = F.floor((last - 1) / F.col("period_ms"))
    blocks = timed.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(ticks / per))))
    first = F.col("_block") * per
    out = blocks.withColumn("tick", F.explode(F.sequence(first, F.least(first + per - 1, ticks))))
    return out.select("message", "connection_id", "position", "tick", (F.col("tick") * F.col("period_ms")).alias("at_ms"))


# How far a decoded number may lie from the sent one.
def arrival_periods(routed: DataFrame, messages, keys: tuple[str, ...] = ("message",), ts: str = "ts", order: str = "packet_no", tolerance: float = 0.5) -> DataFrame:
    """Arrivals of each message against its period: (keys, arrivals, period_ms, on_time, early, late, missed, backwards).

    A gap is the time since the latest stamp before a row. On time is a gap
    within ``tolerance`` periods of one period; a later one misses as many as
    fit in. Rows whose stamp lies before an earlier one are ``backwards``. The
    latest stamp is a running maximum over chunks, so a message with most of the
    rows is no single task's work.
    """
    defs = F.create_map(*[F.lit(x) for m in messages for x in (m.name, float(m.rate_hz or 0))])
    period = F.try_divide(F.lit(1000.0), F.try_element_at(defs, F.col("message")))
    rows = routed.filter(F.col(ts).isNotNull()).select(*dict.fromkeys([*keys, "message"]), order, F.unix_millis(ts).alias("_ms"))
    seen = running(rows, list(keys), order, {"_top": ("max", F.col("_ms"))})
    timed = seen.withColumns({"_gap": F.col("_ms") - F.col("_top"), "_period": period})
    gap, known = F.col("_gap"), F.col("_gap") >= 0
    low, high = F.col("_period") * (1 - tolerance), F.col("_period") * (1 + tolerance)
    return timed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("arrivals"),
        F.max("_period").alias("period_ms"),
        F.count_if(known & (gap >= low) & (gap <= high)).alias("on_time"),
        F.count_if(known & (gap < low)).alias("early"),
        F.count_if(known & (gap > high)).alias("late"),
        F.coalesce(F.sum(F.when(known & (gap > high), F.floor(gap / F.col("_period") + 0.5) - 1)), F.lit(0)).alias("missed"),
        F.count_if(gap < 0).alias("backwards"),
    )


TOLERANCE = {"Float32": 1e-3, "Float64": 1e-9}


def roundtrip_check(df: DataFrame, message: Message, keys: list[str], values: dict, texts: bool = False) -> DataFrame:
    """Encode, decode and compare: one row per (key, field) that does not come back."""
    named = {f"_in_{f.name}": values[f.name] for f in message.fields if f.name in values}
    staged = df.select(*keys, *[v.alias(n) for n, v in named.items()])
    built = build_payloads(staged, message, {n[4:]: F.col(f"`{n}`") for n in named}, texts)
    back = decode_fields(built, message, values_only=True, keep=tuple(keys + list(named) + ["problems"]))
    items = []
    for f in message.fields:
        sent = F.col(f"`_in_{f.name}`") if f"_in_{f.name}" in named else F.lit(None).cast("string")
        got = F.col(f"`{f.name}`")
        if f.type == "String":
            same = got.eqNullSafe(sent.cast("string"))
        elif f.type == "Bool":
            same = got.eqNullSafe(sent.cast("boolean"))
        else:
            step = max(TOLERANCE.get(f.type, 0.5), 0.0) * (f.resolution if f.type not in TOLERANCE else 1.0)
            near = F.abs(got.cast("double") - sent.try_cast("double")) <= step * (1 + 1e-9)
            same = F.coalesce(near, F.lit(False))
        items.append(
            F.when(
                F.col("problems").isNotNull() | ~same,
                F.struct(F.lit(f.name).alias("field"), sent.cast("string").alias("sent"), got.cast("string").alias("got")),
            )
        )
    faults = back.withColumn("_x", F.explode(F.array_compact(F.array(*items))))
    return faults.select(*keys, "_x.field", "_x.sent", "_x.got", "problems")


def bit_rules_long(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Enabled rules as (bit, position) rows and as (value, binary, meaning) rows."""
    rules = fields.select("message", F.col("name").alias("field"), F.posexplode("bit_rules").alias("rule_no", "r")).filter("r.enabled")
    width = F.size("r.positions")
    kind = F.when(F.col("r.reserved"), "RESERVED").when(width == 1, "SINGLE_BIT").otherwise("GROUPED_BITS")
    base = rules.select("message", "field", "rule_no", F.trim("r.label").alias("label"), kind.alias("kind"), "r", width.alias("width"))
    bits = base.select("message", "field", "rule_no", "label", "kind", F.posexplode("r.positions").alias("idx", "bit"))
    entries = base.select("message", "field", "rule_no", "label", "kind", "width", F.explode("r.meanings").alias("value", "meaning"))
    # A decimal above 2^63 keeps its bit pattern through its hex form.
    pattern = F.conv(F.col("value").cast("string"), 10, -10).cast("bigint")
    meanings = entries.select(
        "message", "field", "rule_no", "label", "kind", "value", binary_text(pattern, F.col("width")).alias("binary"), "meaning"
    )
    return bits, meanings
