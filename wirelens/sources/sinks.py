"""Per-message outputs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.functions.text import safe_name
from wirelens.operators.decode import decode_fields, decode_long
from wirelens.operators.nmea import nmea_rows
from wirelens.operators.verify import verify
from wirelens.plans.model import Message, check_headers, value_headers
from wirelens.sources.outputs import FORMATS, write_outputs


def output_key(name: Column, length: Column, port: Column, stamp: str) -> Column:
    """``name_length_port_stamp`` with a file-safe name."""
    return F.concat_ws("_", safe_name(name), length.cast("string"), port.cast("string"), F.lit(stamp))


def output_name(message: Message, stamp: str) -> str:
    text = re.sub(r"\s+", "_", re.sub(r'[\\/:*?"<>|]', "_", message.name.strip()))
    text = re.sub(r"_+", "_", text).strip("_") or "export"
    return f"{text}_{message.length}_{message.port}_{stamp}"


def message_output(routed: DataFrame, message: Message, keep: tuple[str, ...] = (), values_only: bool = False) -> DataFrame:
    """All columns of one message's output: values, then checks."""
    if message.format == "NMEA":
        return nmea_rows(routed, message, keep=keep)
    checked = verify(routed, message)
    checks = tuple(c for c in check_headers(message) if c in checked.columns)
    out = decode_fields(checked, message, values_only=values_only, keep=keep + checks)
    lead = [c for c in out.columns if c not in checks and c not in value_headers(message)]
    return out.select(*[f"`{c}`" for c in lead + value_headers(message) + list(checks)])


def write_decoded(
    routed: DataFrame,
    messages: list[Message],
    path: str,
    stamp: str,
    staging: str,
    fmt: str = "parquet",
    values_only: bool = False,
) -> list[str]:
    """One output folder per message, named ``name_length_port_stamp``.

    Routed rows are written once to ``staging`` partitioned by message, so the
    source is read once however many messages there are, and every output reads
    only its own partition. All outputs are then written by one job and become
    visible together (``outputs.write_outputs``); formats that it lacks are
    written one by one.
    """
    spark = routed.sparkSession
    outputs = staged_outputs(routed, messages, staging, stamp, values_only)
    if fmt in FORMATS:
        write_outputs(spark, outputs, path, fmt=fmt)
    else:
        for name, rows in outputs.items():
            rows.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/{name}")
    return [f"{path.rstrip('/')}/{name}" for name in outputs]


def _staged(routed: DataFrame, staging: str) -> DataFrame:
    """Routed rows written once, partitioned by message, with the message's number as ``part``."""
    routed.withColumn("part", F.col("def_order")).write.mode("overwrite").partitionBy("part").parquet(staging)
    schema = T.StructType([*routed.schema.fields, T.StructField("part", T.IntegerType())])
    return routed.sparkSession.read.schema(schema).parquet(staging)


def mixed_outputs(routed: DataFrame, messages: list[Message], staging: str, keys: tuple[str, ...] = ("file", "packet_no")) -> DataFrame:
    """(keys, message, pos, ord, column, text): every column of every message's output as display text, one row each.

    Values, bit rules, profiles and checks of all messages share one table, so
    messages of any layout can be written or shown together. ``pos`` numbers the
    sentences of a datagram. The source is read once.
    """
    staged = _staged(routed, staging)
    parts = []
    for i, m in enumerate(messages):
        rows = staged.filter(F.col("part") == i).drop("part")
        if m.format == "NMEA":
            out, names, pos = nmea_rows(rows, m), [f.name for f in m.fields], F.col("pos")
        else:
            checked = verify(rows, m, text_parity=True)
            checks = [c for c in check_headers(m) if c in checked.columns]
            names, pos = value_headers(m) + checks, F.lit(0)
            out = decode_fields(checked, m, text_parity=True, keep=tuple(checks))
        cells = [F.struct(F.lit(k).alias("ord"), F.lit(n).alias("column"), F.col(f"`{n}`").cast("string").alias("text")) for k, n in enumerate(names)]
        if cells:
            parts.append(out.select(*keys, F.lit(m.name).alias("message"), pos.alias("pos"), F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, parts)


def staged_outputs(
    routed: DataFrame, messages: list[Message], staging: str, stamp: str, values_only: bool = False, ready=lambda rows, i: rows
) -> dict[str, DataFrame]:
    """Output names and rows by message, from one write of the routed rows partitioned by message.

    ``ready(rows, i)`` may add columns to the staged rows of message ``i``.
    Of messages with one output name the last one's rows count, as with writes one after another.
    """
    staged = _staged(routed, staging)
    outputs: dict[str, DataFrame] = {}
    for i, m in enumerate(messages):
        rows = message_output(ready(staged.filter(F.col("part") == i).drop("part"), i), m, values_only=values_only)
        outputs[output_name(m, stamp)] = rows
    return outputs


def write_decoded_long(routed: DataFrame, messages: list[Message], path: str, stamp: str) -> None:
    """All messages in one pass, long form, partitioned by output key."""
    names = {m.name: output_name(m, stamp) for m in messages}
    key = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("message")]
    decode_long(routed, messages).withColumn("message_key", key).write.mode("overwrite").partitionBy(
        "message_key"
    ).parquet(path)
