"""User-declared messages, fields and checks, and the columns they imply.

The model is plan-time metadata: it shapes the DataFrame schema. The same
content is available as bounded dimension DataFrames for relational work.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Type names and their natural byte lengths (0 = length required).
NATURAL_LENGTH = {
    "RawUnsignedBE": 0,
    "Uint8": 1,
    "Int8": 1,
    "Uint16": 2,
    "Int16": 2,
    "Uint32": 4,
    "Int32": 4,
    "Uint64": 8,
    "Int64": 8,
    "Float32": 4,
    "Float64": 8,
    "Bool": 1,
    "String": 0,
}
UNSIGNED = ("RawUnsignedBE", "Uint8", "Uint16", "Uint32", "Uint64")
SIGNED = ("Int8", "Int16", "Int32", "Int64")
MULTI_BYTE = ("Uint16", "Int16", "Uint32", "Int32", "Uint64", "Int64", "Float32", "Float64")


@dataclass(frozen=True)
class BitRule:
    label: str
    positions: tuple[int, ...]
    meanings: dict[int, str] = field(default_factory=dict, hash=False)
    unknown: str = "UNKNOWN"
    enabled: bool = True
    reserved: bool = False

    @property
    def kind(self) -> str:
        if self.reserved:
            return "RESERVED"
        return "SINGLE_BIT" if len(self.positions) == 1 else "GROUPED_BITS"


@dataclass(frozen=True)
class Exclusion:
    positions: tuple[int, ...]
    label: str
    invalid: str


@dataclass(frozen=True)
class Profile:
    name: str
    value: int
    rules: tuple[BitRule, ...] = ()
    exclusions: tuple[Exclusion, ...] = ()


@dataclass(frozen=True)
class Profiles:
    controller: str
    profiles: tuple[Profile, ...]
    unknown: str = "UNKNOWN_CONTROLLER"


@dataclass(frozen=True)
class Field:
    """One value of a message; ``offset`` is the 1-based byte position."""

    name: str
    offset: int = 0
    length: int = 0
    type: str = "RawUnsignedBE"
    resolution: float = 1.0
    bit_rules: tuple[BitRule, ...] = ()
    profiles: Profiles | None = None
    nmea_index: int = 0
    nmea_kind: str = "Text"
    little: bool = False
    expression: str = "1"

    @property
    def off0(self) -> int:
        return self.offset - 1

    @property
    def size(self) -> int:
        return self.length or NATURAL_LENGTH[self.type]


@dataclass(frozen=True)
class Checks:
    """Optional verification sections; a section left at None is off."""

    header: tuple[int, int] | None = None  # (offset0, length)
    expected_header: bytes = b""
    terminator: tuple[int, int] | None = None  # offset0 -1 = from the end
    expected_terminator: bytes = b""
    checksum: tuple[str, int, int, int, int] | None = None  # algorithm, start, end, stored offset0, stored length
    refresh_rate: tuple[float, float] | None = None  # expected Hz (0 = log only), tolerance
    endianness: str | None = None  # "BIG", "LITTLE", "" = log only
    data_length: tuple[int, int, int] | None = None  # offset0, size, adjust
    message_id: tuple[int, int, int] | None = None  # offset0, size, expected

    @property
    def compares(self) -> bool:
        return bool(
            (self.header and self.expected_header)
            or (self.terminator and self.expected_terminator)
            or self.checksum
            or (self.refresh_rate and self.refresh_rate[0] > 0)
            or self.endianness
            or self.data_length
            or self.message_id
        )


@dataclass(frozen=True)
class Message:
    name: str
    port: int = 0
    length: int = 0
    fields: tuple[Field, ...] = ()
    header: bytes = b""
    format: str = "HEX"
    sentence: str = ""
    talker: str = "GP"
    connection_id: str = ""
    connection_ids: tuple[str, ...] = ()
    rate_hz: float = 1.0
    enabled: bool = True
    checks: Checks | None = None


@dataclass(frozen=True)
class Connection:
    id: str
    name: str = ""
    transport: str = "UDP"
    adapter: str = ""
    port: int = 0
    host: str = ""


MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("message", T.StringType()),
        T.StructField("def_order", T.IntegerType()),
        T.StructField("port", T.IntegerType()),
        T.StructField("payload_len", T.IntegerType()),
        T.StructField("header", T.BinaryType()),
        T.StructField("format", T.StringType()),
        T.StructField("sentence", T.StringType()),
        T.StructField("talker", T.StringType()),
        T.StructField("connection_id", T.StringType()),
        T.StructField("connection_ids", T.ArrayType(T.StringType())),
        T.StructField("rate_hz", T.DoubleType()),
        T.StructField("enabled", T.BooleanType()),
    ]
)

RULE_SCHEMA = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
        T.StructField("meanings", T.MapType(T.DecimalType(20, 0), T.StringType())),
        T.StructField("unknown", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("reserved", T.BooleanType()),
    ]
)

EXCLUSION_SCHEMA = T.StructType(
    [
        T.StructField("positions", T.ArrayType(T.IntegerType())),
        T.StructField("label", T.StringType()),
        T.StructField("invalid", T.StringType()),
    ]
)

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("value", T.DecimalType(20, 0)),
        T.StructField("rules", T.ArrayType(RULE_SCHEMA)),
        T.StructField("exclusions", T.ArrayType(EXCLUSION_SCHEMA)),
    ]
)

FIELD_SCHEMA = T.StructType(
    [
        T.StructField("message", T.StringType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("off0", T.IntegerType()),
        T.StructField("len", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("resolution", T.DoubleType()),
        T.StructField("nmea_index", T.IntegerType()),
        T.StructField("nmea_kind", T.StringType()),
        T.StructField("little", T.BooleanType()),
        T.StructField("bit_rules", T.ArrayType(RULE_SCHEMA)),
        T.StructField("controller", T.StringType()),
        T.StructField("controller_unknown", T.StringType()),
        T.StructField("profiles", T.ArrayType(PROFILE_SCHEMA)),
    ]
)

CONNECTION_SCHEMA = T.StructType(
    [
        T.StructField("conn_order", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("transport", T.StringType()),
        T.StructField("adapter", T.StringType()),
        T.StructField("port", T.IntegerType()),
        T.StructField("host", T.StringType()),
    ]
)


def messages_frame(spark: SparkSession, messages: list[Message]) -> DataFrame:
    rows = [
        (
            m.name,
            i,
            m.port,
            m.length,
            bytearray(m.header),
            m.format,
            m.sentence.strip().upper(),
            m.talker,
            m.connection_id,
            list(m.connection_ids),
            float(m.rate_hz),
            m.enabled,
        )
        for i, m in enumerate(messages)
    ]
    return spark.createDataFrame(rows, MESSAGE_SCHEMA)


def _rule_row(r: BitRule):
    from decimal import Decimal

    meanings = {Decimal(k): v for k, v in r.meanings.items()}
    return (r.label, list(r.positions), meanings, r.unknown, r.enabled, r.reserved)


def fields_frame(spark: SparkSession, messages: list[Message]) -> DataFrame:
    from decimal import Decimal

    rows = []
    for m in messages:
        for i, f in enumerate(m.fields):
            profiles = []
            if f.profiles:
                for p in f.profiles.profiles:
                    profiles.append(
                        (
                            p.name,
                            Decimal(p.value),
                            [_rule_row(r) for r in p.rules],
                            [(list(e.positions), e.label, e.invalid) for e in p.exclusions],
                        )
                    )
            rows.append(
                (
                    m.name,
                    i,
                    f.name,
                    f.off0,
                    f.size,
                    f.type,
                    float(f.resolution),
                    f.nmea_index,
                    f.nmea_kind,
                    f.little,
                    [_rule_row(r) for r in f.bit_rules],
                    f.profiles.controller if f.profiles else None,
                    f.profiles.unknown if f.profiles else None,
                    profiles,
                )
            )
    return spark.createDataFrame(rows, FIELD_SCHEMA)


def connections_frame(spark: SparkSession, connections: list[Connection]) -> DataFrame:
    rows = [(i, c.id, c.name, c.transport, c.adapter, c.port, c.host) for i, c in enumerate(connections)]
    return spark.createDataFrame(rows, CONNECTION_SCHEMA)


def clean_label(text: str) -> str:
    """Column label: blanks and odd characters to ``_``, one ``_`` cut per end."""
    text = re.sub(r"\s+", "_", text.strip())
    text = re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_]", "_", text))
    text = text[1:] if text.startswith("_") else text
    text = text[:-1] if text.endswith("_") else text
    return text or "BITFIELD"


def value_headers(message: Message) -> list[str]:
    """Names of the decoded columns, in output order."""
    names = []
    for f in message.fields:
        names.append(f.name)
        names += [f"{f.name}_{clean_label(r.label)}" for r in f.bit_rules]
        if f.profiles:
            names.append(f"{f.name}_Profile")
            for p in f.profiles.profiles:
                stem = f"{f.name}_{clean_label(p.name)}"
                names += [f"{stem}_{clean_label(r.label)}" for r in p.rules]
                names += [f"{stem}_Validation_{clean_label(e.label)}" for e in p.exclusions]
    return names


def check_headers(message: Message) -> list[str]:
    """Names of the verification columns; sentence messages have none."""
    c = message.checks
    if c is None or message.format == "NMEA":
        return []
    names = []
    if c.header:
        names += ["HeaderObserved"] + (["HeaderExpected", "HeaderOK"] if c.expected_header else [])
    if c.terminator:
        names += ["TerminatorObserved"] + (["TerminatorExpected", "TerminatorOK"] if c.expected_terminator else [])
    if c.checksum:
        names += ["ChecksumComputed", "ChecksumStoredInPayload", "ChecksumOK"]
    if c.refresh_rate:
        names += ["RefreshRateObservedHz"]
        if c.refresh_rate[0] > 0:
            names += ["RefreshRateExpectedHz", "RefreshRateOK"]
    if c.endianness is not None:
        for f in message.fields:
            if f.type in MULTI_BYTE:
                names += [f"{f.name}_BE", f"{f.name}_LE"] + ([f"{f.name}_EndianOK"] if c.endianness else [])
        if c.endianness:
            names.append("EndianConfigured")
    if c.data_length:
        names += ["DataLenStored", "DataLenComputed", "DataLenOK"]
    if c.message_id:
        names += ["MsgIdObserved", "MsgIdExpected", "MsgIdOK"]
    if c.compares:
        names.append("CompareReason")
    return names
