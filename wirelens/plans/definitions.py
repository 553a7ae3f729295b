"""Message definitions from catalogue tables.

A catalogue's messages and fields are DataFrames, however many files they come
from; decoding wants the definitions of one job as objects, because they become
columns of its plan. That is a bounded unit, and the bound is checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from wirelens.plans.model import BitRule, Checks, Exclusion, Field, Message, Profile, Profiles

MAX_MESSAGES = 5_000
MAX_FIELDS = 100_000

# Numbers of the sentence value kinds in catalogue files, from 0.
SENTENCE_KINDS = ("Text", "Numeric", "Latitude", "Longitude", "Time", "Date", "Status", "Char")


def _rules(rows: list[Row] | None) -> tuple[BitRule, ...]:
    return tuple(
        BitRule(r.label, tuple(r.positions), {int(k): v for k, v in (r.meanings or {}).items()}, r.unknown, r.enabled, r.reserved)
        for r in rows or ()
    )


def _profiles(row: Row) -> Profiles | None:
    if not row.profiles:
        return None
    made = tuple(
        Profile(p.name, int(p.value), _rules(p.rules), tuple(Exclusion(tuple(e.positions), e.label, e.invalid) for e in p.exclusions))
        for p in row.profiles
    )
    return Profiles(row.controller, made, row.controller_unknown)


def _checks(c: Row) -> Checks:
    return Checks(
        header=(c.headerByteOffset, c.headerLength or len(c.expectedHeader or b"")) if c.checkHeader else None,
        expected_header=bytes(c.expectedHeader or b""),
        terminator=(c.terminatorByteOffset, c.terminatorLength or len(c.expectedTerminator or b"")) if c.checkTerminator else None,
        expected_terminator=bytes(c.expectedTerminator or b""),
        checksum=(c.checksumAlgorithm, c.checksumRangeStart, c.checksumRangeEnd, c.checksumByteOffset, c.checksumLength) if c.checkChecksum else None,
        refresh_rate=(c.expectedRefreshRateHz, c.refreshRateToleranceHz) if c.checkRefreshRate else None,
        endianness=c.expectedEndianness if c.checkEndianness else None,
        data_length=(c.dataLengthByteOffset, c.dataLengthSize, c.dataLengthAdjust) if c.checkDataLength else None,
        message_id=(c.messageIdByteOffset, c.messageIdSize, int(c.expectedMessageId)) if c.checkMessageId else None,
    )


def _field(row: Row) -> Field:
    kind = row.nmea_kind
    return Field(
        row.name, row.off0 + 1, row.len, row.type, row.resolution, _rules(row.bit_rules), _profiles(row), row.nmea_index,
        SENTENCE_KINDS[kind] if isinstance(kind, int) and 0 <= kind < len(SENTENCE_KINDS) else "Text", row.little, row.expression,
    )


def _bounded(df: DataFrame, most: int, what: str) -> list[Row]:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}: choose the definitions of one job first")
    return rows


def messages_from_catalog(messages: DataFrame, fields: DataFrame, max_messages: int = MAX_MESSAGES, max_fields: int = MAX_FIELDS) -> list[Message]:
    """The tables of ``read_catalog`` as definitions, in file and definition order."""
    own: dict[tuple, list[Row]] = {}
    for row in _bounded(fields, max_fields, "fields"):
        own.setdefault((row.file, row.def_order), []).append(row)
    out = []
    for m in sorted(_bounded(messages, max_messages, "messages"), key=lambda r: (r.file, r.def_order)):
        rows = sorted(own.get((m.file, m.def_order), ()), key=lambda r: r.ord)
        checks = _checks(m.checks) if m.has_checks and m.checks is not None else None
        out.append(
            Message(
                m.message, m.port, m.payload_len, tuple(map(_field, rows)), bytes(m.header or b""), m.format, m.sentence, m.talker,
                m.connection_id, tuple(m.connection_ids), m.rate_hz, m.enabled, checks,
            )
        )
    return out


def messages_from_icd(messages: DataFrame, fields: DataFrame, keys: tuple[str, ...] = ("doc", "message"), port: int = 0) -> list[Message]:
    """Mined tables as definitions: messages (keys, payload_len) and their fields (keys, name, off0, len, type) in offset order.

    Fields keep their ``resolution`` and ``expression`` where the table has them.
    """
    grouped: dict[tuple, list[Row]] = {}
    wanted = fields.filter(F.col("type").isNotNull() & F.col("off0").isNotNull() & F.col("len").isNotNull())
    scaled = [F.coalesce(F.col(c), F.lit(d)).alias(c) if c in fields.columns else F.lit(d).alias(c) for c, d in (("resolution", 1.0), ("expression", "1"))]
    for row in _bounded(wanted.select(*keys, "name", "off0", "len", "type", *scaled), MAX_FIELDS, "fields"):
        grouped.setdefault(tuple(row[k] for k in keys), []).append(row)
    out = []
    for m in sorted(_bounded(messages.select(*keys, "payload_len"), MAX_MESSAGES, "messages"), key=lambda r: tuple(map(str, r))):
        rows = sorted(grouped.get(tuple(m[k] for k in keys), ()), key=lambda r: (r.off0, r.name))
        found = tuple(Field(r.name, r.off0 + 1, r.len, r.type, r.resolution, expression=r.expression) for r in rows)
        length = m.payload_len or max([r.off0 + r.len for r in rows], default=0)
        out.append(Message(str(m[keys[-1]]), port, length, found))
    return out
