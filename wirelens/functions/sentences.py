"""NMEA-0183 sentences inside a payload, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelens.functions.bytes import int_hex, xor_bytes

# Value kinds by their stored number.
KINDS = ("Text", "Numeric", "Latitude", "Longitude", "Time", "Date", "Status", "Char")


def latin1(payload: Column) -> Column:
    """One character per byte, so positions and checksums stay exact."""
    return F.decode(payload, "ISO-8859-1")


def formatters(payload: Column) -> Column:
    """Distinct upper-case formatters named after any ``$`` in the payload."""
    found = F.regexp_extract_all(latin1(payload), F.lit("(?s)[$](?=..(...))"), F.lit(1))
    return F.array_distinct(F.transform(found, F.upper))


def split_sentences(payload: Column) -> Column:
    """Each ``$...`` up to CR, LF, ``$``, ``!`` or the end."""
    found = F.regexp_extract_all(latin1(payload), F.lit("([$][^$!\r\n]*)"), F.lit(1))
    return F.filter(found, lambda s: F.length(s) >= 2)


def sentence_body(sentence: Column) -> Column:
    """Text between ``$`` and the first ``*`` (or the end)."""
    return F.substr(F.substring_index(sentence, "*", 1), F.lit(2))


def has_checksum(sentence: Column) -> Column:
    return F.instr(sentence, "*") > 0


def stated_checksum(sentence: Column) -> Column:
    """The one or two hex digits after ``*`` as a number; NULL when unreadable."""
    digits = F.trim(F.substr(sentence, F.instr(sentence, "*") + 1, F.lit(2)))
    return F.when(has_checksum(sentence) & digits.rlike("^[0-9A-Fa-f]{1,2}$"), F.conv(digits, 16, 10).cast("bigint"))


def body_checksum(body: Column) -> Column:
    """XOR of the characters of the body."""
    raw = F.encode(body, "ISO-8859-1")
    return xor_bytes(raw, F.lit(0), F.octet_length(raw))


def checksum_ok(sentence: Column) -> Column:
    return F.coalesce(stated_checksum(sentence) == body_checksum(sentence_body(sentence)), F.lit(False))


def _degrees(token: Column) -> Column:
    whole = F.length(F.substring_index(token, ".", 1))
    cut = F.greatest(whole - 2, F.lit(0))
    return F.when(
        whole >= 3, F.concat(F.substr(token, F.lit(1), cut), F.lit(" "), F.substr(token, cut + 1))
    ).otherwise(token)


def _time(token: Column) -> Column:
    return F.when(
        F.length(token) >= 6,
        F.concat_ws(":", F.substring(token, 1, 2), F.substring(token, 3, 2), F.substr(token, F.lit(5))),
    ).otherwise(token)


def _date(token: Column) -> Column:
    return F.when(
        F.length(token) >= 6,
        F.concat_ws("/", F.substring(token, 1, 2), F.substring(token, 3, 2), F.substring(token, 5, 2)),
    ).otherwise(token)


def format_token(token: Column, kind: Column | str) -> Column:
    """Display form of a token; ``kind`` is a name from ``KINDS`` or a column of them."""
    if isinstance(kind, str):
        if kind in ("Latitude", "Longitude"):
            return _degrees(token)
        return {"Time": _time, "Date": _date}.get(kind, lambda t: t)(token)
    return (
        F.when(kind.isin("Latitude", "Longitude"), _degrees(token))
        .when(kind == "Time", _time(token))
        .when(kind == "Date", _date(token))
        .otherwise(token)
    )


def sentence_text(body: Column) -> Column:
    """``$body*hh`` with CR LF."""
    return F.concat(F.lit("$"), body, F.lit("*"), int_hex(body_checksum(body), 1), F.lit("\r\n"))
