"""Reading and writing numbers in binary payloads with built-in expressions.

Offsets are 0-based byte positions, lengths are in bytes; both may be Python
ints or columns. Every reader yields NULL when the slice does not lie wholly
inside the payload, which also keeps the casts safe under ANSI mode.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.functions.kernels import folded

U64 = T.DecimalType(20, 0)
WIDE = T.DecimalType(38, 0)
ONE_TOLERANCE = 1e-12


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _static(*xs) -> bool:
    return all(isinstance(x, int) for x in xs)


def fits(payload: Column, off0, length) -> Column:
    """True when ``length`` bytes from ``off0`` lie inside the payload."""
    if _static(off0, length):
        if off0 < 0 or length <= 0:
            return F.lit(False)
        return F.octet_length(payload) >= off0 + length
    off0, length = _c(off0), _c(length)
    return (off0 >= 0) & (length > 0) & (F.octet_length(payload) >= off0 + length)


def cut(payload: Column, off0, length) -> Column:
    """Bytes of the slice, clipped at the payload end."""
    if _static(off0, length):
        return F.substring(payload, off0 + 1, length)
    return F.substring(payload, _c(off0) + 1, _c(length))


def cut_hex(payload: Column, off0, length) -> Column:
    return F.hex(cut(payload, off0, length))


def slice_hex(payload: Column, off0, length) -> Column:
    """Hex of a slice that lies wholly inside the payload, else NULL."""
    return F.when(fits(payload, off0, length), cut_hex(payload, off0, length))


def swap_hex(hex_text: Column, length: int) -> Column:
    """Reverse the byte order of a hex text of ``length`` bytes."""
    return F.concat(*[F.substring(hex_text, 2 * i + 1, 2) for i in reversed(range(length))])


# -------------------------------------------- hex of a slice to a typed value
# These take the (nullable) hex text of ``length`` bytes. NULL passes through,
# so a reader that binds its slices first needs no further guards.


def raw_of(h: Column) -> Column:
    """Up to 8 bytes as a two's-complement bigint (8 bytes keep all bits)."""
    return F.conv(h, 16, -10).cast("bigint")


def unsigned_of(h: Column, length: int) -> Column:
    """bigint to 7 bytes, decimal(20,0) at 8, decimal(38,0) to 15."""
    if length <= 7:
        return F.conv(h, 16, 10).cast("bigint")
    if length == 8:
        return F.conv(h, 16, 10).cast(U64)
    head = F.conv(F.substring(h, 1, 2 * (length - 7)), 16, 10).cast(U64)
    tail = F.conv(F.substring(h, 2 * (length - 7) + 1, 14), 16, 10).cast(T.DecimalType(17, 0))
    return (head * F.lit(1 << 56).cast(T.DecimalType(17, 0)) + tail).cast(WIDE)


def signed_of(h: Column, length: int) -> Column:
    """Two's complement over ``8 * length`` bits."""
    if length == 8:
        return raw_of(h)
    if length < 8:
        shift = 64 - 8 * length
        return F.shiftright(F.shiftleft(raw_of(h), shift), shift)
    raw = unsigned_of(h, length)
    half, full = 1 << (8 * length - 1), 1 << (8 * length)
    return F.when(raw >= F.lit(str(half)).cast(WIDE), raw - F.lit(str(full)).cast(WIDE)).otherwise(raw).cast(WIDE)


def float32_from_bits(bits: Column) -> Column:
    """IEEE-754 single given as a non-negative bigint of 32 bits."""
    sign = F.lit(1.0) - F.shiftright(bits, 31).bitwiseAND(F.lit(1)) * F.lit(2.0)
    exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255))
    mantissa = bits.bitwiseAND(F.lit(0x7FFFFF))
    return (
        F.when((exponent == 255) & (mantissa != 0), F.lit(float("nan")))
        .when(exponent == 255, sign * F.lit(float("inf")))
        .when(exponent == 0, sign * mantissa.cast("double") * F.lit(2.0**-149))
        .otherwise(sign * (mantissa + 0x800000).cast("double") * F.pow(F.lit(2.0), (exponent - 150).cast("double")))
    )


def float64_from_bits(bits: Column) -> Column:
    """IEEE-754 double given as the bit pattern of a bigint."""
    sign = F.lit(1.0) - F.shiftrightunsigned(bits, 63) * F.lit(2.0)
    exponent = F.shiftright(bits, 52).bitwiseAND(F.lit(2047))
    mantissa = bits.bitwiseAND(F.lit((1 << 52) - 1))
    return (
        F.when((exponent == 2047) & (mantissa != 0), F.lit(float("nan")))
        .when(exponent == 2047, sign * F.lit(float("inf")))
        .when(exponent == 0, sign * mantissa.cast("double") * F.lit(5e-324))
        .otherwise(
            sign * (mantissa + (1 << 52)).cast("double") * F.pow(F.lit(2.0), (exponent - 1075).cast("double"))
        )
    )


def float_of(h: Column, length: int) -> Column:
    return float32_from_bits(raw_of(h)) if length == 4 else float64_from_bits(raw_of(h))


def string_of(h: Column) -> Column:
    """UTF-8 text without trailing NULs; undecodable bytes become U+FFFD."""
    return F.make_valid_utf8(F.unhex(F.regexp_replace(h, "(00)+$", "")).cast("string"))


@F.pandas_udf(T.StringType())
def wide_integer_text(raw: pd.Series, signed: pd.Series) -> pd.Series:
    """Exact decimal text of big-endian integers too wide for decimal(38,0)."""
    return pd.Series(
        [None if b is None else str(int.from_bytes(b, "big", signed=bool(s))) for b, s in zip(raw, signed)],
        dtype=object,
    )


def wide_of(h: Column, length: int, signed: bool = False) -> Column:
    """More than 8 bytes: decimal(38,0) to 15 bytes, exact decimal text beyond."""
    if length <= 15:
        return signed_of(h, length) if signed else unsigned_of(h, length)
    return wide_integer_text(F.unhex(h), F.lit(signed))


# ------------------------------------------------------- readers on a payload


def be_unsigned(payload: Column, off0: int, length: int) -> Column:
    return unsigned_of(slice_hex(payload, off0, length), length)


def be_raw(payload: Column, off0: int, length: int) -> Column:
    """1..8 bytes as the bit pattern of a bigint."""
    return raw_of(slice_hex(payload, off0, length))


def be_signed(payload: Column, off0: int, length: int) -> Column:
    return signed_of(slice_hex(payload, off0, length), length)


def be_float32(payload: Column, off0: int, length: int = 4) -> Column:
    """NULL unless the field is 4 bytes long."""
    return float_of(slice_hex(payload, off0, 4), 4) if length == 4 else F.lit(None).cast("double")


def be_float64(payload: Column, off0: int, length: int = 8) -> Column:
    """NULL unless the field is 8 bytes long."""
    return float_of(slice_hex(payload, off0, 8), 8) if length == 8 else F.lit(None).cast("double")


def be_bool(payload: Column, off0: int, length: int) -> Column:
    return be_raw(payload, off0, length) != 0


def le_integer(payload: Column, off0: int, length: int, signed: bool = False) -> Column:
    """Little-endian integer of 1..8 bytes."""
    text = swap_hex(slice_hex(payload, off0, length), length)
    return signed_of(text, length) if signed else unsigned_of(text, length)


def le_float(payload: Column, off0: int, length: int) -> Column:
    return float_of(swap_hex(slice_hex(payload, off0, length), length), length)


def fixed_string(payload: Column, off0, length) -> Column:
    return string_of(slice_hex(payload, off0, length))


def wide_integer(payload: Column, off0: int, length: int, signed: bool = False) -> Column:
    return wide_of(slice_hex(payload, off0, length), length, signed)


def has_scale(resolution: float) -> bool:
    """A resolution equal to 1 (relative tolerance 1e-12) is not applied."""
    return not abs(resolution - 1.0) <= ONE_TOLERANCE * min(abs(resolution), 1.0)


def scale(value: Column, resolution: float) -> Column:
    return value.cast("double") * F.lit(float(resolution)) if has_scale(resolution) else value


def _whole_text(number: Column) -> Column:
    """All digits of a double from 2^53 up to 2^126, which is a whole number, from its parts of 53 bits."""
    unit = F.lit(2.0**53)
    safe = F.when((F.abs(number) >= 2.0**53) & (F.abs(number) < 2.0**126), F.abs(number))

    def whole(x: Column) -> Column:
        return x.cast("bigint").cast("decimal(38,0)")

    def down(x: Column) -> Column:
        return x - x % F.lit(1.0)

    high = down(safe / unit)
    top = down(high / unit)
    digits = (whole(top) * F.lit(2**53).cast("decimal(17,0)")).cast("decimal(38,0)") + whole(high - top * unit)
    digits = (digits.cast("decimal(38,0)") * F.lit(2**53).cast("decimal(17,0)")).cast("decimal(38,0)") + whole(safe - high * unit)
    return F.concat(F.when(number < 0, F.lit("-")).otherwise(F.lit("")), digits.cast("decimal(38,0)").cast("string"))


def fixed6(value: Column) -> Column:
    """Six decimals with trailing zeros and a bare point cut, as display text."""
    number = value.cast("double")
    text = F.replace(F.format_number(number, 6), F.lit(","), F.lit(""))
    text = F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    text = F.when((F.abs(number) >= 2.0**53) & (F.abs(number) < 2.0**126), _whole_text(number)).otherwise(text)
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(value), F.lit("nan"))
        .when(value == float("inf"), F.lit("inf"))
        .when(value == float("-inf"), F.lit("-inf"))
        .otherwise(text)
    )


# ---------------------------------------------------------------- writing


def int_hex(value: Column, length: int, little: bool = False) -> Column:
    """Low ``length`` bytes (1..8) of a bigint as upper-case hex."""
    text = F.substring(F.lpad(F.hex(value.cast("bigint")), 16, "0"), 17 - 2 * length, 2 * length)
    return swap_hex(text, length) if little and length > 1 else text


def u64_hex(value: Column, length: int, little: bool = False) -> Column:
    """Low ``length`` bytes of a non-negative decimal(20,0) as hex."""
    text = F.substring(F.lpad(F.conv(value.cast("string"), 10, 16), 16, "0"), 17 - 2 * length, 2 * length)
    return swap_hex(text, length) if little and length > 1 else text


def text_hex(value: Column, length: int) -> Column:
    """UTF-8 bytes of a text, NUL padded to ``length``."""
    return F.rpad(F.hex(F.encode(value, "UTF-8")), 2 * length, "0")


def _hex_float(text: Column) -> tuple[Column, Column, Column]:
    """Leading bit, 52-bit fraction and exponent of a hexadecimal double such as 0x1.8p3.

    The hexadecimal form of a double spells out its bits exactly.
    """
    head = F.substring_index(text, "p", 1)
    lead = F.substring(head, 3, 1).try_cast("bigint")
    fraction = F.conv(F.rpad(F.substring_index(head, ".", -1), 13, "0"), 16, 10).try_cast("bigint")
    return lead, fraction, F.substring_index(text, "p", -1).try_cast("bigint")


def _negative(value: Column) -> Column:
    """1 for negative numbers, minus zero included."""
    return F.startswith(value.cast("string"), F.lit("-")).cast("bigint")


def float64_bits(value: Column) -> Column:
    """Bit pattern of a double as bigint."""
    v = value.cast("double")
    # Tests on the text make it part of every row's work, so it is formatted only once.
    text = F.format_string("%a", F.abs(v))
    lead, fraction, exponent = _hex_float(text)
    sign = F.shiftleft(_negative(v), 63)
    # A leading zero marks zero and the smallest numbers, whose stored exponent is 0.
    finite = F.shiftleft((exponent + 1023) * lead, 52) + fraction
    return (
        F.when(text == "NaN", F.lit(0x7FF8 << 48))
        .when(text == "Infinity", F.lit(2047 << 52).bitwiseOR(sign))
        .otherwise(finite.bitwiseOR(sign))
    )


def float32_bits(value: Column) -> Column:
    """Bit pattern of a double rounded to single precision, as bigint."""
    v = value.cast("float").cast("double")
    text = F.format_string("%a", F.abs(v))
    _, fraction, exponent = _hex_float(text)
    sign = F.shiftleft(_negative(v), 31)
    return (
        F.when(text == "NaN", F.lit(0x7FC00000))
        .when(text == "Infinity", F.lit(0x7F800000) + sign)
        .when(F.abs(v) < F.lit(2.0**-126), (F.abs(v) * F.lit(2.0**149)).cast("bigint") + sign)
        .otherwise(F.shiftleft(exponent + 127, 23) + F.shiftright(fraction, 29) + sign)
    )


# ---------------------------------------------------------------- folds


def _words(payload: Column, start, stop) -> Column:
    """Positions (1-based) of 8-byte words covering [start, stop)."""
    return F.sequence(_c(start) + 1, _c(stop), F.lit(8))


def _fold_to_byte(word: Column) -> Column:
    for shift in (32, 16, 8):
        word = word.bitwiseXOR(F.shiftrightunsigned(word, shift))
    return word.bitwiseAND(F.lit(255))


#: Fixed ranges up to this length are generated code; others are folded a batch at a time.
UNROLLED = 512


def xor_bytes(payload: Column, start, stop) -> Column:
    """XOR of the bytes in [start, stop); the caller guards the range."""
    if not (_static(start, stop) and stop - start <= UNROLLED):
        return folded("xor", payload, _c(start), _c(stop))
    acc = None
    for p in range(start, stop, 8):
        w = raw_of(cut_hex(payload, p, min(8, stop - p)))
        acc = w if acc is None else acc.bitwiseXOR(w)
    return _fold_to_byte(acc if acc is not None else F.lit(0).cast("bigint"))


def sum_bytes(payload: Column, start, stop) -> Column:
    """Sum of the bytes in [start, stop); the caller guards the range."""
    if not (_static(start, stop) and stop - start <= UNROLLED):
        return folded("sum", payload, _c(start), _c(stop))
    lanes, acc = F.lit(0x00FF00FF00FF00FF), None
    for p in range(start, stop, 8):
        # Four 16-bit lanes of two bytes each: 64 words of two bytes of 255 fit.
        w = raw_of(cut_hex(payload, p, min(8, stop - p)))
        pair = w.bitwiseAND(lanes) + F.shiftrightunsigned(w, 8).bitwiseAND(lanes)
        acc = pair if acc is None else acc + pair
    if acc is None:
        return F.lit(0).cast("bigint")
    mask = F.lit(0xFFFF)
    return sum((F.shiftrightunsigned(acc, k).bitwiseAND(mask) for k in (16, 32, 48)), acc.bitwiseAND(mask))


def sum_words16(payload: Column) -> Column:
    """Sum of big-endian 16-bit words, an odd last byte padded with zero."""
    mask = F.lit(0xFFFF)

    def word(i):
        return raw_of(F.rpad(F.hex(F.substring(payload, i, F.lit(8))), 16, "0"))

    def add(total, w):
        return (
            total
            + w.bitwiseAND(mask)
            + F.shiftrightunsigned(w, 16).bitwiseAND(mask)
            + F.shiftrightunsigned(w, 32).bitwiseAND(mask)
            + F.shiftrightunsigned(w, 48)
        )

    size = F.octet_length(payload)
    words = F.transform(_words(payload, F.lit(0), size), word)
    return F.when(size > 0, F.aggregate(words, F.lit(0).cast("bigint"), add)).otherwise(F.lit(0).cast("bigint"))


def ones_complement(total: Column) -> Column:
    """Fold a sum of 16-bit words and complement it."""
    for _ in range(3):
        total = total.bitwiseAND(F.lit(0xFFFF)) + F.shiftrightunsigned(total, 16)
    return F.lit(0xFFFF) - total
