import functools
import math
import operator
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wirelens.functions import bytes as by
from wirelens.functions import kernels
from wirelens.operators.decode import decode_fields, decode_long
from wirelens.operators.encode import build_payloads
from wirelens.plans.model import Field, Message

RNG = random.Random(7)


def payloads(spark, items, name="payload"):
    return spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(items)], f"id int, {name} binary")


def column(df, expr):
    return [r[0] for r in df.orderBy("id").select(expr).collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 12, 15, 16, 20])
def test_integers_of_any_width(spark, n):
    items = [bytes(n), b"\xff" * n, b"\x80" + bytes(n - 1), b"\x7f" + b"\xff" * (n - 1)]
    items += [RNG.randbytes(n) for _ in range(20)]
    df = payloads(spark, [b"\x01" + i + b"\x02" for i in items])
    p = F.col("payload")
    if n <= 8:
        unsigned, signed = by.be_unsigned(p, 1, n), by.be_signed(p, 1, n)
        little = by.le_integer(p, 1, n), by.le_integer(p, 1, n, True)
        assert [int(v) for v in column(df, little[0])] == [int.from_bytes(i, "little") for i in items]
        assert [int(v) for v in column(df, little[1])] == [int.from_bytes(i, "little", signed=True) for i in items]
    else:
        unsigned, signed = by.wide_integer(p, 1, n), by.wide_integer(p, 1, n, True)
    assert [int(v) for v in column(df, unsigned)] == [int.from_bytes(i, "big") for i in items]
    assert [int(v) for v in column(df, signed)] == [int.from_bytes(i, "big", signed=True) for i in items]
    assert column(df, by.be_unsigned(p, 3, n) if n <= 8 else by.wide_integer(p, 3, n)) == [None] * len(items)


SPECIAL = [0.0, -0.0, 1.0, -1.0, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 3.5, 0.1, 1e-40, 65504.0,
           float("inf"), float("-inf"), 1.1754943508222875e-38, 2.0**-149, 2.0**52 + 1, 3.4028234663852886e38]


def test_floats_both_ways(spark):
    values = SPECIAL + [struct.unpack(">d", RNG.randbytes(8))[0] for _ in range(200)]
    values = [v for v in values if not math.isnan(v)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    bits = column(df, by.float64_bits(F.col("v")))
    assert bits == [struct.unpack(">q", struct.pack(">d", v))[0] for v in values]
    back = column(payloads(spark, [struct.pack(">d", v) for v in values]), by.be_float64(F.col("payload"), 0))
    assert [struct.pack(">d", v) for v in back] == [struct.pack(">d", v) for v in values]
    singles = [v for v in values if abs(v) < 3.4e38 or math.isinf(v)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(singles)], "id int, v double")
    assert column(df, by.float32_bits(F.col("v"))) == [struct.unpack(">I", struct.pack(">f", v))[0] for v in singles]
    raw = [struct.pack(">f", v) for v in singles]
    back = column(payloads(spark, raw), by.be_float32(F.col("payload"), 0))
    assert [struct.pack(">d", v) for v in back] == [struct.pack(">d", struct.unpack(">f", r)[0]) for r in raw]
    swapped = column(payloads(spark, [r[::-1] for r in raw]), by.le_float(F.col("payload"), 0, 4))
    assert swapped == back
    assert math.isnan(column(payloads(spark, [bytes.fromhex("7FC00001")]), by.be_float32(F.col("payload"), 0))[0])


def test_strings_bools_and_bounds(spark):
    df = payloads(spark, [b"Hi\0\0\0\0", b"\0a\0b\0\0", "é€".encode() + b"\0", b"\xff\xfeok\0\0", b"", b"\x10\0\0\0\0\0"])
    p = F.col("payload")
    assert column(df, by.fixed_string(p, 0, 6)) == ["Hi", "\0a\0b", "é€", "��ok", None, "\x10"]
    assert column(df, by.be_bool(p, 0, 1)) == [True, False, True, True, None, True]
    assert column(df, by.be_unsigned(p, -1, 1)) == [None] * 6


def test_folds(spark):
    items = [RNG.randbytes(n) for n in (1, 7, 8, 9, 23, 64, 513, 4000)] + [b"\xff" * 70000]
    df = payloads(spark, items)
    p, n = F.col("payload"), F.octet_length("payload")
    xor = [0] * len(items)
    for k, item in enumerate(items):
        for b in item:
            xor[k] ^= b
    assert column(df, by.xor_bytes(p, F.lit(0), n)) == xor
    assert column(df, by.sum_bytes(p, F.lit(0), n)) == [sum(i) for i in items]
    assert column(df, by.sum_bytes(p, 1, 5))[1:] == [sum(i[1:5]) for i in items[1:]]
    words = [sum(int.from_bytes(i[j : j + 2].ljust(2, b"\0"), "big") for j in range(0, len(i), 2)) for i in items]
    assert column(df, by.sum_words16(p)) == words


def test_folds_of_any_range(spark):
    """Ranges from columns: empty, beyond the row, NULL; fixed ones on both sides of the unrolled length."""
    rows = [(i, None if i % 11 == 0 else bytearray(RNG.randbytes(RNG.randrange(0, 40))), RNG.choice([0, 1, 5, 60, None]), RNG.randrange(0, 70)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, payload binary, a int, b int").repartition(3)
    p, a, b = F.col("payload"), F.col("a"), F.col("b")
    want = [None if r is None or lo is None else (sum(r[lo:hi]), functools.reduce(operator.xor, r[lo:hi], 0)) for _, r, lo, hi in rows]
    got = df.orderBy("id").select(by.sum_bytes(p, a, b).alias("s"), by.xor_bytes(p, a, b).alias("x")).collect()
    assert [None if r.s is None else tuple(r) for r in got] == want
    assert df.limit(0).select(by.sum_bytes(p, a, b)).collect() == []
    for n in (512, 513):
        long = payloads(spark, [b"\xff" * 600, RNG.randbytes(700)])
        items = [bytes(r.payload) for r in long.orderBy("id").collect()]
        assert column(long, by.sum_bytes(p, 3, n + 3)) == [sum(i[3 : n + 3]) for i in items]
        assert column(long, by.xor_bytes(p, 3, n + 3)) == [functools.reduce(operator.xor, i[3 : n + 3]) for i in items]


def test_folds_of_slices():
    data = pa.array([b"ab", None, b"", b"xyz", b"\xff" * 9])
    part = data.slice(2, 3)
    zero, end = pa.array([0] * 3), pa.array([99] * 3)
    assert kernels.fold("sum", part, zero, end).to_pylist() == [0, sum(b"xyz"), 9 * 255]
    assert kernels.fold("xor", part, pa.array([0, 1, None]), end).to_pylist() == [0, ord("y") ^ ord("z"), None]
    assert kernels.fold("xor", pa.array([], pa.binary()), pa.array([], pa.int64()), pa.array([], pa.int64())).to_pylist() == []


def test_six_decimal_text(spark):
    values = [25.0, 0.0000005, 1 / 3, -1e-9, 1234567.0078125, 1e15, -0.1, 100.0, 0.5, 12.000001]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")

    def shown(v):
        return f"{v:.6f}".rstrip("0").rstrip(".")

    assert column(df, by.fixed6(F.col("v"))) == [shown(v) for v in values]


ALL_TYPES = Message(
    "all",
    5000,
    49,
    (
        Field("f_u8", 1, 1, "Uint8"),
        Field("f_i8", 2, 1, "Int8"),
        Field("f_u16", 3, 2, "Uint16"),
        Field("f_i16", 5, 2, "Int16"),
        Field("f_u32", 7, 4, "Uint32"),
        Field("f_i32", 11, 4, "Int32"),
        Field("f_u64", 15, 8, "Uint64"),
        Field("f_i64", 23, 8, "Int64"),
        Field("f_f32", 31, 4, "Float32"),
        Field("f_f64", 35, 8, "Float64"),
        Field("f_bool", 43, 1, "Bool"),
        Field("f_str", 44, 6, "String"),
    ),
)
TEXTS = {
    "f_u8": "200", "f_i8": "-100", "f_u16": "0xABCD", "f_i16": "-30000", "f_u32": "4000000000", "f_i32": "-2000000000",
    "f_u64": "18446744073709551615", "f_i64": "-5000000000", "f_f32": "3.5", "f_f64": "2.5", "f_bool": "True", "f_str": "Hé",
}


def test_every_type_from_text_and_back(spark):
    values = {k: F.lit(v) for k, v in TEXTS.items()}
    built = build_payloads(spark.range(1), ALL_TYPES, values, texts=True)
    row = decode_fields(built, ALL_TYPES, values_only=True).first().asDict()
    assert row["f_u16"] == 0xABCD and int(row["f_u64"]) == 2**64 - 1 and row["f_bool"] is True and row["f_str"] == "Hé"
    text = decode_fields(built, ALL_TYPES, values_only=True, text_parity=True).first().asDict()
    assert text == {**TEXTS, "f_u16": "43981", "f_bool": "true"}
    long = decode_long(built.withColumn("message", F.lit("all")).withColumn("packet_no", F.lit(1)), [ALL_TYPES])
    assert {r.field: r.text for r in long.collect()} == text


def test_text_problems_and_little_endian(spark):
    def fault(field, text):
        m = Message("m", 1, 8, (field,))
        row = build_payloads(spark.range(1), m, {field.name: F.lit(text)}, texts=True).first()
        return row.problems or bytes(row.payload).hex().upper()

    def u16(**k):
        return Field("v", 1, 2, "Uint16", **k)

    i8 = Field("v", 1, 1, "Int8")
    assert fault(u16(), "") == "v: no value"
    assert fault(u16(), "-1") == "v: negative value in an unsigned field"
    assert fault(u16(), "65536") == "v: value does not fit"
    assert fault(u16(), "12.5") == "v: not a number"
    assert fault(u16(), "0x1234") == "1234" + "00" * 6
    assert fault(u16(little=True), "0x1234") == "3412" + "00" * 6
    assert fault(u16(resolution=0.01), "25") == "09C4" + "00" * 6
    assert fault(u16(resolution=0.01), "655.354") == "FFFF" + "00" * 6
    assert fault(u16(resolution=0.01), "656") == "v: value does not fit"
    assert fault(i8, "0xFFF") == "FF" + "00" * 7
    assert fault(i8, "-129") == "v: value does not fit"
    assert fault(i8, "0xZZ") == "v: not a hex number"
    assert fault(Field("v", 1, 4, "Int32", 0.5), "-2.5") == "FFFFFFFB" + "00" * 4
    assert fault(Field("v", 1, 2, "Float32"), "1") == "v: Float32 needs a length of 4"
    assert fault(Field("v", 1, 4, "Float32"), "x") == "v: not a number"
    assert fault(Field("v", 1, 2, "String"), "abc") == "v: text is too long"
    assert fault(Field("v", 1, 1, "Bool"), "yes") == "v: not a bool value"
    assert fault(Field("v", 8, 2, "Uint16"), "1") == "v: ends past the payload"
    assert fault(Field("v", 1, 8, "Uint64"), "18446744073709551616") == "v: not a number"


def test_later_fields_overwrite_and_gaps_are_zero(spark):
    m = Message("m", 1, 6, (Field("a", 1, 4, "Uint32"), Field("b", 2, 2, "Uint16"), Field("c", 6, 1, "Uint8")))
    values = {"a": F.lit(0x11223344), "b": F.lit(0xAABB), "c": F.lit(9)}
    assert bytes(build_payloads(spark.range(1), m, values).first().payload).hex() == "11aabb440009"


def test_scaled_and_wide_examples(spark):
    df = payloads(spark, [bytes.fromhex("09C4")])
    m = Message("m", 1, 2, (Field("Pressure", 1, 2, "Uint16", 0.01), Field("Short", 1, 3, "Uint16")))
    row = decode_fields(df, m, values_only=True, text_parity=True).first()
    assert (row.Pressure, row.Short) == ("25", "N/A")
    wide = Message("w", 1, 34, (Field("BigId", 5, 12), Field("Blob", 17, 16), Field("Half", 17, 16, "Int8", 0.5)))
    raw = bytes(4) + b"\x01" * 12 + b"\xff" * 15 + b"\xfe" + b"\0\1"
    row = decode_fields(payloads(spark, [raw]), wide, values_only=True).first()
    assert int(row.BigId) == int.from_bytes(b"\x01" * 12, "big") and row.Blob == str(2**128 - 2) and row.Half == -1.0


def test_large_values_keep_all_digits(spark):
    from pyspark.sql import functions as F

    from wirelens.functions.bytes import fixed6

    values = [1e23, -1e23, 2.0**53, 2.0**53 + 2, 2.0**63, 1.8446744073709552e19 * 3, 2.0**125 * 1.1, 123456789012.25, 0.5, -3.0, 0.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(fixed6(F.col("v"))).collect()]
    assert got == [("%.6f" % v).rstrip("0").rstrip(".") for v in values]
