import pytest
from pyspark.sql import functions as F

from wirelens.functions import text as tx
from wirelens.operators import nmea, quality
from wirelens.plans.model import Field, Message
from wirelens.sources.nmea_registry import formatters, nmea_registry


def xor(body):
    out = 0
    for c in body:
        out ^= ord(c)
    return out


def test_registry_shape(spark):
    reg = nmea_registry(spark)
    counts = {r.kind: r["count"] for r in reg.groupBy("kind").count().collect()}
    assert len(formatters()) == 87 and counts == {
        "Numeric": 355, "Char": 163, "Text": 113, "Status": 40, "Time": 25, "Latitude": 16, "Longitude": 16, "Date": 1}
    gga = {r.idx: (r.name, r.kind) for r in reg.filter("formatter = 'GGA'").collect()}
    assert gga[1] == ("UTC", "Time") and gga[2] == ("Latitude", "Latitude") and gga[3] == ("NS", "Char") and len(gga) == 14
    own = spark.createDataFrame([("gga", 1, "when", "Text"), ("ABC", 1, "x", "Date")], "formatter string, idx int, name string, kind string")
    both = nmea_registry(spark, own)
    assert both.filter("formatter = 'GGA'").count() == 1 and both.filter("formatter = 'ABC'").count() == 1


def test_sentences_of_one_payload(spark):
    body = "GPGGA,123519,4807.038,N,01131.000,E,1,08,0.9"
    text = f"noise ${body}*{xor(body):02x}\r\n$GPGGA,1234,807,N*00$GPGGA,0945!x\n$GP,1\r$HEzda,1*zz$"
    df = spark.createDataFrame([(1, bytearray(text.encode("latin-1")))], "packet_no long, payload binary")
    m = Message("m", fields=(Field("t", nmea_index=1), Field("lat", nmea_index=2), Field("lon", nmea_index=4), Field("far", nmea_index=40)), format="NMEA", sentence="gga")
    rows = nmea.nmea_rows(df, m).orderBy("pos").collect()
    assert [(r.pos, r.talker, r.checksum_ok, r.t, r.lat, r.lon, r.far) for r in rows] == [
        (0, "GP", True, "12:35:19", "48 07.038", "011 31.000", ""),
        (1, "GP", False, "1234", "8 07", "", ""),
        (2, "GP", False, "0945", "", "", ""),
    ]
    warned = nmea.nmea_warnings(df, ["packet_no"], "GGA").orderBy("pos", "warning").collect()
    assert [(r.pos, r.warning) for r in warned] == [
        (1, "checksum_mismatch"), (2, "missing_checksum"), (3, "bad_address"), (3, "missing_checksum"),
        (4, "checksum_mismatch"), (4, "skipped_formatter"),
    ]
    custom = Message("c", fields=(Field("d", nmea_index=1, nmea_kind="Date"),), format="NMEA", sentence="XYZ")
    other = spark.createDataFrame([(1, bytearray(b"$AAXYZ,010203*11"))], "packet_no long, payload binary")
    assert nmea.nmea_rows(other, custom).first().d == "01/02/03"


def test_building_sentences(spark):
    df = spark.createDataFrame([("123519", "4807.038"), ("a,b", "é")], "t string, lat string").coalesce(1)
    good, bad = nmea.build_sentences(df, "gga", {1: F.col("t"), 2: F.col("lat")}, "").collect()
    body = "GPGGA,123519,4807.038" + "," * 12
    assert bytes(good.payload).decode() == f"${body}*{xor(body):02X}\r\n" and good.problems is None
    assert bad.payload is None and bad.problems == "token 1 contains a delimiter; token 2 is not printable ASCII"
    assert "formatter" in nmea.build_sentences(df, "GG", {1: F.lit("x")}).first().problems
    assert "talker" in nmea.build_sentences(df, "XYZ", {1: F.lit("x")}, "G").first().problems
    assert bytes(nmea.build_sentences(df, "XYZ", {3: F.lit("x")}).first().payload).startswith(b"$GPXYZ,,,x*")


@pytest.mark.parametrize(
    "text,value,error",
    [
        ("0.01", 0.01, None), ("1/3", 1 / 3, None), ("2^3^2", 512.0, None), ("-2^2", -4.0, None), ("2^-1", 0.5, None),
        ("(1+2)*3e-1", 0.9, None), (" pi/180 ", 3.141592653589793 / 180, None), (".5+1.", 1.5, None), ("--2", 2.0, None),
        ("", None, "empty"), ("1/0", None, "division_by_zero"), ("0^-1", None, "undefined_power"), ("abc/", None, "unknown_name: abc"),
        ("(1", None, "unclosed_bracket"), ("1 2", None, "malformed"), ("2**3", None, "malformed"),
        ("2 $", None, "bad_character: $"), ("1e400", None, "number_too_large"), ("10^300*10^300", None, "not_finite"),
    ],
)
def test_expressions(text, value, error):
    got, fault = tx.evaluate_expression(text)
    assert fault == error and (value is None or abs(got - value) < 1e-12)


def test_solving_distinct_expressions(spark):
    df = spark.createDataFrame([(1, "360/65536"), (2, "0-1"), (3, "360/65536"), (4, None)], "id int, expression string")
    got = {r.id: (r.solved, r.solve_error) for r in quality.solve_resolutions(df).collect()}
    assert got[1] == got[3] == (360 / 65536, None) and got[2] == (None, "not_positive")


def test_cells_and_names(spark):
    cells = ["12", " -1.5e3\t", "1234567890123456", "123456789012345.", "0x10", "N/A", "True", "", ".5", "1e400", "+7"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "id int, c string").orderBy("id")
    got = [(r[0].number, r[0].text) for r in df.select(tx.typed_cell(F.col("c"))).collect()]
    assert got == [
        (12.0, None), (-1500.0, None), (None, "1234567890123456"), (123456789012345.0, None), (None, "0x10"), (None, "N/A"),
        (None, "True"), (None, ""), (0.5, None), (None, "1e400"), (7.0, None),
    ]
    names = spark.createDataFrame([(" a/b  c__",), ("???",), ("__x__y_",)], "n string").coalesce(1)
    out = [tuple(r) for r in names.select(tx.safe_name(F.col("n")), tx.column_label(F.col("n"))).collect()]
    assert out == [("a_b_c", "a_b_c"), ("export", "BITFIELD"), ("x_y", "x_y")]
    kinds = spark.createDataFrame([("Signed Integer", 2), ("my unsigned word", 3), ("weird int", 3), ("float value", 8), ("??", 1)], "l string, s int").coalesce(1)
    assert [r[0] for r in kinds.select(tx.type_from_label(F.col("l"), F.col("s"))).collect()] == ["Int32", "Uint16", "Uint32", "Float64", None]
