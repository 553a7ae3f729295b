import json
import tempfile

import pytest
from pyspark.sql import functions as F

from wirelens.operators import quality, schedule
from wirelens.plans.model import BitRule, Connection, Exclusion, Field, Message, Profile, Profiles, connections_frame, fields_frame, messages_frame
from wirelens.sources import catalog


def files(**contents):
    path = tempfile.mkdtemp(prefix="wirelens-", dir="/tmp")
    for name, text in contents.items():
        with open(f"{path}/{name}.json", "w") as f:
            f.write(text if isinstance(text, str) else json.dumps(text))
    return path


RULE = {"label": "r", "bitPositions": [0, 1], "valueMeanings": {"0": "a", "x": "no", "18446744073709551615": "top"}}
FULL = {
    "messageName": "M", "port": 5000, "payloadLengthBytes": 8, "optionalHeaderHex": "AA55", "offsetUnit": "words",
    "connectionId": "c1", "hasCompareOptions": True, "compareOptions": {"checkHeader": True, "expectedHeaderHex": "aa", "expectedMessageId": "9000000000000000000"},
    "fields": [
        {"name": "v", "byteOffset": 3, "length": 2, "dataType": "Uint16", "resolution": 0.01, "endianness": "Little",
         "hasBitfieldDecoder": True, "bitDecodeRules": [RULE],
         "hasConditionalBitfieldDecoder": True, "conditionalDecoder": {"controllerFieldName": "k", "profiles": [
             {"profileName": "p", "controllerValue": "18446744073709551615", "bitDecodeRules": [RULE]}]}},
        {"name": "w", "byteOffset": 1, "byteOffsetCorrect": 7, "dataType": "Nope", "hasBitfieldDecoder": True, "bitDecodeRules": []},
        {},
    ],
}


def test_message_files(spark):
    path = files(
        a={"messages": [FULL, {"messageName": "N", "dataFormat": "NMEA", "connectionIds": ["", "x", "y"], "connectionId": "z"}]},
        b={"messageName": "single"}, c=[{"fields": []}, {"messageName": "second"}], d="{broken", e={"other": 1}, f=[1], g="3",
    )
    messages, fields, errors = catalog.read_catalog(spark, path)
    rows = {(r.file[-6], r.def_order): r for r in messages.collect()}
    assert set(rows) == {("a", 0), ("a", 1), ("b", 0), ("c", 0), ("c", 1)}
    m = rows["a", 0]
    assert (m.message, m.port, m.payload_len, bytes(m.header), m.format, m.offset_unit) == ("M", 5000, 8, b"\xaa\x55", "HEX", "WORDS")
    assert (m.connection_ids, m.rate_hz, m.enabled, m.talker) == (["c1"], 1.0, True, "GP")
    assert m.checks.checkHeader and bytes(m.checks.expectedHeader) == b"\xaa" and int(m.checks.expectedMessageId) == 9 * 10**18
    assert (m.checks.terminatorByteOffset, m.checks.checksumLength, m.checks.expectedEndianness) == (-1, 1, "BIG")
    assert rows["a", 1].connection_ids == ["x", "y"]
    v, w, blank = fields.filter("message = 'M'").orderBy("ord").collect()
    assert (v.off0, v.len, v.type, v.resolution, v.little) == (2, 2, "Uint16", 0.01, True)
    assert {int(k): t for k, t in v.bit_rules[0].meanings.items()} == {0: "a", 2**64 - 1: "top"}
    assert v.controller == "k" and int(v.profiles[0].value) == 2**64 - 1 and v.controller_unknown == "UNKNOWN_CONTROLLER"
    assert (w.off0, w.type, w.bit_rules, w.profiles) == (7, "RawUnsignedBE", [], None)
    assert (blank.name, blank.off0, blank.len, blank.expression) == ("", -1, 1, "1")
    assert {r.file[-6]: r.error for r in errors.collect()} == {
        "d": "invalid JSON", "e": "no messages array or message object", "f": "message 1 is not an object",
        "g": "top level must be an object or an array"}


def test_field_files(spark):
    path = files(
        a={"fields": [{"name": "x", "byteOffset": 1}, 5, {"name": " "}]}, b={"messages": [{"fields": [{"name": "y"}]}, {"fields": [{"name": "no"}]}]},
        c=[{"name": "z"}], d={"fields": [], "messageName": "q"}, e="nope",
    )
    fields, warnings = catalog.read_field_catalog(spark, path)
    assert sorted((r.file[-6], r.ord, r.name) for r in fields.collect()) == [("a", 0, "x"), ("a", 2, "field_3"), ("b", 0, "y"), ("c", 0, "z")]
    assert sorted((r.file[-6], r.warning) for r in warnings.collect()) == [
        ("a", "field 3 had a blank name"), ("a", "item 2 is not an object; skipped"), ("d", "no usable fields"), ("e", "invalid JSON")]


SHEET = """Name,ByteOffset,DataType,Length,Resolution,ResolutionExpression
MessageID,1,uchar,1,1,1
Latitude,2,int,4,0.0000001,1
Altitude_m,10,float,,1,1
Heading_deg,16,ushort,2,0.0054931640625,360/65536
CallSign,20,string,8,1,1
,,,,,
"""
BAD = """Field Name,Offset,Type,Bytes,Scale,Endian
,1,uchar,1,,
a,1,uchar,1,,LE
a,2,uchar,1,,
b,-1,uchar,1,,
c,1,blob,1,,
d,1,string,,,
e,1,uchar,0,,
f,1,uchar,1,x,
g,7,ushort,2,,
h,1,ushort,2,,
"""


def test_field_sheets(spark):
    path = tempfile.mkdtemp(prefix="wirelens-", dir="/tmp")
    for name, text in (("good", SHEET), ("bad", BAD)):
        with open(f"{path}/{name}.csv", "w") as f:
            f.write(text)
    fields, errors = catalog.read_csv_sheets(spark, f"{path}/good.csv")
    rows = fields.orderBy("_row").collect()
    assert [(r.name, r.off0, r.len, r.type) for r in rows] == [
        ("MessageID", 0, 1, "Uint8"), ("Latitude", 1, 4, "Int32"), ("Altitude_m", 9, 4, "Float32"),
        ("Heading_deg", 15, 2, "Uint16"), ("CallSign", 19, 8, "String")]
    assert rows[3].expression == "360/65536" and errors.count() == 0
    fields, errors = catalog.read_csv_sheets(spark, f"{path}/bad.csv", payload_len=7)
    assert fields.count() == 0
    assert [(r._row, r.error) for r in errors.orderBy("_row").collect()] == [
        (2, "name is empty"), (4, "duplicate name"), (5, "byte offset must be a non-negative integer"), (6, "unknown data type"),
        (7, "length is required"), (8, "length must be a positive integer"), (9, "resolution must be a number"), (10, "exceeds payload length")]
    with pytest.raises(ValueError):
        catalog.sheet_columns(["Name", "Type"])


def found(df):
    return sorted((r.message, r.field, r.rule) for r in df.collect())


def test_message_and_field_rules(spark):
    f = (Field("a", 1, 2, "Uint16"),)
    messages = [
        Message("A", 1, 4, f), Message("a ", 1, 5, f), Message("B", 1, 4, f), Message(" ", 0, 0), Message("t", 1, format="NMEA"),
        Message("u", 1, format="NMEA", sentence="GGA", fields=(Field("", nmea_index=1), Field("k", nmea_index=0))),
    ]
    assert found(quality.check_messages(messages_frame(spark, messages), fields_frame(spark, messages))) == [
        (" ", "", "length_not_positive"), (" ", "", "name_empty"), (" ", "", "no_fields"), (" ", "", "port_zero"),
        ("A", "", "duplicate_name"), ("A", "", "duplicate_signature"), ("t", "", "no_fields"), ("t", "", "no_sentence"),
        ("u", "", "nmea_field_incomplete"), ("u", "k", "nmea_field_incomplete")]
    assert quality.check_catalogue_present(messages_frame(spark, messages)).count() == 0
    assert quality.check_catalogue_present(messages_frame(spark, messages).limit(0)).first().rule == "no_messages"
    odd = [Message("m", 1, 10, (Field("x", 1, 2), Field(" X", 0, 2), Field("", 9, 3), Field("y", 1_000_001, 0, resolution=0.0), Field("s", 1, 9, "String"), Field("n", 1, 9)))]
    got = found(quality.check_fields(fields_frame(spark, odd), messages_frame(spark, odd), max_numeric_length=8))
    assert got == [
        ("m", "", "exceeds_payload"), ("m", "", "name_empty"), ("m", " X", "exceeds_payload"), ("m", " X", "offset_too_small"),
        ("m", "n", "length_invalid"), ("m", "x", "duplicate_field"), ("m", "y", "exceeds_payload"), ("m", "y", "length_invalid"),
        ("m", "y", "offset_too_large"), ("m", "y", "resolution_not_positive")]


def test_bit_and_profile_rules(spark):
    r = BitRule("ok", (0,), {1: "x"})
    rules = (BitRule("", (), {}), BitRule("a b", (0, 0, 9), {1: "x"}), BitRule("a_b", (1,), {2: "x"}), BitRule("z", (9, 1), {0: "q"}), BitRule("no", (), {}, enabled=False))
    m = [Message("m", 1, 2, (Field("f", 1, 1, bit_rules=rules),))]
    assert found(quality.check_bit_rules(fields_frame(spark, m))) == sorted(
        [("m", "f", t) for t in (
            "rule_label_empty", "rule_has_no_bits", "rule_has_no_meanings", "bit_out_of_range", "bit_out_of_range", "bit_repeated",
            "meaning_too_wide", "duplicate_rule_label", "bit_shared_by_rules", "bit_shared_by_rules")])
    profiles = (Profile("P 1", 1, (r, r)), Profile("P_1", 1, (), (Exclusion((3,), "", "bad"), Exclusion((1, 99), "l", "bad"))), Profile("", 2))
    wrong = [Message("m", 1, 30, (Field("c", 1, 9), Field("f", 10, 1, profiles=Profiles("c", profiles)), Field("g", 11, 1, profiles=Profiles("g", ())), Field("h", 12, 1, profiles=Profiles("none", (Profile("x", 1),)))))]
    assert found(quality.check_profiles(fields_frame(spark, wrong))) == sorted(
        [("m", "f", t) for t in ("controller_length", "profile_name_empty", "profile_label_clash", "duplicate_controller_value",
                                 "exclusion_needs_two_bits", "exclusion_label_empty", "exclusion_bit_out_of_range",
                                 "duplicate_rule_label", "bit_shared_by_rules")]
        + [("m", "g", "controller_is_itself"), ("m", "g", "no_profiles"), ("m", "h", "controller_unknown")])


def test_filter_compare_and_send_rules(spark):
    rows = [("p", 0, "a", 70000, ""), ("p", 1, "a", 80, ""), ("p", 2, " ", 80, "")]
    ports = spark.createDataFrame(rows, "config string, pos int, label string, port int, header_text string")
    assert sorted(r.rule for r in quality.check_filters(ports, "port").collect()) == ["duplicate_label", "duplicate_port", "label_empty", "port_range"]
    texts = ["", "aa 55", "AA55", "AA", "xy", "123", "1122334455"]
    heads = spark.createDataFrame([("h", i, str(i), 1, t) for i, t in enumerate(texts)], "config string, pos int, label string, port int, header_text string")
    got = sorted(r.rule for r in quality.check_filters(heads, "header").collect())
    assert got == ["duplicate_header", "empty_header_not_alone", "header_not_hex", "header_odd", "header_overlap", "header_overlap", "header_overlap", "header_too_long"]
    path = files(a=[
        {"messageName": "m", "payloadLengthBytes": 4, "hasCompareOptions": True, "compareOptions": {
            "checkHeader": True, "headerByteOffset": 3, "headerLength": 2, "expectedHeaderText": "AA 5", "checkTerminator": True, "terminatorLength": 1,
            "expectedTerminatorText": "ab", "terminatorInputMode": "ASCII", "checkChecksum": True, "checksumRangeStart": 5, "checksumRangeEnd": 5, "checksumLength": 5,
            "checkRefreshRate": True, "expectedRefreshRateHz": -1, "refreshRateToleranceHz": -1}},
        {"messageName": "fine", "payloadLengthBytes": 4, "hasCompareOptions": True, "compareOptions": {"checkHeader": True, "headerLength": 1, "expectedHeaderText": "AA"}}])
    messages, _, _ = catalog.read_catalog(spark, path)
    assert sorted(r.rule for r in quality.check_compare_options(messages).collect()) == [
        "checksum_exceeds_payload", "checksum_length", "checksum_range_empty", "checksum_range_end", "checksum_range_start",
        "header_exceeds_payload", "header_hex_odd", "header_length_differs", "refresh_rate_negative", "terminator_length_differs", "tolerance_negative"]
    f = (Field("x", 1, 1),)
    sends = [Message("fast", 1, 4, f, rate_hz=1001), Message("big", 1, 65508, f), Message("off", 1, 4, enabled=False), Message("bare", 1, 4), Message("tcp", 1, 65508, f, connection_ids=("t",))]
    conns = connections_frame(spark, [Connection("u"), Connection("t", transport="TCP")])
    defs = messages_frame(spark, sends)
    from wirelens.operators.route import message_destinations

    got = found(quality.check_sendable(defs, fields_frame(spark, sends), message_destinations(defs, conns), conns))
    assert got == [("bare", "", "no_fields"), ("big", "", "datagram_too_large"), ("fast", "", "rate_out_of_range")]


def test_schedule_and_roundtrip(spark):
    defs = messages_frame(spark, [Message("slow", rate_hz=2), Message("quick", rate_hz=1000), Message("off", enabled=False)])
    out = schedule.emission_schedule(defs, connections_frame(spark, [Connection("u")]), 2)
    got = {r.message: (r.n, r.last) for r in out.groupBy("message").agg(F.count("*").alias("n"), F.max("at_ms").alias("last")).collect()}
    assert got == {"slow": (4, 1500), "quick": (2000, 1999)}
    m = Message("m", 1, 6, (Field("a", 1, 2, "Uint16", 0.01), Field("b", 3, 4, "Float32")))
    df = spark.createDataFrame([(1, 1.25, 0.1), (2, 700.0, 1.0)], "id int, a double, b double")
    bad = schedule.roundtrip_check(df, m, ["id"], {"a": F.col("a"), "b": F.col("b")}).collect()
    assert {(r.id, r.field) for r in bad} == {(2, "a"), (2, "b")} and "a: value does not fit" in bad[0].problems


def test_sheets_keep_their_own_headers(spark, tmp_path):
    from wirelens.sources import catalog

    (tmp_path / "a.csv").write_text('Name,ByteOffset,DataType\nAlt,1,Uint16\n"Sp\need",3,Uint8\n')
    (tmp_path / "b.csv").write_text("data type,Resolution,offset,extra,field name\nInt32,0.5,5,x,Lat\n")
    fields, errors = catalog.read_csv_sheets(spark, str(tmp_path))
    got = sorted((r.name, r.offset, r.type, r.len, r.resolution) for r in fields.collect())
    assert got == [("Alt", 1, "Uint16", 2, 1.0), ("Lat", 5, "Int32", 4, 0.5), ("Sp\need", 3, "Uint8", 1, 1.0)]
    assert errors.collect() == []


def test_catalogue_to_definitions(spark):
    from wirelens.plans.definitions import messages_from_catalog, messages_from_icd

    kinds = {"messageName": "K", "dataFormat": "NMEA", "nmeaSentenceType": "XYZ", "fields": [{"name": "t", "nmeaFieldIndex": 1, "nmeaValueKind": 4}, {"name": "u", "nmeaValueKind": 99}]}
    messages, fields, _ = catalog.read_catalog(spark, files(a={"messages": [FULL, kinds]}))
    full, text = messages_from_catalog(messages, fields)
    assert (full.name, full.port, full.length, full.header, full.connection_ids) == ("M", 5000, 8, b"\xaa\x55", ("c1",))
    v = full.fields[0]
    assert (v.offset, v.length, v.type, v.resolution, v.little) == (3, 2, "Uint16", 0.01, True)
    assert v.bit_rules[0].meanings == {0: "a", 2**64 - 1: "top"} and v.profiles.profiles[0].value == 2**64 - 1
    assert full.checks.header == (0, 1) and full.checks.expected_header == b"\xaa" and full.checks.checksum is None
    assert [f.nmea_kind for f in text.fields] == ["Time", "Text"] and text.checks is None
    with pytest.raises(ValueError):
        messages_from_catalog(messages, fields, max_messages=1)
    mined = spark.createDataFrame([("d", "A", 6), ("d", "B", None)], "doc string, message string, payload_len int")
    own = spark.createDataFrame([("d", "A", "y", 2, 4, "Uint32"), ("d", "A", "x", 0, 2, "Int16"), ("d", "B", "z", 1, 1, "Uint8"), ("d", "B", "q", None, 1, None)], "doc string, message string, name string, off0 int, len int, type string")
    a, b = messages_from_icd(mined, own)
    assert (a.name, a.length, [f.name for f in a.fields]) == ("A", 6, ["x", "y"]) and (b.length, b.fields[0].offset) == (2, 2)
