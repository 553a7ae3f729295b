import random

from pyspark.sql import functions as F

from wirelens.functions import bits
from wirelens.functions import bytes as by
from wirelens.operators.decode import decode_fields
from wirelens.operators.schedule import bit_rules_long
from wirelens.plans.model import BitRule, Exclusion, Field, Message, Profile, Profiles, fields_frame, value_headers


def first(spark, hexed, expr):
    df = spark.createDataFrame([(bytearray(bytes.fromhex(hexed)),)], "payload binary")
    return df.select(expr).first()[0]


def test_groups_follow_listed_order(spark):
    rng = random.Random(3)
    for _ in range(6):
        raw = rng.randbytes(8)
        positions = tuple(rng.sample(range(64), rng.randint(1, 20)))
        want = sum(((raw[p // 8] >> (p % 8)) & 1) << i for i, p in enumerate(positions))
        got = first(spark, raw.hex(), bits.bit_group(by.slice_hex(F.col("payload"), 0, 8), 8, positions))
        assert got == want
    assert first(spark, "FF", bits.bit_group(by.slice_hex(F.col("payload"), 0, 1), 1, (8,))) is None


def test_meanings_and_misses(spark):
    h = by.slice_hex(F.col("payload"), 0, 1)

    def rule(**k):
        return bits.decode_bits(h, 1, BitRule("r", (0, 1), {0: "zero", 1: "one"}, **k))

    assert first(spark, "01", rule()) == "one"
    assert first(spark, "02", rule()) == "UNKNOWN(10)"
    assert first(spark, "02", rule(unknown="raw_binary")) == "10"
    assert first(spark, "02", rule(unknown="BLANK")) == ""
    assert first(spark, "01", rule(enabled=False)) is None
    top = bits.decode_bits(by.slice_hex(F.col("payload"), 0, 8), 8, BitRule("r", tuple(range(64)), {2**64 - 1: "all"}))
    assert first(spark, "FF" * 8, top) == "all"


def test_profiles_by_controller(spark):
    profiles = Profiles(
        "mode",
        (
            Profile("Nav Data", 1, (BitRule("up", (0,), {1: "yes"}),), (Exclusion((0, 1), "clash", "BAD"),)),
            Profile("other", 16, (BitRule("x", (7,), {0: "low"}),)),
        ),
    )
    m = Message("m", 1, 2, (Field("mode", 1, 1, "Uint8"), Field("word", 2, 1, "Uint8", profiles=profiles)))
    assert value_headers(m) == ["mode", "word", "word_Profile", "word_Nav_Data_up", "word_Nav_Data_Validation_clash", "word_other_x"]
    rows = [bytes.fromhex(h) for h in ("0103", "0101", "1000", "1A00")]
    df = spark.createDataFrame([(bytearray(r),) for r in rows], "payload binary").coalesce(1)
    got = [tuple(r)[2:] for r in decode_fields(df, m, values_only=True, text_parity=True).collect()]
    assert got == [
        ("Nav Data", "yes", "BAD", ""),
        ("Nav Data", "yes", "OK", ""),
        ("other", "", "", "low"),
        ("UNKNOWN_CONTROLLER(0X1A)", "", "", ""),
    ]
    lost = Message("m", 1, 1, (Field("word", 1, 1, "Uint8", profiles=profiles),))
    row = decode_fields(df, lost, values_only=True, text_parity=True).first()
    assert row["word_Profile"] == "UNKNOWN_CONTROLLER(0X0)"
    # A repeated field name: the last one controls.
    twice = Message("m", 1, 2, (Field("mode", 1, 1), Field("mode", 2, 1), Field("word", 2, 1, profiles=profiles)))
    assert value_headers(twice)[:2] == ["mode", "mode"]


def test_position_texts(spark):
    cases = {
        "0-3,5": ([0, 1, 2, 3, 5], None),
        " 7 , 1 ": ([7, 1], None),
        "": (None, "no_positions"),
        ",,": (None, "no_positions"),
        "3-1": (None, "bad_range: 3-1"),
        "1-2-3": (None, "bad_range: 1-2-3"),
        "x": (None, "bad_position: x"),
        "1,1": (None, "repeated_position: 1"),
        "2-999999": (None, "position_out_of_range: 16 not in 0..15"),
        "4,99,x": (None, "position_out_of_range: 99 not in 0..15"),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", bits.bit_positions(F.col("t"), 16).alias("r"))
    assert {r.t: (r.r.positions, r.r.error) for r in df.collect()} == cases


def test_rules_json(spark):
    good = (
        '{"rules":[{"label":" a ","type":"reserved","bits":[0,1],"mappings":'
        '[{"value":"3","binary":"10","meaning":"two"},{"value":"1","meaning":"one"},{"value":"1","meaning":"uno"}]}]}'
    )
    bad = '{"rules":[{"label":"a"},{"label":"b","mappings":[{"value":"zz"}]}]}'
    df = spark.createDataFrame([(good,), (bad,), ("nope",), ("  ",)], "t string").coalesce(1)
    out = [r[0] for r in df.select(bits.rules_from_json(F.col("t"))).collect()]
    rule = out[0].rules[0]
    assert (rule.label, rule.positions, rule.reserved, rule.unknown) == ("a", [0, 1], True, "UNKNOWN")
    assert {int(k): v for k, v in rule.meanings.items()} == {2: "two", 1: "uno"}
    assert out[1].error == "bad_mapping: rule 2"
    assert out[2].error == "not_json"
    assert out[3].rules is None and out[3].error is None


def test_rules_in_long_form(spark):
    rules = (BitRule("mode", (1, 0), {2: "b", 0: "a"}), BitRule("off", (3,), {1: "x"}, enabled=False), BitRule("one", (4,), {1: "y"}))
    m = Message("m", 1, 1, (Field("f", 1, 1, bit_rules=rules),))
    positions, meanings = bit_rules_long(fields_frame(spark, [m]))
    assert sorted((r.label, r.kind, r.idx, r.bit) for r in positions.collect()) == [
        ("mode", "GROUPED_BITS", 0, 1), ("mode", "GROUPED_BITS", 1, 0), ("one", "SINGLE_BIT", 0, 4)]
    assert sorted((r.label, r.binary, r.meaning) for r in meanings.collect()) == [("mode", "00", "a"), ("mode", "10", "b"), ("one", "1", "y")]
