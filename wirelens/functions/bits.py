"""Bit groups, enumerations and exclusions over the bytes of a field.

Bit ``p`` lies in byte ``p // 8`` counted from the first byte of the field,
least significant bit first; the i-th listed position becomes bit i.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.functions.bytes import raw_of
from wirelens.plans.model import BitRule, Exclusion, Profiles

# ``h`` is the nullable hex text of the field's bytes, see functions.bytes.slice_hex.


def _bit(h: Column, position: int) -> Column:
    byte = raw_of(F.substring(h, 2 * (position // 8) + 1, 2))
    return F.shiftright(byte, position % 8).bitwiseAND(F.lit(1))


def bit_group(h: Column, length: int, positions: tuple[int, ...]) -> Column:
    """Value of the listed bits as bigint; NULL when one lies past the field."""
    if not positions or any(p < 0 or p // 8 >= length for p in positions):
        return F.lit(None).cast("bigint")
    value = None
    for i, p in enumerate(positions):
        bit = F.shiftleft(_bit(h, p), i) if i else _bit(h, p)
        value = bit if value is None else value.bitwiseOR(bit)
    return value


def binary_text(value: Column, width) -> Column:
    return F.lpad(F.bin(value), width, "0")


def _signed64(key: int) -> int:
    return key - (1 << 64) if key >= 1 << 63 else key


def _meaning(value: Column, rule: BitRule, when: Column | None = None) -> Column:
    """One flat conditional; ``when`` narrows every branch."""
    raw = binary_text(value, len(rule.positions))
    miss = {"BLANK": F.lit(""), "RAW_BINARY": raw}.get(
        rule.unknown.strip().upper(), F.concat(F.lit("UNKNOWN("), raw, F.lit(")"))
    )
    present = value.isNotNull() if when is None else value.isNotNull() & when
    out = None
    for key, text in sorted(rule.meanings.items()):
        hit = present & (value == _signed64(key))
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return F.when(present, miss) if out is None else out.when(present, miss)


def decode_bits(h: Column, length: int, rule: BitRule, when: Column | None = None) -> Column:
    """Meaning of a bit rule; NULL when disabled or the field is absent."""
    if not rule.enabled:
        return F.lit(None).cast("string")
    return _meaning(bit_group(h, length, rule.positions), rule, when)


def bits_set(h: Column, length: int, positions: tuple[int, ...]) -> Column:
    """How many listed bits are set; bits past the field do not count."""
    total = F.lit(0).cast("bigint")
    for p in positions:
        if 0 <= p // 8 < length:
            total = total + _bit(h, p)
    return total


def exclusive_bits(h: Column, length: int, rule: Exclusion, when: Column | None = None) -> Column:
    """The rule's text when more than one of its bits is set, else ``OK``."""
    clash = bits_set(h, length, rule.positions) > 1
    if when is None:
        return F.when(clash, rule.invalid).otherwise("OK")
    return F.when(when & clash, rule.invalid).when(when, "OK")


def decode_profiles(h: Column, length: int, controller: Column | None, profiles: Profiles) -> list[Column]:
    """Profile name, then each profile's rule and exclusion columns.

    ``controller`` is the raw controller value as a bigint bit pattern (NULL or
    None when missing). Columns of profiles that did not match stay NULL.
    """
    if controller is None:
        controller = F.lit(None).cast("bigint")
    unknown = F.lit(None).cast("string")
    if profiles.unknown.strip().upper() != "BLANK":
        shown = F.nvl(F.hex(controller), F.lit("0"))
        unknown = F.concat(F.lit("UNKNOWN_CONTROLLER(0X"), shown, F.lit(")"))
    name = None
    taken: list[int] = []
    columns: list[Column] = []
    for p in profiles.profiles:
        key = _signed64(p.value)
        repeated = key in taken  # the first profile of a value wins
        hit = F.lit(False) if repeated else controller.eqNullSafe(F.lit(key))
        if not repeated:
            taken.append(key)
            name = F.when(hit, p.name) if name is None else name.when(hit, p.name)
        columns += [decode_bits(h, length, r, hit) for r in p.rules]
        columns += [exclusive_bits(h, length, e, hit) for e in p.exclusions]
    return [(unknown if name is None else name.otherwise(unknown))] + columns


# ------------------------------------------------------- rule texts as columns


def bit_positions(text: Column, max_bits) -> Column:
    """``"0-3,5"`` to struct(positions, error); the first fault in text order wins."""
    max_bits = max_bits if isinstance(max_bits, Column) else F.lit(max_bits)
    cleaned = F.replace(F.trim(text), F.lit(" "), F.lit(""))
    parts = F.filter(F.split(cleaned, ","), lambda p: p != "")

    def as_int(t):
        return F.when(t.rlike("^[+-]?[0-9]{1,9}$"), t.try_cast("int"))

    def expand(p):
        ends = F.split(p, "-")
        lo, hi = as_int(F.get(ends, F.lit(0))), as_int(F.get(ends, F.lit(1)))
        is_range = F.contains(p, F.lit("-"))
        bad_range = (F.size(ends) != 2) | lo.isNull() | hi.isNull() | (lo > hi)
        single = as_int(p)
        # One position past the limit is enough to report the range, so a huge
        # range never builds a huge array.
        stop = F.least(hi, F.greatest(lo, max_bits))
        none = F.array().cast("array<int>")
        return F.struct(
            F.when(is_range & F.coalesce(bad_range, F.lit(True)), none)
            .when(is_range, F.sequence(lo, stop))
            .when(single.isNull(), none)
            .otherwise(F.array(single))
            .alias("positions"),
            F.when(is_range & F.coalesce(bad_range, F.lit(True)), F.concat(F.lit("bad_range: "), p))
            .when(~is_range & single.isNull(), F.concat(F.lit("bad_position: "), p))
            .alias("error"),
        )

    expanded = F.transform(parts, expand)
    start = F.struct(F.array().cast("array<int>").alias("positions"), F.lit(None).cast("string").alias("error"))

    def add_one(acc, b):
        error = F.when(
            (b < 0) | (b >= max_bits),
            F.format_string("position_out_of_range: %d not in 0..%d", b, max_bits - 1),
        ).when(F.array_contains(acc["positions"], b), F.format_string("repeated_position: %d", b))
        return F.when(acc["error"].isNotNull(), acc).otherwise(
            F.struct(
                F.when(error.isNull(), F.array_append(acc["positions"], b)).otherwise(acc["positions"]).alias("positions"),
                error.alias("error"),
            )
        )

    def add_part(acc, part):
        grown = F.aggregate(part["positions"], acc, add_one)
        return F.when(acc["error"].isNotNull(), acc).otherwise(
            F.struct(
                grown["positions"].alias("positions"),
                F.coalesce(part["error"], grown["error"]).alias("error"),
            )
        )

    folded = F.aggregate(expanded, start, add_part)
    error = (
        F.when(folded["error"].isNotNull(), folded["error"])
        .when(F.size(folded["positions"]) == 0, F.lit("no_positions"))
        .when(F.size(folded["positions"]) > 64, F.lit("over_64_positions"))
    )
    return F.struct(
        F.when(error.isNull(), folded["positions"]).alias("positions"),
        error.alias("error"),
    )


RULES_JSON = (
    "struct<rules:array<struct<label:string,type:string,reserved:boolean,unknownBehavior:string,enabled:boolean,"
    "bits:array<int>,mappings:array<struct<value:string,binary:string,meaning:string>>>>>"
)


def rules_from_json(text: Column) -> Column:
    """Rules JSON to struct(rules, error); a binary pattern outranks a decimal value."""
    parsed = F.from_json(text, RULES_JSON)
    empty = F.trim(text) == ""

    def mapping(m):
        binary = F.trim(F.coalesce(m["binary"], F.lit("")))
        value = F.trim(F.coalesce(m["value"], F.lit("")))
        number = F.when(binary.rlike("^[01]{1,64}$"), F.conv(binary, 2, 10).cast(T.DecimalType(20, 0))).when(
            (binary == "") & value.rlike("^[0-9]{1,20}$"), value.try_cast(T.DecimalType(20, 0))
        )
        number = F.when(number <= F.lit(str((1 << 64) - 1)).cast(T.DecimalType(20, 0)), number)
        return F.struct(number.alias("value"), F.coalesce(m["meaning"], F.lit("")).alias("meaning"))

    def rule(r):
        behaviour = F.upper(F.trim(F.coalesce(r["unknownBehavior"], F.lit("UNKNOWN"))))
        kind = F.upper(
            F.trim(
                F.coalesce(
                    r["type"], F.when(F.coalesce(r["reserved"], F.lit(False)), "RESERVED").otherwise("GROUPED_BITS")
                )
            )
        )
        return F.struct(
            F.trim(F.coalesce(r["label"], F.lit(""))).alias("label"),
            F.transform(F.coalesce(r["bits"], F.array().cast("array<int>")), lambda b: F.coalesce(b, F.lit(-1))).alias(
                "positions"
            ),
            F.transform(F.coalesce(r["mappings"], F.array()), mapping).alias("mappings"),
            F.when(behaviour.isin("BLANK", "RAW_BINARY"), behaviour).otherwise("UNKNOWN").alias("unknown"),
            F.coalesce(r["enabled"], F.lit(True)).alias("enabled"),
            (kind == "RESERVED").alias("reserved"),
        )

    rules = F.transform(F.coalesce(parsed["rules"], F.array()), rule)
    bad = F.filter(
        F.transform(rules, lambda r, i: F.when(F.exists(r["mappings"], lambda m: m["value"].isNull()), i + 1)),
        lambda i: i.isNotNull(),
    )
    error = (
        F.when(empty, F.lit(None).cast("string"))
        .when(parsed.isNull() | ~F.trim(text).startswith("{"), F.lit("not_json"))
        .when(F.size(bad) > 0, F.format_string("bad_mapping: rule %d", F.get(bad, F.lit(0))))
    )

    def as_map(r):
        # Later mappings of the same value replace earlier ones.
        pairs = F.aggregate(
            r["mappings"],
            F.create_map().cast(T.MapType(T.DecimalType(20, 0), T.StringType())),
            lambda acc, m: F.map_concat(
                F.map_filter(acc, lambda k, _: k != m["value"]), F.create_map(m["value"], m["meaning"])
            ),
        )
        return F.struct(
            r["label"].alias("label"),
            r["positions"].alias("positions"),
            pairs.alias("meanings"),
            r["unknown"].alias("unknown"),
            r["enabled"].alias("enabled"),
            r["reserved"].alias("reserved"),
        )

    return F.struct(F.when(error.isNull() & ~empty, F.transform(rules, as_map)).alias("rules"), error.alias("error"))
