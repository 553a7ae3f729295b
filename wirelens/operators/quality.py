"""Rules over definition tables; each check lists (message, field, rule, detail).

All rules are per-row tests or grouped counts, so a catalogue of any size is
checked with partial aggregation and no pairwise comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.functions.text import column_label, solve_expression
from wirelens.operators.joins import lookup_join
from wirelens.operators.route import header_overlaps

MAX_OFFSET = 1_000_000
MAX_DATAGRAM = 65_507


def _rows(df: DataFrame, rule: str | Column, detail: Column, field: Column | None = None) -> DataFrame:
    return df.select(
        F.col("message"),
        (field if field is not None else F.lit("")).cast("string").alias("field"),
        (rule if isinstance(rule, Column) else F.lit(rule)).alias("rule"),
        F.coalesce(detail.cast("string"), F.lit("")).alias("detail"),
    )


def _tests(df: DataFrame, tests: list[tuple[Column, str, Column]], field: Column | None = None) -> DataFrame:
    """Every failed test of a row as one violation, in a single pass."""
    found = F.array(
        *[F.when(bad, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))) for bad, rule, detail in tests]
    )
    listed = df.withColumn("_v", F.explode(F.array_compact(found)))
    return _rows(listed, F.col("_v.rule"), F.col("_v.detail"), field)


def _repeats(df: DataFrame, by: list[Column], names: list[str], rule: str, detail: Column, at_message: bool = False) -> DataFrame:
    """Groups with more than one member, as one violation each."""
    agg = [F.count(F.lit(1)).alias("_n")]
    if at_message:
        agg.append(F.min("message").alias("message"))
    grouped = df.groupBy(*[c.alias(n) for c, n in zip(by, names)]).agg(*agg).filter("_n > 1")
    return _rows(grouped, rule, detail)


def _header_hex() -> Column:
    return F.lower(F.hex(F.coalesce(F.col("header"), F.lit(b""))))


def check_messages(messages: DataFrame, fields: DataFrame) -> DataFrame:
    is_text = F.col("format") == "NMEA"
    named = F.trim(F.coalesce(F.col("message"), F.lit("")))
    own = _tests(
        messages,
        [
            (named == "", "name_empty", F.lit("")),
            (F.coalesce(F.col("port"), F.lit(0)) == 0, "port_zero", F.lit("")),
            (is_text & (F.trim("sentence") == ""), "no_sentence", F.lit("")),
            (~is_text & (F.col("payload_len") <= 0), "length_not_positive", F.col("payload_len")),
        ],
    )
    with_fields = fields.select("message").distinct()
    empty = _rows(messages.join(with_fields, "message", "left_anti"), "no_fields", F.lit(""))
    bare = fields.join(messages.filter(is_text).select("message").distinct(), "message", "left_semi")
    bare = bare.filter((F.trim("name") == "") | (F.col("nmea_index") <= 0))
    unplaced = _rows(bare, "nmea_field_incomplete", F.col("ord"), F.col("name"))
    hexes = messages.filter(~is_text)
    signature = _repeats(
        hexes,
        [F.col("port"), F.col("payload_len"), _header_hex()],
        ["port", "payload_len", "_h"],
        "duplicate_signature",
        F.concat_ws(":", "port", "payload_len", "_h", "_n"),
        True,
    )
    titles = _repeats(
        hexes,
        [F.col("port"), F.lower(named)],
        ["port", "_name"],
        "duplicate_name",
        F.concat_ws(":", "port", "_name", "_n"),
        True,
    )
    return own.unionByName(empty).unionByName(unplaced).unionByName(signature).unionByName(titles)


def check_catalogue_present(messages: DataFrame) -> DataFrame:
    """One violation when the list of definitions is empty."""
    return (
        messages.agg(F.count(F.lit(1)).alias("_n"))
        .filter("_n = 0")
        .select(F.lit("").alias("message"), F.lit("").alias("field"), F.lit("no_messages").alias("rule"), F.lit("").alias("detail"))
    )


def check_fields(fields: DataFrame, messages: DataFrame | None = None, max_numeric_length: int = 0) -> DataFrame:
    """Offsets here are 0-based, so position 1 is offset 0."""
    name = F.lower(F.trim(F.coalesce(F.col("name"), F.lit(""))))
    long_number = (F.col("type") != "String") & F.lit(max_numeric_length > 0) & (F.col("len") > max_numeric_length)
    tests = [
        (name == "", "name_empty", F.col("ord")),
        (F.col("off0") < 0, "offset_too_small", F.col("off0") + 1),
        (F.col("off0") + 1 > MAX_OFFSET, "offset_too_large", F.col("off0") + 1),
        ((F.col("len") <= 0) | long_number, "length_invalid", F.col("len")),
        (F.col("resolution") <= 0, "resolution_not_positive", F.col("resolution")),
    ]
    out = _tests(fields, tests, F.col("name"))
    repeated = (
        fields.filter(name != "")
        .groupBy("message", name.alias("_name"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
    )
    out = out.unionByName(_rows(repeated, "duplicate_field", F.col("_n"), F.col("_name")))
    if messages is not None:
        # The furthest field decides per message whether the join back is needed at all.
        sizes = messages.filter("format <> 'NMEA'").select("message", "payload_len")
        placed = lookup_join(fields, sizes, ["message"], spread=["message", "ord"])
        over = placed.filter((F.col("off0") < 0) | (F.col("off0") + F.col("len") > F.col("payload_len")))
        out = out.unionByName(_rows(over, "exceeds_payload", F.col("off0") + F.col("len"), F.col("name")))
    return out


def _rule_tests(rules: DataFrame, prefix: Column) -> DataFrame:
    """Violations of exploded bit rules (message, name, len, owner, pos, rule)."""
    r = F.col("rule")
    width = F.size(r["positions"])
    limit = F.col("len") * 8
    label = F.trim(F.coalesce(r["label"], F.lit("")))
    out_of_range = F.filter(r["positions"], lambda b: (b < 0) | (b >= limit))
    repeated = F.size(F.array_distinct(r["positions"])) < width
    top = F.pow(F.lit(2.0), width.cast("double"))
    wide = F.filter(F.map_keys(r["meanings"]), lambda k: (width < 64) & (k.cast("double") >= top))
    detail = F.concat(prefix, label)
    own = _tests(
        rules,
        [
            (F.col("len") <= 0, "field_length_invalid", detail),
            (label == "", "rule_label_empty", F.concat(prefix, F.col("pos").cast("string"))),
            (width == 0, "rule_has_no_bits", detail),
            (width > 64, "rule_too_wide", detail),
            (F.size(out_of_range) > 0, "bit_out_of_range", F.concat(detail, F.lit(":"), F.array_join(out_of_range.cast("array<string>"), ","))),
            (repeated, "bit_repeated", detail),
            (F.size(r["meanings"]) == 0, "rule_has_no_meanings", detail),
            (F.size(wide) > 0, "meaning_too_wide", detail),
        ],
        F.col("name"),
    )
    labels = (
        rules.filter(label != "")
        .groupBy("message", "name", "owner", F.lower(column_label(label)).alias("_l"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
    )
    same_label = _rows(labels, "duplicate_rule_label", F.concat_ws(":", "owner", "_l"), F.col("name"))
    bits = rules.select("message", "name", "owner", F.explode(F.array_distinct(r["positions"])).alias("_bit"))
    shared = bits.groupBy("message", "name", "owner", "_bit").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    same_bit = _rows(shared, "bit_shared_by_rules", F.concat_ws(":", "owner", F.col("_bit")), F.col("name"))
    return own.unionByName(same_label).unionByName(same_bit)


def check_bit_rules(fields: DataFrame) -> DataFrame:
    rules = fields.select(
        "message", "name", "len", F.lit("").alias("owner"), F.posexplode("bit_rules").alias("pos", "rule")
    ).filter("rule.enabled")
    return _rule_tests(rules, F.lit(""))


def check_profiles(fields: DataFrame) -> DataFrame:
    """Controllers, profile names and values, nested rules and exclusions."""
    owners = fields.filter("controller is not null")
    controllers = fields.groupBy("message", F.col("name").alias("controller")).agg(F.min_by("len", "ord").alias("_clen"))
    joined = owners.join(controllers, ["message", "controller"], "left")
    blank = F.trim("controller") == ""
    own = _tests(
        joined,
        [
            (blank, "controller_empty", F.lit("")),
            (~blank & (F.col("controller") == F.col("name")), "controller_is_itself", F.col("controller")),
            (~blank & F.col("_clen").isNull(), "controller_unknown", F.col("controller")),
            ((F.col("_clen") < 1) | (F.col("_clen") > 8), "controller_length", F.col("_clen")),
            (F.coalesce(F.size("profiles"), F.lit(0)) == 0, "no_profiles", F.lit("")),
        ],
        F.col("name"),
    )
    profiles = owners.select("message", "name", "len", F.posexplode("profiles").alias("_pp", "p"))
    nameless = _rows(
        profiles.filter(F.trim("p.name") == ""), "profile_name_empty", F.col("_pp"), F.col("name")
    )

    def repeats(key: Column, rule: str) -> DataFrame:
        grouped = profiles.groupBy("message", "name", key.cast("string").alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
        return _rows(grouped.filter("_n > 1"), rule, F.col("_k"), F.col("name"))

    rules = profiles.select(
        "message", "name", "len", F.col("p.name").alias("owner"), F.posexplode("p.rules").alias("pos", "rule")
    ).filter("rule.enabled")
    exclusions = profiles.select("message", "name", "len", F.col("p.name").alias("owner"), F.explode("p.exclusions").alias("x"))
    far = F.filter(F.col("x.positions"), lambda b: (b < 0) | (b >= F.col("len") * 8))
    checked = _tests(
        exclusions,
        [
            (F.size("x.positions") < 2, "exclusion_needs_two_bits", F.col("owner")),
            (F.size(far) > 0, "exclusion_bit_out_of_range", F.concat_ws(":", "owner", F.array_join(far.cast("array<string>"), ","))),
            (F.trim("x.label") == "", "exclusion_label_empty", F.col("owner")),
        ],
        F.col("name"),
    )
    out = own.unionByName(nameless)
    out = out.unionByName(repeats(F.col("p.name"), "duplicate_profile_name"))
    out = out.unionByName(repeats(column_label(F.col("p.name")), "profile_label_clash"))
    out = out.unionByName(repeats(F.col("p.value"), "duplicate_controller_value"))
    return out.unionByName(_rule_tests(rules, F.concat(F.col("owner"), F.lit("/")))).unionByName(checked)


def check_filters(filters: DataFrame, mode: str) -> DataFrame:
    """Violations of filter lists: columns config, pos, label, port, header_text.

    ``mode`` is ``port`` or ``header``; each ``config`` is one list.
    """
    counts = filters.groupBy("config").agg(F.count(F.lit(1)).alias("_n"))
    out = [counts.filter("_n < 1 or _n > 20").select("config", F.lit("filter_count").alias("rule"), F.col("_n").cast("string").alias("detail"))]

    def simple(df: DataFrame, rule: str, detail: Column) -> None:
        out.append(df.select("config", F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))

    def repeats(key: str, rule: str) -> None:
        simple(
            filters.groupBy("config", key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), rule, F.col(key)
        )

    simple(filters.filter((F.col("port") < 0) | (F.col("port") > 65535)), "port_range", F.col("port"))
    simple(filters.filter(F.trim("label") == ""), "label_empty", F.col("pos"))
    repeats("label", "duplicate_label")
    if mode == "port":
        repeats("port", "duplicate_port")
    else:
        cleaned = F.upper(F.regexp_replace("header_text", "\\s+", ""))
        staged = filters.withColumn("_hex", cleaned)
        simple(staged.filter(~F.col("_hex").rlike("^[0-9A-F]*$")), "header_not_hex", F.col("header_text"))
        simple(staged.filter(F.length("_hex") % 2 == 1), "header_odd", F.col("_hex"))
        simple(staged.filter(F.length("_hex") > 8), "header_too_long", F.col("_hex"))
        good = staged.filter(F.col("_hex").rlike("^([0-9A-F]{2}){0,4}$"))
        dup = good.groupBy("config", "_hex").agg(F.count(F.lit(1)).alias("_n"))
        simple(dup.filter("_n > 1"), "duplicate_header", F.col("_hex"))
        lone = good.filter("_hex = ''").select("config").distinct().join(counts.filter("_n > 1"), "config")
        simple(lone, "empty_header_not_alone", F.lit(""))
        # Overlap inside a list: the list key is put in front of every header.
        keyed = dup.select(F.concat(F.encode("config", "UTF-8"), F.lit(bytearray(b"\x00"))).alias("_k"), "config", F.unhex("_hex").alias("_h"))
        prefixes = keyed.select("config", F.hex("_h").alias("longer"), F.explode(F.sequence(F.lit(0), F.octet_length("_h"))).alias("_n"), "_h")
        prefixes = prefixes.filter(F.col("_n") < F.octet_length("_h")).select(
            "config", "longer", F.hex(F.substring(F.col("_h"), F.lit(1), F.col("_n"))).alias("shorter")
        )
        pairs = prefixes.join(keyed.select("config", F.hex("_h").alias("shorter")), ["config", "shorter"])
        simple(pairs, "header_overlap", F.concat_ws("<", "shorter", "longer"))
    total = out[0]
    for part in out[1:]:
        total = total.unionByName(part)
    return total


def check_compare_options(messages: DataFrame) -> DataFrame:
    """Rules over the ``checks`` struct of messages (see sources.catalog)."""
    c, size = F.col("checks"), F.col("payload_len")
    known = size > 0

    def expected(label: str, text: str, mode: str, length: Column) -> list:
        raw = F.trim(c[text])
        hexed = F.replace(raw, F.lit(" "), F.lit(""))
        is_hex = c[mode] == "HEX"
        count = F.when(is_hex, F.length(hexed) / 2).otherwise(F.octet_length(F.encode(raw, "UTF-8")))
        bad_hex = is_hex & ~hexed.rlike("^[0-9A-Fa-f]*$")
        return [
            ((raw != "") & is_hex & (F.length(hexed) % 2 == 1), f"{label}_hex_odd", raw),
            ((raw != "") & bad_hex, f"{label}_not_hex", raw),
            ((raw != "") & ~bad_hex & (length > 0) & (count != length), f"{label}_length_differs", raw),
        ]

    tests = []
    for label, flag in (("header", "checkHeader"), ("terminator", "checkTerminator")):
        off, length = c[f"{label}ByteOffset"], c[f"{label}Length"]
        on = c[flag]
        tests.append((on & (length <= 0), f"{label}_length", length))
        tests.append((on & known & (off >= 0) & (off + length > size), f"{label}_exceeds_payload", off + length))
        cap = label.capitalize()
        tests += [(on & t, r, d) for t, r, d in expected(label, f"expected{cap}Text", f"{label}InputMode", length)]
    on, start, end = c["checkChecksum"], c["checksumRangeStart"], c["checksumRangeEnd"]
    off, length = c["checksumByteOffset"], c["checksumLength"]
    tests += [
        (on & ((length <= 0) | (length > 4)), "checksum_length", length),
        (on & (end <= start), "checksum_range_empty", end),
        (on & known & (end > size), "checksum_range_end", end),
        (on & known & (start + 1 > size), "checksum_range_start", start + 1),
        (on & known & (off + length > size), "checksum_exceeds_payload", off + length),
        (c["checkRefreshRate"] & (c["expectedRefreshRateHz"] < 0), "refresh_rate_negative", c["expectedRefreshRateHz"]),
        (c["checkRefreshRate"] & (c["refreshRateToleranceHz"] < 0), "tolerance_negative", c["refreshRateToleranceHz"]),
    ]
    return _tests(messages.filter("has_checks"), tests)


def check_sendable(messages: DataFrame, fields: DataFrame, destinations: DataFrame, connections: DataFrame) -> DataFrame:
    """Rate, presence of fields and the datagram limit of enabled messages."""
    enabled = messages.filter("enabled")
    own = _tests(
        enabled, [((F.col("rate_hz") <= 0) | (F.col("rate_hz") > 1000), "rate_out_of_range", F.col("rate_hz"))]
    )
    empty = _rows(enabled.join(fields.select("message").distinct(), "message", "left_anti"), "no_fields", F.lit(""))
    udp = connections.filter("transport = 'UDP'").select(F.col("id").alias("connection_id"))
    over_udp = destinations.join(udp, "connection_id", "left_semi").select("message").distinct()
    large = enabled.filter(F.col("payload_len") > MAX_DATAGRAM).join(over_udp, "message", "left_semi")
    return own.unionByName(empty).unionByName(_rows(large, "datagram_too_large", F.col("payload_len")))


def solve_resolutions(fields: DataFrame, expression: str = "expression") -> DataFrame:
    """Add ``solved`` and ``solve_error``; each distinct text is evaluated once."""
    distinct = fields.select(expression).distinct()
    solved = distinct.withColumn("_s", solve_expression(F.col(expression))).select(
        expression,
        F.when(F.col("_s.value") > 0, F.col("_s.value")).alias("solved"),
        F.coalesce(
            F.col("_s.error"), F.when(F.col("_s.value") <= 0, "not_positive")
        ).alias("solve_error"),
    )
    return lookup_join(fields, solved, [expression], how="left", spread=[c for c in fields.columns if c != expression])


__all__ = [
    "check_bit_rules",
    "check_catalogue_present",
    "check_compare_options",
    "check_fields",
    "check_filters",
    "check_messages",
    "check_profiles",
    "check_sendable",
    "header_overlaps",
    "solve_resolutions",
]
