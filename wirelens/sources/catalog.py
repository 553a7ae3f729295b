"""Message catalogues and field lists: JSON files, field sheets, typed cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.functions.text import natural_length, type_from_alias

RULE = (
    "struct<label:string,bitPositions:array<int>,valueMeanings:map<string,string>,reserved:boolean,"
    "unknownBehavior:string,enabled:boolean>"
)
EXCLUSION = "struct<mutuallyExclusiveBits:array<int>,validationLabel:string,invalidMessage:string>"
PROFILE = f"struct<profileName:string,controllerValue:string,bitDecodeRules:array<{RULE}>,exclusionRules:array<{EXCLUSION}>>"
FIELD = (
    "struct<name:string,byteOffset:int,byteOffsetCorrect:int,length:int,dataType:string,resolution:double,"
    f"resolutionExpression:string,hasBitfieldDecoder:boolean,bitDecodeRules:array<{RULE}>,"
    "hasConditionalBitfieldDecoder:boolean,conditionalDecoder:struct<controllerFieldName:string,"
    f"unknownBehavior:string,profiles:array<{PROFILE}>>,nmeaFieldIndex:int,nmeaValueKind:int,"
    "sendValueText:string,endianness:string>"
)
CHECKS = (
    "struct<checkHeader:boolean,headerByteOffset:int,headerLength:int,expectedHeaderHex:string,headerInputMode:string,"
    "expectedHeaderText:string,checkTerminator:boolean,terminatorByteOffset:int,terminatorLength:int,"
    "expectedTerminatorHex:string,terminatorInputMode:string,expectedTerminatorText:string,checkChecksum:boolean,"
    "checksumAlgorithm:string,checksumRangeStart:int,checksumRangeEnd:int,checksumByteOffset:int,checksumLength:int,"
    "checkRefreshRate:boolean,expectedRefreshRateHz:double,refreshRateToleranceHz:double,checkEndianness:boolean,"
    "expectedEndianness:string,checkDataLength:boolean,dataLengthByteOffset:int,dataLengthSize:int,"
    "dataLengthAdjust:int,checkMessageId:boolean,messageIdByteOffset:int,messageIdSize:int,expectedMessageId:string>"
)
MESSAGE = (
    "struct<messageName:string,port:int,payloadLengthBytes:int,optionalHeaderHex:string,fields:array<string>,"
    f"hasCompareOptions:boolean,compareOptions:{CHECKS},dataFormat:string,nmeaSentenceType:string,"
    "sendFrequencyHz:double,sendEnabled:boolean,nmeaTalker:string,offsetUnit:string,connectionId:string,"
    "connectionIds:array<string>>"
)
U64 = T.DecimalType(20, 0)
# Type names a file may carry; any other name reads as raw unsigned.
TYPE_NAMES = (
    "Bool", "Uint8", "Int8", "Uint16", "Int16", "Uint32", "Int32", "Uint64", "Int64", "Float32", "Float64", "String",
)


def _files(spark: SparkSession, paths) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def _kind(text: Column) -> Column:
    head = F.substring(F.ltrim(text), 1, 1)
    return F.when(F.try_parse_json(text).isNull(), "invalid").when(head == "{", "object").when(head == "[", "array")


def _hex_bytes(text: Column) -> Column:
    return F.unhex(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9A-Fa-f]", ""))


def _u64(text: Column) -> Column:
    """Unsigned from a decimal string or a JSON number; anything else is 0."""
    whole = F.when(text.rlike("^[0-9]{1,20}$"), text.try_cast(U64))
    number = F.when(~text.rlike("^[0-9]+$"), F.floor(text.try_cast("double")).try_cast(U64))
    return F.coalesce(whole, number, F.lit(0).cast(U64))


def _or(column: Column, default) -> Column:
    return F.coalesce(column, F.lit(default))


def _rules(rules: Column) -> Column:
    def rule(r):
        entries = F.filter(
            F.map_entries(F.coalesce(r["valueMeanings"], F.create_map().cast("map<string,string>"))),
            lambda e: e["key"].rlike("^[0-9]{1,20}$"),
        )
        meanings = F.map_from_entries(
            F.transform(entries, lambda e: F.struct(e["key"].cast(U64).alias("key"), _or(e["value"], "").alias("value")))
        )
        return F.struct(
            _or(r["label"], "").alias("label"),
            F.transform(F.coalesce(r["bitPositions"], F.array().cast("array<int>")), lambda b: _or(b, 0)).alias(
                "positions"
            ),
            meanings.alias("meanings"),
            _or(r["unknownBehavior"], "UNKNOWN").alias("unknown"),
            _or(r["enabled"], True).alias("enabled"),
            _or(r["reserved"], False).alias("reserved"),
        )

    return F.transform(F.coalesce(rules, F.array().cast(f"array<{RULE}>")), rule)


def _profiles(profiles: Column) -> Column:
    def exclusion(e):
        return F.struct(
            F.coalesce(e["mutuallyExclusiveBits"], F.array().cast("array<int>")).alias("positions"),
            _or(e["validationLabel"], "").alias("label"),
            _or(e["invalidMessage"], "").alias("invalid"),
        )

    def profile(p):
        return F.struct(
            _or(p["profileName"], "").alias("name"),
            _u64(p["controllerValue"]).alias("value"),
            _rules(p["bitDecodeRules"]).alias("rules"),
            F.transform(F.coalesce(p["exclusionRules"], F.array().cast(f"array<{EXCLUSION}>")), exclusion).alias(
                "exclusions"
            ),
        )

    return F.transform(F.coalesce(profiles, F.array().cast(f"array<{PROFILE}>")), profile)


def field_columns(f: Column) -> list[Column]:
    """Field columns with per-key defaults from a parsed field struct."""
    offset = _or(f["byteOffset"], 0)
    kind = F.when(f["dataType"].isin(*TYPE_NAMES), f["dataType"]).otherwise("RawUnsignedBE")
    rules = F.when(_or(f["hasBitfieldDecoder"], False), _rules(f["bitDecodeRules"])).otherwise(
        F.array().cast("array<struct<label:string,positions:array<int>,meanings:map<decimal(20,0),string>,unknown:string,enabled:boolean,reserved:boolean>>")
    )
    decoder = f["conditionalDecoder"]
    wants = _or(f["hasConditionalBitfieldDecoder"], False) & (F.coalesce(F.size(decoder["profiles"]), F.lit(0)) > 0)
    return [
        _or(f["name"], "").alias("name"),
        F.coalesce(f["byteOffsetCorrect"], offset - 1).alias("off0"),
        _or(f["length"], 1).alias("len"),
        kind.alias("type"),
        _or(f["resolution"], 1.0).alias("resolution"),
        _or(f["resolutionExpression"], "1").alias("expression"),
        _or(f["nmeaFieldIndex"], 0).alias("nmea_index"),
        _or(f["nmeaValueKind"], 0).alias("nmea_kind"),
        (_or(f["endianness"], "Big") == "Little").alias("little"),
        _or(f["sendValueText"], "").alias("send_value"),
        rules.alias("bit_rules"),
        F.when(wants, _or(decoder["controllerFieldName"], "")).alias("controller"),
        F.when(wants, _or(decoder["unknownBehavior"], "UNKNOWN_CONTROLLER")).alias("controller_unknown"),
        F.when(wants, _profiles(decoder["profiles"])).alias("profiles"),
    ]


def _message_texts(files: DataFrame) -> DataFrame:
    """(file, def_order, body) for the three shapes a message file may have."""
    kind = _kind(F.col("value"))
    listed = F.from_json(F.get_json_object("value", "$.messages"), "array<string>")
    single = F.get_json_object("value", "$.fields").isNotNull() | F.get_json_object(
        "value", "$.messageName"
    ).isNotNull()
    holds_list = F.ltrim(F.get_json_object("value", "$.messages")).startswith("[")
    bodies = (
        F.when((kind == "object") & holds_list, listed)
        .when((kind == "object") & single, F.array("value"))
        .when(kind == "array", F.from_json("value", "array<string>"))
    )
    return files.select("file", F.posexplode(bodies).alias("def_order", "body"))


def read_catalog(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, fields and per-file errors of message JSON files."""
    return parse_catalog(_files(spark, paths))


def parse_catalog(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same for texts already in a table (file, value)."""
    kind = _kind(F.col("value"))
    shaped = (
        F.ltrim(F.get_json_object("value", "$.messages")).startswith("[")
        | F.get_json_object("value", "$.fields").isNotNull()
        | F.get_json_object("value", "$.messageName").isNotNull()
    )
    texts = _message_texts(files)
    broken = texts.filter(~F.coalesce(F.ltrim("body").startswith("{"), F.lit(False)))
    bad_item = broken.groupBy("file").agg(F.min("def_order").alias("_at"))
    faults = files.join(bad_item, "file", "left").select(
        "file",
        F.when(kind == "invalid", "invalid JSON")
        .when(kind.isNull(), "top level must be an object or an array")
        .when((kind == "object") & ~F.coalesce(shaped, F.lit(False)), "no messages array or message object")
        .when(F.col("_at").isNotNull(), F.concat(F.lit("message "), F.col("_at") + 1, F.lit(" is not an object")))
        .alias("error"),
    )
    errors = faults.filter("error is not null")
    parsed = texts.join(errors.select("file"), "file", "left_anti").withColumn("m", F.from_json("body", MESSAGE))
    m = F.col("m")
    has_list = F.get_json_object("body", "$.connectionIds").isNotNull()
    listed = F.filter(F.coalesce(m["connectionIds"], F.array().cast("array<string>")), lambda i: _or(i, "") != "")
    single = F.when(_or(m["connectionId"], "") != "", F.array(m["connectionId"])).otherwise(
        F.array().cast("array<string>")
    )
    messages = parsed.select(
        "file",
        "def_order",
        _or(m["messageName"], "").alias("message"),
        F.pmod(_or(m["port"], 0), F.lit(65536)).alias("port"),
        _or(m["payloadLengthBytes"], 0).alias("payload_len"),
        _hex_bytes(m["optionalHeaderHex"]).alias("header"),
        _or(m["dataFormat"], "HEX").alias("format"),
        _or(m["nmeaSentenceType"], "").alias("sentence"),
        _or(m["nmeaTalker"], "GP").alias("talker"),
        _or(m["connectionId"], "").alias("connection_id"),
        F.when(has_list, listed).otherwise(single).alias("connection_ids"),
        _or(m["sendFrequencyHz"], 1.0).alias("rate_hz"),
        _or(m["sendEnabled"], True).alias("enabled"),
        F.when(F.upper(_or(m["offsetUnit"], "BYTES")) == "WORDS", "WORDS").otherwise("BYTES").alias("offset_unit"),
        _or(m["hasCompareOptions"], False).alias("has_checks"),
        _check_struct(m["compareOptions"]).alias("checks"),
    )
    items = parsed.select(
        "file", "def_order", _or(m["messageName"], "").alias("message"), F.posexplode(m["fields"]).alias("ord", "item")
    )
    fields = items.withColumn("f", F.from_json("item", FIELD)).select(
        "file", "def_order", "message", "ord", *field_columns(F.col("f"))
    )
    return messages, fields, errors


def _check_struct(c: Column) -> Column:
    defaults = {
        "checkHeader": False, "headerByteOffset": 0, "headerLength": 0, "headerInputMode": "HEX",
        "expectedHeaderText": "", "checkTerminator": False, "terminatorByteOffset": -1, "terminatorLength": 0,
        "terminatorInputMode": "HEX", "expectedTerminatorText": "", "checkChecksum": False, "checksumAlgorithm": "XOR",
        "checksumRangeStart": 0, "checksumRangeEnd": 0, "checksumByteOffset": 0, "checksumLength": 1,
        "checkRefreshRate": False, "expectedRefreshRateHz": 0.0, "refreshRateToleranceHz": 1.0,
        "checkEndianness": False, "expectedEndianness": "BIG", "checkDataLength": False, "dataLengthByteOffset": 0,
        "dataLengthSize": 2, "dataLengthAdjust": 0, "checkMessageId": False, "messageIdByteOffset": 0,
        "messageIdSize": 2,
    }
    parts = [_or(c[k], v).alias(k) for k, v in defaults.items()]
    parts += [_hex_bytes(c[f"expected{s}Hex"]).alias(f"expected{s}") for s in ("Header", "Terminator")]
    parts.append(_u64(_or(c["expectedMessageId"], "0")).alias("expectedMessageId"))
    return F.struct(*parts)


def read_field_catalog(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """Fields and warnings of field-list JSON files (four shapes)."""
    return parse_field_catalog(_files(spark, paths))


def parse_field_catalog(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for texts already in a table (file, value)."""
    kind = _kind(F.col("value"))
    own = F.get_json_object("value", "$.fields")
    first = F.get_json_object("value", "$.messages[0].fields")
    text = (
        F.when((kind == "object") & own.startswith("["), own)
        .when((kind == "object"), first)
        .when(kind == "array", F.col("value"))
    )
    listed = F.from_json(text, "array<string>")
    items = files.select("file", F.posexplode(listed).alias("ord", "item"))
    is_object = F.coalesce(F.ltrim("item").startswith("{"), F.lit(False))
    parsed = items.filter(is_object).withColumn("f", F.from_json("item", FIELD)).select(
        "file", "ord", *field_columns(F.col("f"))
    )
    blank = F.trim("name") == ""
    fields = parsed.withColumn("_blank", blank).withColumn(
        "name", F.when(blank, F.concat(F.lit("field_"), F.col("ord") + 1)).otherwise(F.col("name"))
    )
    skipped = items.filter(~is_object).select(
        "file", "ord", F.format_string("item %d is not an object; skipped", F.col("ord") + 1).alias("warning")
    )
    renamed = fields.filter("_blank").select(
        "file", "ord", F.format_string("field %d had a blank name", F.col("ord") + 1).alias("warning")
    )
    none = (
        files.join(fields.select("file").distinct(), "file", "left_anti")
        .select("file", F.lit(-1).alias("ord"), F.when(kind == "invalid", "invalid JSON").otherwise("no usable fields").alias("warning"))
    )
    return fields.drop("_blank"), skipped.unionByName(renamed).unionByName(none)


# Header texts accepted for each column of a field sheet.
SHEET_HEADERS = {
    "name": ("name", "fieldname", "field name"),
    "offset": ("byteoffset", "byte offset", "offset"),
    "type": ("datatype", "data type", "type"),
    "length": ("length", "len", "bytes"),
    "resolution": ("resolution", "scale"),
    "expression": ("resolutionexpression", "resolution expression", "expression"),
    "send_value": ("value", "sendvalue", "send value"),
    "endianness": ("endianness", "endian", "byteorder", "byte order"),
}


def sheet_columns(names: list[str]) -> dict[str, str]:
    """Role to column name; the last column with an accepted header wins."""
    out = {}
    for n in names:
        for role, accepted in SHEET_HEADERS.items():
            if n.strip().lower() in accepted:
                out[role] = n
    missing = [r for r in ("name", "offset", "type") if r not in out]
    if missing:
        raise ValueError("a field sheet needs Name, ByteOffset and DataType columns")
    return out


def read_field_sheets(
    rows: DataFrame, sheet: str = "file", row: str = "row", payload_len: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Fields and row errors of tabular field lists; a sheet with any error yields no fields.

    ``rows`` has one row per line with its ``sheet`` key and 1-based ``row``
    (the header is row 1). Names count as duplicates in row order.
    """
    roles = sheet_columns([c for c in rows.columns if c not in (sheet, row)])
    cell = {r: F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for r, c in roles.items()}
    for r in SHEET_HEADERS:
        cell.setdefault(r, F.lit(""))
    cells = rows.select(sheet, row, *[c.alias(f"_{r}") for r, c in cell.items()]).filter(
        "not (_name = '' and _offset = '' and _type = '')"
    )
    # A name repeats when an earlier row of the sheet holds it: compare with the first row.
    first = cells.filter("_name <> ''").groupBy(sheet, "_name").agg(F.min(row).alias("_first"))
    staged = cells.join(first, [sheet, "_name"], "left")
    offset = F.when(F.col("_offset").rlike("^[+-]?[0-9]{1,9}$"), F.col("_offset")).try_cast("int")
    kind = type_from_alias(F.col("_type"))
    length = F.when(F.col("_length").rlike("^[+-]?[0-9]{1,9}$"), F.col("_length")).try_cast("int")
    staged = staged.withColumns({"_off": offset, "_kind": kind, "_given": length})
    natural = natural_length(F.col("_kind"))
    size = F.when(F.col("_length") == "", F.nullif(natural, F.lit(0))).otherwise(F.col("_given"))
    resolution = F.when(F.col("_resolution") == "", F.lit(1.0)).otherwise(F.col("_resolution").try_cast("double"))
    staged = staged.withColumns({"_size": size, "_res": resolution})
    over = (
        F.lit(payload_len > 0)
        & ((F.col("_off") - 1 < 0) | (F.col("_off") - 1 + F.col("_size") > payload_len))
    )
    error = (
        F.when(F.col("_name") == "", "name is empty")
        .when(F.col(row) > F.col("_first"), "duplicate name")
        .when(F.col("_off").isNull() | (F.col("_off") < 0), "byte offset must be a non-negative integer")
        .when(F.col("_kind").isNull(), "unknown data type")
        .when((F.col("_length") == "") & F.col("_size").isNull(), "length is required")
        .when(F.col("_size").isNull() | (F.col("_size") < 1), "length must be a positive integer")
        .when(F.col("_res").isNull(), "resolution must be a number")
        .when(over, "exceeds payload length")
    )
    judged = staged.withColumn("error", error)
    errors = judged.filter("error is not null").select(sheet, row, F.col("_name").alias("name"), "error")
    fields = judged.join(errors.select(sheet).distinct(), sheet, "left_anti").select(
        sheet,
        row,
        F.col("_name").alias("name"),
        F.col("_off").alias("offset"),
        (F.col("_off") - 1).alias("off0"),
        F.col("_size").alias("len"),
        F.col("_kind").alias("type"),
        F.col("_res").alias("resolution"),
        F.when(F.col("_expression") == "", "1").otherwise(F.col("_expression")).alias("expression"),
        F.col("_send_value").alias("send_value"),
        F.lower("_endianness").isin("little", "le", "lsb", "little-endian").alias("little"),
    )
    return fields, errors


#: Columns that a CSV sheet may have; the format's own columns are eight.
SHEET_WIDTH = 256


def sheets_by_header(cells: DataFrame, sheet: str, row: str, values: str) -> DataFrame:
    """Rows (sheet, row, cells as an array, its first row the header) with one column per sheet role.

    Every sheet is read by its own header, so sheets may order, name and omit
    columns as they like; the last column with an accepted header counts.
    """
    head = cells.filter(F.col(row) == 1).select(sheet, F.transform(values, lambda c: F.lower(F.trim(c))).alias("_head"))

    def place(accepted: tuple[str, ...]) -> Column:
        hits = F.filter(F.transform("_head", lambda h, i: F.when(h.isin(*accepted), i)), lambda i: i.isNotNull())
        return F.array_max(hits)

    placed = head.select(sheet, *[place(a).alias(f"_at_{r}") for r, a in SHEET_HEADERS.items()])
    data = cells.filter(F.col(row) > 1).join(placed, sheet)
    return data.select(sheet, row, *[F.get(F.col(values), F.col(f"_at_{r}")).alias(r if r != "send_value" else "value") for r in SHEET_HEADERS])


def read_csv_sheets(spark: SparkSession, paths, payload_len: int = 0) -> tuple[DataFrame, DataFrame]:
    """CSV field sheets: each file is one sheet, the layout of one message, with a header of its own.

    A sheet without a name, offset or type column has only rows in error.
    """
    names = [f"c{i}" for i in range(SHEET_WIDTH)]
    raw = spark.read.option("multiLine", True).schema(", ".join(f"{n} string" for n in names)).csv(paths)
    keyed = raw.select(F.array(*names).alias("_cells"), F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_id"))
    lines = F.row_number().over(Window.partitionBy("_file").orderBy("_id"))
    by_role = sheets_by_header(keyed.withColumn("_row", lines), "_file", "_row", "_cells")
    return read_field_sheets(by_role, "_file", "_row", payload_len)
