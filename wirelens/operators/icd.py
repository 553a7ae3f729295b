"""Message definitions mined from grids of text cells (interface documents).

Input rows: doc, table_idx, heading, row_idx, cells. Tables are small, their
number is not: everything is keyed by (doc, table_idx).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens.functions.bind import bind
from wirelens.functions.text import natural_length, strip, type_from_alias, type_from_label, type_label
from wirelens.sources.work import written

TABLE = ["doc", "table_idx"]
# Words that mark a header cell of each role.
NAME_WORDS = ("name", "field", "parameter", "signal", "mnemonic", "label")
OFFSET_WORDS = ("offset", "position", "byte", "address", "loc")
TYPE_WORDS = ("type", "format", "encoding")
LENGTH_WORDS = ("length", "len", "size", "width", "bytes", "octet")
RESOLUTION_WORDS = ("resolution", "scale", "lsb", "factor")
EXPRESSION_WORDS = ("expression", "formula", "conversion", "equation", "scaling")
ALL_WORDS = NAME_WORDS + OFFSET_WORDS + TYPE_WORDS + LENGTH_WORDS + RESOLUTION_WORDS + EXPRESSION_WORDS
# Words that mark a repeated header row inside a table.
REPEATED_WORDS = (
    "name", "field", "parameter", "signal", "mnemonic", "offset", "position", "byte", "type", "format",
    "encoding", "length", "len", "size", "resolution", "scale", "expression",
)
HEADER_SCAN_ROWS = 6
CHUNK = 4096


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(text, F.lit("")).rlike("|".join(words))


def _clean(cell: Column) -> Column:
    return F.lower(strip(F.coalesce(cell, F.lit(""))))


def _squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, "\\s+", " "))


def leading_int(text: Column) -> Column:
    """First integer of a cell; ``0x`` starts a hex number; NULL when none fits an int."""
    t = strip(text)
    is_hex = t.rlike("^0[xX][0-9A-Fa-f]{1,8}$")
    from_hex = F.conv(F.when(is_hex, F.substr(t, F.lit(3))), 16, 10).try_cast("int")
    return F.coalesce(from_hex, F.nullif(F.regexp_extract(t, "(-?[0-9]+)", 1), F.lit("")).try_cast("int"))


def cell_at(index: Column) -> Column:
    """Trimmed cell of a mapped column, blank when not mapped or absent."""
    return strip(F.coalesce(F.when(index >= 0, F.get("cells", index)), F.lit("")))


def header_row(rows: DataFrame) -> DataFrame:
    """Per table: the first of the leading rows with most header cells, and the column count."""
    score = F.size(F.filter("cells", lambda c: _has(_clean(c), ALL_WORDS)))
    lead = F.when(F.col("row_idx") < HEADER_SCAN_ROWS, F.struct(score.alias("s"), (-F.col("row_idx")).alias("r")))
    best = rows.groupBy(*TABLE).agg(
        F.max(lead).alias("_b"),
        F.max(F.size("cells")).alias("n_cols"),
        F.max("row_idx").alias("last_row"),
        F.first("heading", True).alias("heading"),
    )
    return best.select(*TABLE, (-F.col("_b.r")).alias("header_row"), "n_cols", "last_row", "heading")


def table_summary(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Mergeable summaries of all columns from one aggregate of the rows: (doc, table_idx, col, seg, ...).

    Each of the leading rows, one of which is the header, is a segment of its
    own, later rows are segments of up to ``chunk``. Counts and ranges add up in
    any order; distinct cells are kept as hashes and order as "sorted inside, and
    from lowest to highest", so that neither needs the rows again or a window
    over a table. Rows after the header are the segments after its own.
    """
    cells = rows.select(*TABLE, "row_idx", "heading", F.size("cells").alias("_n"), F.posexplode_outer("cells").alias("col", "_raw"))
    read = bind(cells, {"_text": strip(F.col("_raw"))})
    filled = F.col("_text") != ""
    read = bind(
        read,
        {
            "_v": F.when(filled, leading_int(F.col("_text"))),
            "_typed": F.coalesce(filled & type_from_alias(F.col("_text")).isNotNull(), F.lit(False)),
            "_title": F.when(F.col("row_idx") < HEADER_SCAN_ROWS, _clean(F.col("_raw"))),
            "seg": F.when(F.col("row_idx") < HEADER_SCAN_ROWS, F.col("row_idx")).otherwise(F.floor(F.col("row_idx") / chunk) + HEADER_SCAN_ROWS).cast("bigint"),
        },
    )
    order = F.collect_list(F.when(F.col("_v").isNotNull(), F.struct("row_idx", F.col("_v").alias("v"))))
    sums = read.groupBy(*TABLE, "col", "seg").agg(
        F.max("_n").alias("n_cols"),
        F.max("row_idx").alias("last_row"),
        F.first("heading", True).alias("heading"),
        F.max("_title").alias("title"),
        F.count_if(_has(F.col("_title"), ALL_WORDS)).alias("hits"),
        F.count_if(filled).alias("non_empty"),
        F.count("_v").alias("numeric"),
        F.count_if("_typed").alias("type_like"),
        F.min("_v").alias("min_int"),
        F.max("_v").alias("max_int"),
        F.sum(F.when(filled, F.length("_text"))).alias("text_len"),
        F.collect_set(F.when(filled, F.xxhash64("_text"))).alias("cells"),
        F.transform(F.array_sort(order), lambda x: x["v"]).alias("_in_order"),
    )
    return sums.withColumn("falls", F.col("_in_order") != F.array_sort("_in_order")).drop("_in_order")


def summary_headers(summary: DataFrame) -> DataFrame:
    """``header_row``'s table from the summaries."""
    by_row = summary.groupBy(*TABLE, "seg").agg(
        F.sum("hits").alias("_s"), F.max("n_cols").alias("n_cols"), F.max("last_row").alias("last_row"), F.first("heading", True).alias("heading")
    )
    lead = F.when(F.col("seg") < HEADER_SCAN_ROWS, F.struct(F.col("_s").alias("s"), (-F.col("seg")).alias("r")))
    best = by_row.groupBy(*TABLE).agg(
        F.max(lead).alias("_b"), F.max("n_cols").alias("n_cols"), F.max("last_row").alias("last_row"), F.first("heading", True).alias("heading")
    )
    return best.select(*TABLE, (-F.col("_b.r")).cast("int").alias("header_row"), "n_cols", "last_row", "heading")


def summary_profile(summary: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """``column_profile``'s table from the summaries."""
    headers = summary_headers(summary) if headers is None else headers
    keyed = summary.filter("col IS NOT NULL").drop("n_cols", "last_row", "heading").join(headers.select(*TABLE, "header_row"), TABLE)
    data = F.col("seg") > F.col("header_row")
    before = Window.partitionBy(*TABLE, "col").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("_top", F.max(F.when(data, F.col("max_int"))).over(before))
    falls = F.coalesce(F.col("falls"), F.lit(False)) | F.coalesce(F.col("min_int") < F.col("_top"), F.lit(False))

    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.when(data, F.col(c))), F.lit(0)).alias(c)

    distinct = F.size(F.array_distinct(F.flatten(F.collect_list(F.when(data, F.col("cells")))))).cast("bigint")
    return keyed.groupBy(*TABLE, "col").agg(
        F.coalesce(F.max(F.when(F.col("seg") == F.col("header_row"), F.col("title"))), F.lit("")).alias("header"),
        total("non_empty"),
        total("numeric"),
        total("type_like"),
        distinct.alias("distinct"),
        F.min(F.when(data, F.col("min_int"))).alias("min_int"),
        F.max(F.when(data, F.col("max_int"))).alias("max_int"),
        (~F.coalesce(F.bool_or(data & falls), F.lit(False))).alias("non_decreasing"),
        total("text_len"),
    )


def column_profile(rows: DataFrame, headers: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """Per column: counts, numeric range, order, type words and text length of the data rows."""
    return summary_profile(table_summary(rows, chunk), headers)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def column_roles(profile: DataFrame, default_base: int = 1) -> DataFrame:
    """One row per table: the column of each role (-1 when none) and the offset base.

    Four dependent choices over one partitioning; the earliest column wins ties.
    """
    w = Window.partitionBy(*TABLE)
    none = F.lit(-1)

    def winner(condition: Column, score: Column) -> Column:
        best = F.max(F.when(condition, F.struct(score.cast("double").alias("s"), (-F.col("col")).alias("c")))).over(w)
        return F.coalesce(-best["c"], none)

    n = F.col("non_empty")
    tf, nf, df = _share(F.col("type_like"), n), _share(F.col("numeric"), n), _share(F.col("distinct"), n)
    type_header = _has(F.col("header"), TYPE_WORDS)
    type_score = tf + type_header.cast("int") * 0.5
    out = profile.withColumn("type_col", winner((n >= 1) & ((tf >= 0.5) | type_header) & (type_score > 0), type_score))
    numbers = (F.col("col") != F.col("type_col")) & (n >= 1) & (nf >= 0.6)
    offset_score = (
        _has(F.col("header"), OFFSET_WORDS).cast("int") * 100.0
        + (F.col("max_int").cast("double") - F.col("min_int"))
        + F.col("non_decreasing").cast("int") * 5.0
        + df
    )
    length_score = (
        _has(F.col("header"), LENGTH_WORDS).cast("int") * 100.0 + (F.col("max_int") <= 64).cast("int") * 5.0 + (1.0 - df)
    )
    out = out.withColumns({"offset_col": winner(numbers, offset_score), "_len": winner(numbers, length_score)})
    out = out.withColumn("length_col", F.when(F.col("_len") == F.col("offset_col"), none).otherwise(F.col("_len")))
    free = ~F.col("col").isin(F.col("type_col"), F.col("offset_col"), F.col("length_col"))
    average = _share(F.col("text_len"), n)
    name_score = (
        _has(F.col("header"), NAME_WORDS).cast("int") * 100.0
        - nf * 20.0
        + df * 10.0
        + F.least(average, F.lit(40.0)) * 0.1
        - F.col("col") * 0.01
    )
    out = out.withColumn("name_col", winner(free & (n >= 1), name_score))
    free = free & (F.col("col") != F.col("name_col"))

    def earliest(condition: Column) -> Column:
        return F.coalesce(F.min(F.when(condition, F.col("col"))).over(w), none)

    out = out.withColumn("resolution_col", earliest(free & _has(F.col("header"), RESOLUTION_WORDS)))
    out = out.withColumn(
        "expression_col",
        earliest(free & (F.col("col") != F.col("resolution_col")) & _has(F.col("header"), EXPRESSION_WORDS)),
    )
    roles = ["name_col", "offset_col", "type_col", "length_col", "resolution_col", "expression_col"]
    smallest = F.max(F.when(F.col("col") == F.col("offset_col"), F.col("min_int")))
    return out.groupBy(*TABLE).agg(
        *[F.first(r).alias(r) for r in roles],
        F.when(smallest.isin(0, 1), smallest).otherwise(default_base).alias("offset_base"),
    )


def table_groups(headers: DataFrame) -> DataFrame:
    """Parent table and place in the group of each table (gaps and islands over a document)."""
    w = Window.partitionBy("doc").orderBy("table_idx")
    title = _clean(F.col("heading"))
    continues = (
        (F.col("table_idx") == F.lag("table_idx").over(w) + 1)
        & (F.col("n_cols") > 0)
        & (F.col("n_cols") == F.lag("n_cols").over(w))
        & ((title == "") | F.contains(title, F.lit("cont")))
    )
    marked = headers.withColumn("_own", F.when(~F.coalesce(continues, F.lit(False)), F.col("table_idx")))
    parents = marked.withColumn("parent_idx", F.max("_own").over(w)).drop("_own")
    place = F.row_number().over(Window.partitionBy("doc", "parent_idx").orderBy("table_idx")) - 1
    return parents.withColumn("seq", place)


def rebase_offsets(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Byte shift of every table of a group.

    ``tables`` has keys, seq, low (smallest offset, NULL when none) and extent
    (largest end, NULL when none), both relative to the table. A later table
    that restarts below the running extent is appended after it.
    """
    parts = F.array_sort(F.collect_list(F.struct("seq", "low", "extent")))
    start = F.struct(F.lit(0).cast("int").alias("run"), F.array().cast("array<struct<seq:int,shift:int>>").alias("out"))

    def step(acc, t):
        restart = (t["seq"] > 0) & t["low"].isNotNull() & (t["low"] < acc["run"])
        shift = F.when(restart, acc["run"]).otherwise(0).cast("int")
        end = F.greatest(acc["run"], shift + F.coalesce(t["extent"], F.lit(0))).cast("int")
        row = F.struct(t["seq"].cast("int").alias("seq"), shift.alias("shift"))
        return F.struct(end.alias("run"), F.array_append(acc["out"], row).alias("out"))

    folded = tables.groupBy(*keys).agg(F.aggregate(parts, start, step).alias("_f"))
    return folded.select(*keys, F.col("_f.run").alias("group_extent"), F.inline("_f.out"))


def unique_names(df: DataFrame, keys: list[str], order: str, name: str, fold_case: bool = False) -> DataFrame:
    """Replace repeated names by ``name_2``, ``name_3``..., skipping names already used.

    Repeats are numbered by rank. Names can only clash inside a family: equal
    but for numbers at their end (``a``, ``a_2``, ``a_2_3``). Only families where
    a name looks like the numbered form of a repeated one are gone through in
    order, each by itself.
    """
    key = F.lower(F.col(name)) if fold_case else F.col(name)
    same = Window.partitionBy(*[f"`{k}`" for k in keys], "_k")
    ranked = df.withColumn("_k", key).withColumn("_n", F.row_number().over(same.orderBy(order)))
    ranked = ranked.withColumn("_many", F.count("*").over(same)).withColumn("_family", F.regexp_replace("_k", "(_[0-9]+)+$", ""))
    # a name that is another's numbered form, once for each name it may be numbered from
    base = F.regexp_extract("_k", "^(.*)_[0-9]+$", 1)
    suffixed = ranked.filter(base != "").select(*keys, base.alias("_k")).distinct()
    repeated = ranked.filter("_many > 1").select(*keys, "_k", "_family").distinct()
    clashing = repeated.join(suffixed, [*keys, "_k"]).select(*keys, "_family").distinct()
    marked = ranked.join(clashing.withColumn("_clash", F.lit(True)), [*keys, "_family"], "left")
    plain = marked.filter("_clash IS NULL").withColumn(name, F.when(F.col("_n") > 1, F.concat(name, F.lit("_"), "_n")).otherwise(F.col(name)))
    return plain.select(*df.columns).unionByName(_numbered(marked.filter("_clash"), df.columns, keys, order, name))


class _FreeNames:
    """Names of one family in order; the next free number of a name is where its last search ended.

    Names are only ever taken, so each search goes on from there, and all
    searches of a family together pass each taken name once.
    """

    def __init__(self):
        self.used: set[str] = set()
        self.next: dict[str, int] = {}

    def take(self, name: str, key: str) -> str:
        if key in self.used:
            n = self.next.get(key, 2)
            while f"{key}_{n}" in self.used:
                n += 1
            self.next[key] = n + 1
            name, key = f"{name}_{n}", f"{key}_{n}"
        self.used.add(key)
        return name


def _numbered(rows: DataFrame, columns: list[str], keys: list[str], order: str, name: str) -> DataFrame:
    """Rows of clashing families with free names; a task streams its families in order and holds one family's names."""
    place = columns.index(name)
    tags = [*keys, "_family"]
    staged = rows.select(*[F.col(f"`{c}`") for c in columns], F.to_json(F.struct(*[F.col(f"`{t}`") for t in tags])).alias("_tag"), "_k")

    def work(batches):
        import pyarrow as pa

        tag, names = None, _FreeNames()
        for batch in batches:
            chosen = []
            for own, key, text in zip(batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist(), batch.column(place).to_pylist(), strict=True):
                if own != tag:
                    tag, names = own, _FreeNames()
                chosen.append(names.take(text, key))
            held = batch.columns[: len(columns)]
            held[place] = pa.array(chosen, held[place].type)
            yield pa.RecordBatch.from_arrays(held, columns)

    sorted_rows = staged.repartition("_tag").sortWithinPartitions("_tag", order)
    return sorted_rows.mapInArrow(work, rows.select(*[F.col(f"`{c}`") for c in columns]).schema)


def offsets_from_size(df: DataFrame, keys: list[str], order: str, size: str, start: int = 1) -> DataFrame:
    """1-based offsets as the running sum of known sizes; an unknown size gives NULL."""
    from wirelens.operators.scan import running

    known = F.coalesce(F.when(F.col(size) > 0, F.col(size)), F.lit(0)).cast("bigint")
    out = running(df, keys, order, {"_before": ("sum", known)})
    return out.withColumn("offset", F.when(F.col(size) > 0, F.col("_before") + start)).drop("_before")


def _mapped_rows(rows: DataFrame, mapping: DataFrame | None) -> DataFrame:
    """Rows with the mapping, group and data start of their table; children use the parent's mapping."""
    if mapping is None:
        # small rows for each column and segment, which headers, profile and roles are made of
        summary = written(table_summary(rows), "summary")
        headers = summary_headers(summary)
        mapping = column_roles(summary_profile(summary, headers))
    else:
        headers = header_row(rows)
    groups = table_groups(headers)
    parents = mapping.withColumnRenamed("table_idx", "parent_idx").join(
        headers.select("doc", F.col("table_idx").alias("parent_idx"), F.col("header_row").alias("parent_header")),
        ["doc", "parent_idx"],
    )
    # One small row per table, used by every later step: kept rather than recomputed.
    placed = written(groups.select(*TABLE, "parent_idx", "seq").join(parents, ["doc", "parent_idx"]), "placed")
    joined = rows.select(*TABLE, "row_idx", "cells").join(placed, TABLE)
    first = F.when(F.col("seq") == 0, F.col("parent_header") + 1).otherwise(0)
    return joined.filter(F.col("row_idx") >= first)


def _order_key() -> Column:
    return F.col("seq").cast("bigint") * (1 << 32) + F.col("row_idx")


def strict_fields(rows: DataFrame, mapping: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Fields of rows with a name, a numeric offset and a known type; and warnings."""
    data = _mapped_rows(rows, mapping)
    name = cell_at(F.col("name_col"))
    data = data.withColumns(
        {
            "name": _squeeze(name),
            "_raw": leading_int(cell_at(F.col("offset_col"))),
            "_type": cell_at(F.col("type_col")),
            "_len": cell_at(F.col("length_col")),
            "_res": cell_at(F.col("resolution_col")),
            "_expr": cell_at(F.col("expression_col")),
        }
    ).filter((F.col("name") != "") & F.col("_raw").isNotNull())
    data = data.withColumns(
        {
            "_off": F.col("_raw") - F.when(F.col("offset_base") == 1, 1).otherwise(0),
            "type": type_from_alias(F.col("_type")),
            "_given": leading_int(F.col("_len")),
            "_number": F.col("_res").try_cast("double"),
        }
    )
    natural = natural_length(F.col("type"))
    size = F.when(F.col("_len") == "", F.nullif(natural, F.lit(0))).otherwise(F.when(F.col("_given") >= 1, F.col("_given")))
    data = data.withColumn("len", size)
    reject = (
        F.when(F.col("type").isNull(), "unknown type; row skipped")
        .when((F.col("_len") == "") & F.col("len").isNull(), "length is required; row skipped")
        .when(F.col("len").isNull(), "length is invalid; row skipped")
        .when(F.col("_off") < 0, "offset is out of range; row skipped")
    )
    notes = F.array_compact(
        F.array(
            reject,
            F.when(reject.isNull() & (F.col("type") != "String") & (F.col("len") > 8), "longer than 8 bytes for a number"),
            F.when(reject.isNull() & (F.col("_res") != "") & F.col("_number").isNull(), "resolution is not numeric; 1 used"),
            F.when(reject.isNull() & (F.col("_number") <= 0), "resolution must be positive; 1 used"),
        )
    )
    used = [*TABLE, "parent_idx", "seq", "row_idx", "name", "_off", "len", "type", "_number", "_expr"]
    # every later step reads this table instead of the rows
    judged = written(data.select(*used, reject.alias("_reject"), notes.alias("_notes")), "judged")
    warnings = judged.select(*TABLE, "row_idx", "name", F.explode("_notes").alias("warning"))
    kept = judged.filter("_reject is null")
    end = F.when(F.col("_reject").isNull(), F.col("_off") + F.col("len"))
    reach = judged.filter("_off >= 0").groupBy("doc", "parent_idx", "seq").agg(F.min("_off").alias("low"), F.max(end).alias("extent"))
    shifts = rebase_offsets(reach, ["doc", "parent_idx"])
    moved = kept.join(shifts.select("doc", "parent_idx", "seq", "shift"), ["doc", "parent_idx", "seq"])
    fields = moved.select(
        "doc",
        "parent_idx",
        _order_key().alias("_ord"),
        "name",
        (F.col("_off") + F.col("shift")).alias("off0"),
        "len",
        "type",
        F.when(F.col("_number") > 0, F.col("_number")).otherwise(1.0).alias("resolution"),
        F.when(F.col("_expr") == "", "1").otherwise(F.col("_expr")).alias("expression"),
    )
    named = unique_names(fields, ["doc", "parent_idx"], "_ord", "name")
    place = F.row_number().over(Window.partitionBy("doc", "parent_idx").orderBy("_ord")) - 1
    return named.withColumn("ord", place).drop("_ord"), warnings


def payload_extent(fields: DataFrame) -> DataFrame:
    """Payload length of each group: the furthest field end."""
    return fields.groupBy("doc", "parent_idx").agg(F.max(F.col("off0") + F.col("len")).alias("payload_len"))


def message_names(rows: DataFrame, custom: str | None = None) -> DataFrame:
    """Unique message name per group: custom text, else the heading, else ``Message_<n>``."""
    headers = header_row(rows)
    parents = table_groups(headers).filter("seq = 0").select("doc", F.col("table_idx").alias("parent_idx"), "heading")
    fallback = F.concat(F.lit("Message_"), F.col("parent_idx") + 1)
    wanted = F.lit(custom.strip()) if custom is not None else strip(F.coalesce(F.col("heading"), F.lit("")))
    named = parents.select("doc", "parent_idx", _squeeze(F.coalesce(F.nullif(wanted, F.lit("")), fallback)).alias("message"))
    return unique_names(named, ["doc"], "parent_idx", "message")


def strict_messages(rows: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Mined messages: doc, parent_idx, message, payload_len, n_fields."""
    fields, _ = strict_fields(rows, mapping)
    sizes = fields.groupBy("doc", "parent_idx").agg(
        F.max(F.col("off0") + F.col("len")).alias("payload_len"), F.count(F.lit(1)).alias("n_fields")
    )
    return message_names(rows).join(sizes, ["doc", "parent_idx"], "left").fillna({"payload_len": 0, "n_fields": 0})


def looks_like_header() -> Column:
    """A repeated header row: two header words, or all of name, offset and type titles."""
    hits = F.size(F.filter("cells", lambda c: _has(_clean(c), REPEATED_WORDS)))
    name, off, kind = (_clean(cell_at(F.col(c))) for c in ("name_col", "offset_col", "type_col"))
    titled = (
        _has(name, ("name", "field")) & _has(off, ("offset", "byte", "position")) & _has(kind, ("type", "format", "encoding"))
    )
    return (hits >= 2) | titled


def loose_fields(
    rows: DataFrame,
    mapping: DataFrame | None = None,
    from_size: bool = False,
    start_byte: int = 1,
    description_col: int = -1,
) -> tuple[DataFrame, DataFrame]:
    """Review drafts: every row that is not blank or a repeated header, with bad cells blanked.

    Drafts carry NULL for a blank cell. ``from_size`` derives offsets from the
    sizes of the whole group instead of the offset column.
    """
    data = _mapped_rows(rows, mapping)
    data = data.filter(F.exists("cells", lambda c: strip(c) != "") & ~looks_like_header())
    data = data.withColumns(
        {
            "name": F.nullif(_squeeze(cell_at(F.col("name_col"))), F.lit("")),
            "_offt": cell_at(F.col("offset_col")),
            "_lent": cell_at(F.col("length_col")),
            "_typet": cell_at(F.col("type_col")),
            "_rest": cell_at(F.col("resolution_col")),
            "_expr": cell_at(F.col("expression_col")),
            "description": cell_at(F.lit(description_col)),
            "_ord": _order_key(),
        }
    )
    given = leading_int(F.col("_lent"))
    raw = leading_int(F.col("_offt")) - F.when(F.col("offset_base") == 1, 1).otherwise(0)
    number = F.col("_rest").try_cast("double")
    data = data.withColumns(
        {
            "len": F.when(given >= 1, given),
            "_off": F.when(raw >= 0, raw),
            "resolution": F.when(number > 0, number),
        }
    )
    data = data.withColumn("type", F.when(F.col("_typet") != "", type_from_label(F.col("_typet"), F.coalesce("len", F.lit(0)))))
    key = ["doc", "parent_idx"]
    if from_size:
        placed = offsets_from_size(data, key, "_ord", "len", start_byte)
    else:
        tables = data.groupBy(*key, "seq").agg(
            F.min("_off").alias("low"), F.max(F.col("_off") + F.col("len")).alias("extent")
        )
        shifts = rebase_offsets(tables, key).select(*key, "seq", "shift")
        placed = data.join(shifts, key + ["seq"]).withColumn("offset", F.col("_off") + F.col("shift") + 1)
    notes = F.array_compact(
        F.array(
            F.when((F.col("_lent") != "") & F.col("len").isNull(), "length is invalid; left empty"),
            F.when(F.lit(from_size) & F.col("len").isNull(), "size unknown; offset left empty"),
            F.when(F.lit(not from_size) & (F.col("_offt") != "") & F.col("_off").isNull(), "offset is invalid; left empty"),
            F.when((F.col("_typet") != "") & F.col("type").isNull(), "type is not recognised; left empty"),
            F.when((F.col("_rest") != "") & F.col("resolution").isNull(), "resolution is invalid; left empty"),
            F.when(F.col("name").isNull(), "name is empty"),
            F.when((F.col("offset_col") < 0) & F.lit(not from_size), "offset column not mapped"),
            F.when(F.col("type_col") < 0, "type column not mapped"),
            F.when(F.col("length_col") < 0, "length column not mapped"),
        )
    )
    noted = placed.withColumn("_notes", notes)
    warnings = noted.select(*TABLE, "row_idx", "name", F.explode("_notes").alias("warning"))
    drafts = noted.select(
        "doc",
        "parent_idx",
        "table_idx",
        "row_idx",
        F.col("_ord").alias("draft_ord"),
        "name",
        "offset",
        "len",
        "type",
        type_label(F.col("type")).alias("type_label"),
        "resolution",
        F.when(F.col("_expr") == "", "1").otherwise(F.col("_expr")).alias("expression"),
        "description",
        enum_rules(F.col("description"), F.coalesce("name", F.lit(""))).alias("enum_rule"),
    )
    return drafts, warnings


def finalise_fields(drafts: DataFrame, keys: tuple[str, ...] = ("doc", "parent_idx"), order: str = "draft_ord") -> DataFrame:
    """Drafts to fields: rows missing two of name, offset and type are skipped.

    A missing offset continues at the end of the previous kept field. Stretches
    that start at a given offset are numbered, and lengths are summed inside
    each stretch, so the fold is two window scans over one partitioning.
    """
    keys = list(keys)
    numbered = drafts.withColumn("row_no", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    no_name = F.coalesce(strip(F.col("name")), F.lit("")) == ""
    no_offset = F.coalesce(F.col("offset") < 1, F.lit(True))
    missing = no_name.cast("int") + no_offset.cast("int") + F.col("type").isNull().cast("int")
    kept = numbered.filter(missing < 2)
    kind = F.coalesce("type", F.lit("RawUnsignedBE"))
    size = F.when(F.col("len") >= 1, F.col("len")).otherwise(F.greatest(natural_length(kind), F.lit(1)))
    kept = kept.withColumns(
        {
            "name": F.when(no_name, F.concat(F.lit("field_"), F.col("row_no"))).otherwise(strip(F.col("name"))),
            "type": kind,
            "len": size,
            "_given": F.when(~no_offset, F.col("offset")),
        }
    )
    upto = Window.partitionBy(*keys).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    stretch = kept.withColumn("_stretch", F.count("_given").over(upto))
    inside = Window.partitionBy(*keys, "_stretch").orderBy("row_no")
    run = F.coalesce(F.sum("len").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.first("_given").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = stretch.withColumn("offset", (F.coalesce(first, F.lit(1)) + run).cast("int"))
    placed = placed.withColumn("resolution", F.coalesce("resolution", F.lit(1.0))).drop("_given", "_stretch")
    return unique_names(placed, keys, "row_no", "name", fold_case=True).withColumn("off0", F.col("offset") - 1)


def enum_rules(text: Column, label: Column) -> Column:
    """Bit rule mined from an enumeration in prose, or NULL.

    Value tokens (``0xNN`` or up to three digits, then a separator) start a
    meaning that runs to the next token; hex tokens outrank decimal ones; a
    meaning starts with a letter; the first meaning of a value stays.
    """
    anchor = "(?i)(0x[0-9a-f]{1,2}|\\b[0-9]{1,3})(\\s*[-=:)–—]\\s*)"
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), anchor, "\u0001$1\u0002$2\u0003")
    pieces = F.slice(F.split(marked, "\u0001", -1), 2, 1_000_000_000)

    def parse(p):
        token = F.substring_index(p, "\u0002", 1)
        is_hex = F.startswith(F.lower(token), F.lit("0x"))
        value = F.when(is_hex, F.conv(F.substr(token, F.lit(3)), 16, 10)).otherwise(token).cast("int")
        return F.struct(
            value.alias("value"),
            is_hex.alias("hex"),
            F.substring_index(p, "\u0003", -1).alias("meaning"),
            F.translate(p, "\u0002\u0003", "").alias("whole"),
        )

    parsed = F.transform(pieces, parse)
    empty = F.array().cast("array<struct<value:int,hex:boolean,meaning:string>>")

    def gather(acc, p):
        new = F.struct(p["value"].alias("value"), p["hex"].alias("hex"), p["meaning"].alias("meaning"))
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(
            last["value"].alias("value"), last["hex"].alias("hex"), F.concat(last["meaning"], p["whole"]).alias("meaning")
        )
        # Numbers above 255 are prose and belong to the meaning before them.
        return (
            F.when(p["value"] <= 255, F.array_append(acc, new))
            .when(F.size(acc) == 0, acc)
            .otherwise(F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), longer))
        )

    def let(value, use):
        """Evaluate an array once and use it by name."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def tidy(a):
        meaning = _squeeze(a["meaning"])
        short = F.when(F.length(meaning) > 120, F.concat(F.left(meaning, F.lit(117)), F.lit("..."))).otherwise(meaning)
        return F.struct(a["value"].alias("value"), a["hex"].alias("hex"), short.alias("meaning"))

    def first_of(acc, a):
        known = F.exists(acc, lambda k: k["value"] == a["value"])
        return F.when(known, acc).otherwise(F.array_append(acc, a))

    def choose(anchors):
        any_hex = F.exists(anchors, lambda a: a["hex"])
        usable = F.filter(
            F.transform(anchors, tidy), lambda a: (~any_hex | a["hex"]) & a["meaning"].rlike("^\\p{L}")
        )
        return F.when(F.size(anchors) >= 2, F.aggregate(usable, empty, first_of)).otherwise(empty)

    def rule(chosen):
        top = F.array_max(F.transform(chosen, lambda a: a["value"]))
        bits = F.greatest(F.lit(1), F.length(F.ltrim(F.bin(top.cast("bigint")), F.lit("0"))))
        pairs = F.map_from_entries(
            F.array_sort(F.transform(chosen, lambda a: F.struct(a["value"].alias("key"), a["meaning"].alias("value"))))
        )
        made = F.struct(
            F.coalesce(F.nullif(strip(label), F.lit("")), F.lit("ENUM")).alias("label"),
            F.sequence(F.lit(0), bits - 1).alias("positions"),
            pairs.alias("meanings"),
            F.lit("UNKNOWN").alias("unknown"),
            F.lit(True).alias("enabled"),
            F.lit(False).alias("reserved"),
        )
        return F.when(F.size(chosen) >= 2, made)

    return let(let(F.aggregate(parsed, empty, gather), choose), rule)
