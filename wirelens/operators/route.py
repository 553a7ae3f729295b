"""Which message definitions a datagram belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.functions.sentences import formatters
from wirelens.operators.joins import BROADCAST_ROWS, is_bounded, lookup_join
from wirelens.plans.model import Message, messages_frame

KEYS = ("file", "packet_no")


def _as_frame(datagrams: DataFrame, messages) -> tuple[DataFrame, int | None]:
    if isinstance(messages, DataFrame):
        return messages, None
    return messages_frame(datagrams.sparkSession, list(messages)), len(messages)


def _formats(messages) -> set[str]:
    """Formats in use; a table is asked once, so that no branch runs for nothing."""
    if not isinstance(messages, DataFrame):
        return {"NMEA" if m.format == "NMEA" else "HEX" for m in messages}
    is_text = F.coalesce(F.col("format") == "NMEA", F.lit(False))
    row = messages.agg(F.max(is_text.cast("int")).alias("t"), F.min(is_text.cast("int")).alias("h")).first()
    return ({"NMEA"} if row.t == 1 else set()) | ({"HEX"} if row.h == 0 or row.h is None else set())


def _keys(datagrams: DataFrame, keys) -> list[str]:
    return [k for k in keys if k in datagrams.columns]


def match_pairs(
    datagrams: DataFrame,
    messages,
    keys: tuple[str, ...] = KEYS,
    use_port: bool = True,
    connection: str | None = None,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Every matching (datagram, message): the datagram's columns + message, def_order, format.

    Ports become equi keys by exploding the distinct pair of ports. Headers are
    equi keys too: the header lengths in use per (port, length) decide which
    prefixes of the payload are probed, so no datagram is compared with every
    definition of its port.
    """
    defs, rows = _as_frame(datagrams, messages)
    only = _formats(messages)
    small = rows <= max_broadcast_rows if rows is not None else is_bounded(defs, max_broadcast_rows)
    dim_rows = 0 if small else max_broadcast_rows + 1
    spread = _keys(datagrams, keys) or None
    carry = ["message", "def_order", "format"]
    side = F.array_distinct(F.array("src_port", "dst_port"))
    probe = datagrams.withColumn("_port", F.explode(side)) if use_port else datagrams
    port_key = ["_port"] if use_port else []
    links = defs.withColumn("_link", F.coalesce(F.col("connection_id"), F.lit(""))).withColumnRenamed("port", "_port")

    def linked(df: DataFrame) -> DataFrame:
        if connection is None:
            return df.drop("_link")
        source = F.coalesce(F.col(connection), F.lit(""))
        return df.filter((source == "") | (F.col("_link") == "") | (F.col("_link") == source)).drop("_link")

    parts = []
    if "HEX" in only:
        hex_defs = links.filter(F.col("format") != "NMEA").select(
            *port_key,
            F.col("payload_len").alias("_size"),
            F.coalesce(F.col("header"), F.lit(b"")).alias("_header"),
            "_link",
            *carry,
        )
        sized = probe.withColumn("_size", F.col("payload_size"))
        on = port_key + ["_size"]
        lengths = hex_defs.groupBy(*on).agg(F.collect_set(F.octet_length("_header")).alias("_lengths"))
        known = dim_rows if small else None
        probed = lookup_join(sized, lengths, on, spread=spread, dim_rows=known, max_rows=max_broadcast_rows)
        probed = probed.withColumn("_length", F.explode("_lengths")).drop("_lengths")
        probed = probed.filter(F.octet_length("payload") >= F.col("_length")).withColumn(
            "_header", F.substring(F.col("payload"), F.lit(1), F.col("_length"))
        )
        hit = lookup_join(probed.drop("_length"), hex_defs, on + ["_header"], spread=spread, dim_rows=dim_rows)
        parts.append(linked(hit).drop("_port", "_size", "_header"))
    if "NMEA" in only:
        text_defs = links.filter(F.col("format") == "NMEA").select(
            *port_key, F.upper(F.trim("sentence")).alias("_formatter"), "_link", *carry
        )
        named = probe.withColumn("_formatter", F.explode(formatters(F.col("payload"))))
        hit = lookup_join(named, text_defs, port_key + ["_formatter"], spread=spread, dim_rows=dim_rows)
        parts.append(linked(hit).drop("_port", "_formatter"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _header_lengths(messages) -> list[int]:
    """Header lengths in use; of a table the distinct lengths, never more than a payload has bytes."""
    if not isinstance(messages, DataFrame):
        return sorted({len(m.header or b"") for m in messages if m.format != "NMEA"})
    hexes = messages.filter(F.coalesce(F.col("format") != "NMEA", F.lit(True)))
    rows = hexes.select(F.octet_length(F.coalesce(F.col("header"), F.lit(b""))).alias("n")).distinct().collect()
    return sorted(r.n for r in rows)


def _route_first(datagrams: DataFrame, messages, connection: str | None, max_broadcast_rows: int) -> DataFrame:
    """The earliest matching definition by lookups alone, for any number of definitions.

    Each header length in use is one left lookup of (payload length, prefix),
    and one more with the connection where definitions are bound to one;
    sentences are looked up by formatter. The least definition order of all
    lookups wins. Nothing is aggregated over datagrams and they need no keys, so
    NULL and repeated keys survive and a stream works like a table.
    """
    defs, rows = _as_frame(datagrams, messages)
    small = rows <= max_broadcast_rows if rows is not None else is_bounded(defs, max_broadcast_rows)
    dim_rows = 0 if small else max_broadcast_rows + 1
    only = _formats(messages)
    found = F.struct("def_order", "message", "format")
    link = F.coalesce(F.col("connection_id"), F.lit("")) if connection else F.lit("")
    is_text = F.coalesce(F.col("format") == "NMEA", F.lit(False))
    source = F.coalesce(F.col(f"`{connection}`"), F.lit("")) if connection else F.lit("")
    out = datagrams.withColumn("_source", source)
    columns: list[Column] = []

    def looked_up(df: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
        return lookup_join(df, dim, on, how="left", spread=list(datagrams.columns), dim_rows=dim_rows, max_rows=max_broadcast_rows)

    def any_or_free() -> list[Column]:
        return [F.min("_d").alias("_any"), F.min(F.when(F.col("_link") == "", F.col("_d"))).alias("_free")]

    def chosen(any_: Column, free: Column, bound: Column) -> Column:
        """An unnamed source fits every definition, a named one those bound to it or to none."""
        return F.when(F.col("_source") == "", any_).otherwise(F.least(free, bound) if connection else free)

    if "HEX" in only:
        hexes = defs.filter(~is_text).select(
            F.col("payload_len").cast("int").alias("_size"), F.coalesce(F.col("header"), F.lit(b"")).alias("_header"), link.alias("_link"), found.alias("_d")
        )
        out = out.withColumn("_size", F.octet_length("payload"))
        for n in _header_lengths(messages):
            dim = hexes.filter(F.octet_length("_header") == n)
            prefix = F.when(F.col("_size") >= n, F.substring(F.col("payload"), F.lit(1), F.lit(n)))
            out = looked_up(out.withColumn("_header", prefix), dim.groupBy("_size", "_header").agg(*any_or_free()), ["_size", "_header"])
            bound = F.lit(None)
            if connection:
                own = dim.filter("_link <> ''").groupBy("_size", "_header", F.col("_link").alias("_source")).agg(F.min("_d").alias("_bound"))
                out = looked_up(out, own, ["_size", "_header", "_source"])
                bound = F.col("_bound")
            out = out.withColumn(f"_hit{n}", chosen(F.col("_any"), F.col("_free"), bound)).drop("_any", "_free", "_bound", "_header")
            columns.append(F.col(f"_hit{n}"))
    if "NMEA" in only:
        texts = defs.filter(is_text).select(F.upper(F.trim("sentence")).alias("_f"), link.alias("_link"), found.alias("_d"))

        def table(df: DataFrame, key: Column, value: Column) -> DataFrame:
            return df.groupBy(key.alias("k")).agg(F.min(value).alias("v")).filter("v IS NOT NULL")

        free = F.when(F.col("_link") == "", F.col("_d"))
        named = F.concat_ws("\n", "_f", "_link")
        entries = (
            table(texts, F.concat(F.lit("any\n"), F.col("_f")), F.col("_d"))
            .unionByName(table(texts, F.concat(F.lit("free\n"), F.col("_f")), free))
            .unionByName(table(texts.filter("_link <> ''"), F.concat(F.lit("own\n"), named), F.col("_d")))
        )
        if not small and not is_bounded(entries):
            raise ValueError("too many sentence definitions for first matches: route them with mode 'all'")
        # one row: a map of the formatters in use, of checked size
        lookup = entries.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_map")).withColumn("_one", F.lit(1))
        out = out.withColumn("_names", formatters(F.col("payload"))).withColumn("_one", F.lit(1)).join(F.broadcast(lookup), "_one", "left")

        def earliest(*keys) -> Column:
            def hits(key) -> Column:
                return F.array_min(F.transform("_names", lambda f: F.try_element_at(F.col("_map"), key(f))))

            return F.least(*[hits(k) for k in keys]) if len(keys) > 1 else hits(keys[0])

        unbound = earliest(lambda f: F.concat(F.lit("free\n"), f))
        if connection:
            unbound = earliest(lambda f: F.concat(F.lit("free\n"), f), lambda f: F.concat(F.lit("own\n"), f, F.lit("\n"), F.col("_source")))
        every = earliest(lambda f: F.concat(F.lit("any\n"), f))
        out = out.withColumn("_text", F.when(F.col("_source") == "", every).otherwise(unbound))
        columns.append(F.col("_text"))
    best = F.least(*columns) if len(columns) > 1 else columns[0]
    out = out.withColumn("_best", best).filter(F.col("_best").isNotNull())
    return out.select(*[f"`{c}`" for c in datagrams.columns], "_best.message", "_best.def_order", "_best.format")


def route(
    datagrams: DataFrame,
    messages,
    mode: str = "all",
    keys: tuple[str, ...] = KEYS,
    connection: str | None = None,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Datagrams with their message.

    ``all`` (files): port of either side, then format, length and header; a
    datagram goes to every match. ``first`` (live): definition order decides and
    the port is not checked again; ``connection`` names the column that isolates
    definitions bound to another connection.
    """
    if mode == "all":
        return match_pairs(datagrams, messages, keys, True, connection, max_broadcast_rows)
    if mode != "first":
        raise ValueError(f"unknown routing mode {mode!r}")
    return _route_first(datagrams, messages, connection, max_broadcast_rows)


def match_lists(datagrams: DataFrame, messages, max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """``datagrams`` with ``matches``: all definitions that mode ``all`` finds, in their order, as one array per row.

    Each side's port and each header length in use is one left lookup, sentences
    are looked up by port and formatter, so rows stay where they are and need no
    keys. None when the definitions are too many to be broadcast.
    """
    defs, rows = _as_frame(datagrams, messages)
    if not (rows <= max_broadcast_rows if rows is not None else is_bounded(defs, max_broadcast_rows)):
        return None
    only = _formats(messages)
    found = F.struct("def_order", "message", "format")
    is_text = F.coalesce(F.col("format") == "NMEA", F.lit(False))
    out, lists = datagrams, []

    def looked_up(df: DataFrame, dim: DataFrame, on: list[str], name: str) -> DataFrame:
        listed = dim.groupBy(*on).agg(F.collect_set("_d").alias(name))
        return lookup_join(df, listed, on, how="left", dim_rows=0).drop(*on)

    for side in ("src_port", "dst_port"):
        if "HEX" in only:
            hexes = defs.filter(~is_text).select(
                F.col("port").alias("_port"), F.col("payload_len").alias("_size"), F.coalesce("header", F.lit(b"")).alias("_header"), found.alias("_d")
            )
            for n in _header_lengths(messages):
                name = f"_{side}_{n}"
                prefix = F.when(F.octet_length("payload") >= n, F.substring(F.col("payload"), F.lit(1), F.lit(n)))
                probe = out.withColumns({"_port": F.col(side), "_size": F.col("payload_size"), "_header": prefix})
                out = looked_up(probe, hexes.filter(F.octet_length("_header") == n), ["_port", "_size", "_header"], name)
                lists.append(name)
        if "NMEA" in only:
            texts = defs.filter(is_text).select(
                F.col("port").alias("_port"), F.upper(F.trim("sentence")).alias("_formatter"), found.alias("_d")
            )
            by_name = texts.groupBy("_port", "_formatter").agg(F.collect_set("_d").alias("_ds"))
            of_port = by_name.groupBy("_port").agg(F.map_from_entries(F.collect_list(F.struct("_formatter", "_ds"))).alias("_names"))
            out = lookup_join(out.withColumn("_port", F.col(side)), of_port, ["_port"], how="left", dim_rows=0).drop("_port")
            names = F.when(F.col("_names").isNotNull(), formatters(F.col("payload")))
            hits = F.transform(names, lambda f: F.coalesce(F.try_element_at("_names", f), F.array().cast(found_type(defs))))
            out = out.withColumn(f"_{side}_text", F.flatten(hits)).drop("_names")
            lists.append(f"_{side}_text")
    empty = F.array().cast(found_type(defs))
    every = F.concat(*[F.coalesce(F.col(c), empty) for c in lists]) if lists else empty
    return out.withColumn("matches", F.array_sort(F.array_distinct(every))).drop(*lists)


def found_type(defs: DataFrame) -> T.ArrayType:
    return T.ArrayType(T.StructType([defs.schema[c] for c in ("def_order", "message", "format")]))


def seen_messages(datagrams: DataFrame, messages, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Names of the definitions that occur, reduced before any join back."""
    return match_pairs(datagrams, messages, keys).select("message").distinct()


def messages_missing(datagrams: DataFrame, messages, keys: tuple[str, ...] = KEYS) -> DataFrame:
    defs, _ = _as_frame(datagrams, messages)
    return defs.join(seen_messages(datagrams, messages, keys), "message", "left_anti")


def messages_present(datagrams: DataFrame, messages, keys: tuple[str, ...] = KEYS) -> DataFrame:
    defs, _ = _as_frame(datagrams, messages)
    return defs.join(seen_messages(datagrams, messages, keys), "message", "left_semi")


def message_destinations(messages: DataFrame, connections: DataFrame) -> DataFrame:
    """(message, connection_id) pairs; without a known connection the first one serves."""
    single = F.when(F.coalesce(F.col("connection_id"), F.lit("")) != "", F.array("connection_id"))
    listed = F.when(F.size("connection_ids") > 0, F.col("connection_ids"))
    ids = F.coalesce(listed, single, F.array().cast("array<string>"))
    wanted = messages.select("message", F.posexplode(ids).alias("_pos", "connection_id"))
    wanted = wanted.groupBy("message", "connection_id").agg(F.min("_pos").alias("_pos"))
    known = connections.select(F.col("id").alias("connection_id")).filter("connection_id <> ''").distinct()
    bound = wanted.join(known, "connection_id").select("message", "connection_id", "_pos")
    first = connections.agg(F.min_by("id", "conn_order").alias("connection_id"))
    # A one-row relation: its value is attached through a constant equi key.
    rest = messages.select("message").join(bound.select("message").distinct(), "message", "left_anti")
    default = rest.withColumn("_one", F.lit(1)).join(F.broadcast(first.withColumn("_one", F.lit(1))), "_one")
    default = default.filter(F.col("connection_id").isNotNull()).select(
        "message", "connection_id", F.lit(0).alias("_pos")
    )
    return bound.unionByName(default).withColumnRenamed("_pos", "position")


def connection_frame_length(messages: DataFrame, connections: DataFrame) -> DataFrame:
    """The one payload length shared by the HEX messages of a connection, else 0.

    Lengths are compared along the definition list as they change, so a list
    A, B, A also counts as mixed; equal lengths throughout give that length.
    """
    link = F.coalesce(F.col("connection_id"), F.lit(""))
    # definitions without a length say nothing about the connection's
    hexes = messages.filter((F.col("format") != "NMEA") & (F.col("payload_len") > 0)).select(link.alias("_link"), "payload_len")

    def spans(df, *by):
        return df.groupBy(*by).agg(F.min("payload_len").alias("lo"), F.max("payload_len").alias("hi"))

    own = spans(hexes.filter("_link <> ''"), "_link")
    free = spans(hexes.filter("_link = ''"))
    ids = connections.select(F.col("id").alias("_link")).distinct()
    both = (
        ids.join(own, "_link", "left")
        .withColumn("_one", F.lit(1))
        .join(
            F.broadcast(free.select(F.lit(1).alias("_one"), F.col("lo").alias("flo"), F.col("hi").alias("fhi"))),
            "_one",
            "left",
        )
    )
    lo, hi = F.least("lo", "flo"), F.greatest("hi", "fhi")
    return both.select(
        F.col("_link").alias("connection_id"),
        F.when((lo == hi) & (lo > 0), lo).otherwise(0).alias("frame_length"),
    )


def header_overlaps(filters: DataFrame, header: str = "header") -> DataFrame:
    """Pairs of distinct headers where one is a proper prefix of the other.

    Each header meets only its own prefixes through an equi join, so a header
    of n bytes adds at most n pairs whatever the number of filters.
    """
    side = filters.select(F.coalesce(F.col(header), F.lit(b"")).alias("_h")).distinct()
    # the empty header is a prefix of all others: one attached value, no key that all headers share
    empty = side.filter(F.octet_length("_h") == 0).select(F.lit(1).alias("_one"), F.lit("").alias("shorter"))
    others = side.filter(F.octet_length("_h") > 0)
    of_empty = others.select(F.hex("_h").alias("longer"), F.lit(1).alias("_one")).join(F.broadcast(empty), "_one")
    prefixes = others.filter(F.octet_length("_h") > 1).select(
        F.hex("_h").alias("longer"), F.col("_h"), F.explode(F.sequence(F.lit(1), F.octet_length("_h") - 1)).alias("_n")
    )
    prefixes = prefixes.select("longer", F.hex(F.substring(F.col("_h"), F.lit(1), F.col("_n"))).alias("shorter"))
    found = prefixes.join(others.select(F.hex("_h").alias("shorter")), "shorter").select("shorter", "longer")
    return found.unionByName(of_empty.select("shorter", "longer"))


def match_signatures(messages: DataFrame) -> DataFrame:
    """Signatures shared by more than one definition."""
    is_text = F.col("format") == "NMEA"
    signature = F.when(is_text, F.concat(F.lit("NMEA:"), F.upper("sentence"))).otherwise(
        F.concat_ws(":", F.lit("HEX"), F.col("payload_len"), F.lower(F.hex(F.coalesce("header", F.lit(b"")))))
    )
    return (
        messages.withColumn("signature", signature)
        .groupBy("port", "signature")
        .agg(F.count(F.lit(1)).alias("definitions"))
        .filter("definitions > 1")
    )
