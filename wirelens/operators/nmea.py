"""Decoding, checking and building NMEA-0183 sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.functions import sentences as st
from wirelens.functions.bind import bind
from wirelens.operators.joins import lookup_join
from wirelens.plans.model import Message
from wirelens.sources.nmea_registry import kinds_of, registry_slots


def sentence_rows(df: DataFrame, keep: list[str], payload: str = "payload") -> DataFrame:
    """One row per sentence: pos, talker, formatter, checksum_ok, parts, sentence."""
    found = df.select(*keep, F.posexplode(st.split_sentences(F.col(payload))).alias("pos", "sentence"))
    bodies = bind(found, {"_body": st.sentence_body(F.col("sentence"))})
    split = bind(
        bodies,
        {"checksum_ok": st.checksum_ok(F.col("sentence")), "parts": F.split(F.col("_body"), ",", -1)},
    )
    address = F.get("parts", F.lit(0))
    return split.select(
        *keep,
        "pos",
        F.length(address).alias("address_length"),
        F.substring(address, 1, 2).alias("talker"),
        F.upper(F.substring(address, 3, 3)).alias("formatter"),
        "checksum_ok",
        "parts",
        "sentence",
    )


def sentence_fields(df: DataFrame, keep: list[str], payload: str = "payload") -> DataFrame:
    """One row per token: index (from 1) and raw token of well-addressed sentences."""
    rows = sentence_rows(df, keep, payload).filter("address_length >= 5")
    tokens = rows.select(*keep, "pos", "talker", "formatter", "checksum_ok", F.posexplode("parts").alias("idx", "raw"))
    return tokens.filter("idx >= 1")


def token_values(tokens: DataFrame, registry: DataFrame) -> DataFrame:
    """Attach kind and display text to tokens by (formatter, idx)."""
    dim = registry.select("formatter", "idx", "kind")
    joined = lookup_join(tokens, dim, ["formatter", "idx"], how="left", spread=["raw"])
    return joined.withColumn("value", st.format_token(F.col("raw"), F.coalesce("kind", F.lit("Text"))))


def nmea_rows(routed: DataFrame, message: Message, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per sentence of the message's formatter, one column per field.

    Kinds come from the registry for known formatters and from the field for
    custom ones. A token beyond the sentence is blank. A wrong checksum is only
    marked, the row is kept.
    """
    rows = routed.filter(F.col("message") == message.name) if "message" in routed.columns else routed
    meta = [c for c in ("file", "packet_no", "ts", "src_ip", "dst_ip", "src_port", "dst_port") if c in rows.columns]
    keepers = meta + [k for k in keep if k not in meta]
    wanted = message.sentence.strip().upper()
    found = sentence_rows(rows, keepers, payload).filter((F.col("address_length") >= 5) & (F.col("formatter") == wanted))
    known = kinds_of(wanted)
    columns = []
    for f in message.fields:
        token = F.get("parts", F.lit(f.nmea_index)) if f.nmea_index >= 1 else F.lit(None).cast("string")
        kind = f.nmea_kind if known is None else known.get(f.nmea_index, "Text")
        columns.append(F.coalesce(st.format_token(token, kind), F.lit("")).alias(f.name))
    return found.select(*keepers, "pos", "talker", "checksum_ok", *columns)


def nmea_warnings(df: DataFrame, keep: list[str], wanted: str | Column | None = None, payload: str = "payload") -> DataFrame:
    """Warnings of each sentence: checksum, missing checksum, address, other formatter."""
    rows = sentence_rows(df, keep, payload)
    marked = F.when(~st.has_checksum(F.col("sentence")), "missing_checksum").when(
        ~F.col("checksum_ok"), "checksum_mismatch"
    )
    other = F.when(F.col("address_length") < 5, "bad_address")
    if wanted is not None:
        target = F.lit(wanted.strip().upper()) if isinstance(wanted, str) else wanted
        other = other.when(F.col("formatter") != target, "skipped_formatter")
    listed = rows.withColumn("warning", F.explode(F.array_compact(F.array(marked, other))))
    return listed.select(*keep, "pos", "sentence", "warning")


def build_sentences(
    df: DataFrame,
    formatter: str,
    tokens: dict[int, Column],
    talker: str | Column = "GP",
    payload: str = "payload",
) -> DataFrame:
    """Add the sentence bytes and ``problems`` ("; "-joined, NULL when none).

    ``tokens`` maps comma positions (from 1) to text columns; the sentence has
    as many slots as the registry knows or the highest position used.
    """
    name = formatter.strip().upper()
    faults = []
    if not (len(name) == 3 and name.isalnum()):
        faults.append(F.lit("formatter must be 3 letters or digits"))
    who = F.upper(F.trim(talker)) if isinstance(talker, Column) else F.lit(talker.strip().upper())
    who = F.when(who == "", "GP").otherwise(who)
    faults.append(F.when(~who.rlike("^[A-Z0-9]{2}$"), "talker must be 2 letters or digits"))
    slots = max([registry_slots(name)] + [i for i in tokens])
    cells = []
    for i in range(1, slots + 1):
        if i not in tokens:
            cells.append(F.lit(""))
            continue
        token = F.nvl(F.trim(tokens[i].cast("string")), F.lit(""))
        cells.append(token)
        faults.append(F.when(token.rlike("[,*$!]"), f"token {i} contains a delimiter"))
        faults.append(F.when(token.rlike("[^\\x20-\\x7e]"), f"token {i} is not printable ASCII"))
    if any(i < 1 for i in tokens):
        faults.append(F.lit("a field has no position"))
    body = F.concat(who, F.lit(name + ("," if slots else "")), F.concat_ws(",", *cells) if cells else F.lit(""))
    bound = bind(df, {"problems": F.nullif(F.concat_ws("; ", *faults), F.lit("")), "_body": body})
    text = F.when(F.col("problems").isNull(), st.sentence_text(F.col("_body")))
    return bound.withColumn(payload, F.encode(text, "US-ASCII")).drop("_body")
