"""Run totals, per-message counts and bounded previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.functions import bytes as by
from wirelens.operators.route import KEYS, _as_frame, match_pairs

PREVIEW_ROWS = 5000
LIVE_PREVIEW_ROWS = 200


def drop_summary(dissected: DataFrame) -> DataFrame:
    """Packets per drop reason; valid datagrams count as ``valid``."""
    reason = F.coalesce(F.col("drop_reason"), F.lit("valid"))
    return dissected.groupBy(reason.alias("drop_reason")).agg(F.count(F.lit(1)).alias("packets"))


def run_summary(dissected: DataFrame, routed: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row: packets read, valid datagrams, datagrams with a match, exported rows.

    A datagram that matches several messages shows up as several routed rows;
    they are reduced per datagram key, never gathered.
    """
    keys = [k for k in keys if k in routed.columns]
    read = dissected.agg(
        F.count(F.lit(1)).alias("total_packets"),
        F.count_if(F.col("drop_reason").isNull()).alias("valid_udp"),
        F.lit(0).cast("bigint").alias("matched_packets"),
        F.lit(0).cast("bigint").alias("exported_rows"),
    )
    per_packet = routed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = per_packet.agg(
        F.lit(0).cast("bigint").alias("total_packets"),
        F.lit(0).cast("bigint").alias("valid_udp"),
        F.count(F.lit(1)).alias("matched_packets"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("exported_rows"),
    )
    names = ["total_packets", "valid_udp", "matched_packets", "exported_rows"]
    return read.unionByName(out).agg(*[F.sum(n).alias(n) for n in names])


def run_report(dissected: DataFrame, messages, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(message, packets, valid_udp, matched_packets, exported_rows) from one pass over the packets.

    A row for every message that occurs, and one without a name for packets that
    match none. A packet's first match counts for the packet, so the columns'
    sums are those of ``run_summary``, and messages without a row are missing.
    Matches are numbered while routing: nothing but this table's partial sums is
    shuffled.
    """
    from wirelens.operators.route import match_lists

    valid = F.col("drop_reason").isNull()
    listed = match_lists(dissected, messages)
    if listed is None:
        # definitions beyond a broadcast: matches are joined, and told apart by the datagrams' keys
        own = [k for k in keys if k in dissected.columns]
        pairs = match_pairs(dissected.filter(valid), messages, keys).groupBy(*own).agg(F.array_sort(F.collect_set(F.struct("def_order", "message", "format"))).alias("matches"))
        listed = dissected.join(pairs, own, "left")
    hits = F.when(valid, F.col("matches"))
    rows = listed.select(valid.alias("_valid"), F.posexplode_outer(hits).alias("_no", "_match"))
    first = F.coalesce(F.col("_no"), F.lit(0)) == 0
    return rows.groupBy(F.col("_match.message").alias("message")).agg(
        F.count_if(first).alias("packets"),
        F.count_if(first & F.col("_valid")).alias("valid_udp"),
        F.count_if(F.col("_no") == 0).alias("matched_packets"),
        F.count("_no").alias("exported_rows"),
    )


def report_totals(report: DataFrame) -> DataFrame:
    """``run_summary``'s row from ``run_report``."""
    names = ["valid_udp", "matched_packets", "exported_rows"]
    return report.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in zip(["packets", *names], ["total_packets", *names], strict=True)])


def message_summary(routed: DataFrame, messages) -> DataFrame:
    """Exported rows per definition, zeros included; ``missing`` marks the zeros."""
    defs, _ = _as_frame(routed, messages)
    counts = routed.groupBy("message").agg(F.count(F.lit(1)).alias("_n"))
    rows = F.coalesce(F.col("_n"), F.lit(0))
    return defs.join(counts, "message", "left").select(
        "message", "port", "payload_len", rows.alias("exported_rows"), (rows == 0).alias("missing")
    )


def joined_values(columns: list[str]) -> Column:
    """Cells of a row joined for display."""
    return F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])


def preview(decoded: DataFrame, values: list[str], n: int = PREVIEW_ROWS, order: tuple[str, ...] = ("packet_no",)) -> DataFrame:
    """The first ``n`` rows in packet order (a top-k, not a sort of everything)."""
    kept = [c for c in decoded.columns if c not in values]
    return decoded.select(*kept, joined_values(values).alias("values")).orderBy(*order).limit(n)


def latest_preview(decoded: DataFrame, values: list[str], n: int = LIVE_PREVIEW_ROWS, order: str = "packet_no") -> DataFrame:
    """The last ``n`` rows by arrival."""
    kept = [c for c in decoded.columns if c not in values]
    return decoded.select(*kept, joined_values(values).alias("values")).orderBy(F.col(order).desc()).limit(n)


def field_ends(fields: DataFrame) -> DataFrame:
    """Furthest byte any well-placed field of a message needs."""
    placed = fields.filter((F.col("off0") >= 0) & (F.col("len") > 0))
    return placed.groupBy("message").agg(F.max(F.col("off0") + F.col("len")).alias("needed"))


def short_packet_count(routed: DataFrame, fields: DataFrame) -> DataFrame:
    """Matched datagrams with some field past their end, per message."""
    from wirelens.operators.joins import lookup_join

    needs = field_ends(fields)
    pairs = lookup_join(routed.select("message", "payload_size", *[k for k in KEYS if k in routed.columns]), needs, ["message"], spread=[k for k in KEYS if k in routed.columns] or ["payload_size"])
    return pairs.groupBy("message").agg(F.count_if(F.col("payload_size") < F.col("needed")).alias("short_packets"))


def matched_datagrams(datagrams: DataFrame, messages, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Datagrams with at least one match."""
    used = [k for k in keys if k in datagrams.columns]
    hits = match_pairs(datagrams, messages, keys).select(*used).distinct()
    return datagrams.join(hits, used, "left_semi")
