"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

How many rows of partition p go to shard s in a uniform random shuffle is a
draw without replacement: the rows of the matrix are multivariate
hypergeometric draws from the places that the shards still have. With the
matrix drawn, every partition permutes its own rows and deals them out by its
row of the matrix, rows are exchanged, and every shard permutes what it
got. All permutations of the rows are equally likely, and shard sizes are exact
(at most one apart) however the input is partitioned.

Only the row counts of partitions meet in the driver. The second permutation
sorts a shard by random numbers in ``PIECES`` ranges of their own with offsets
from the ranges' counts, so no task sorts a shard whole.

Defined results: a NULL text has 8 bytes and checksum 0; rows with NULL or
repeated ids and equal rows are separate rows; fewer rows than shards leave
shards empty; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.llm.frames import columns, cut

PIECES = 16


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows of each partition for each shard; row sums are ``counts``, column sums differ by one at most."""
    import numpy as np

    total = sum(counts)
    room = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    rng = np.random.default_rng(seed)
    # the shards that hold one row more are drawn too
    rng.shuffle(room)
    matrix = []
    for n in counts:
        drawn = np.zeros(shards, dtype=np.int64)
        left, rest = n, int(room.sum())
        for s in range(shards):
            # the shards one by one: plain hypergeometric draws
            rest -= int(room[s])
            drawn[s] = _hypergeometric(rng, int(room[s]), rest, left)
            left -= int(drawn[s])
        room -= drawn
        matrix.append(drawn.tolist())
    return matrix


def _hypergeometric(rng, good: int, bad: int, n: int) -> int:
    """Good ones in ``n`` draws; beyond numpy's range of 10^9 the places are halved until they fit."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    half_good, half_bad = good // 2, bad // 2
    first = _split(rng, half_good + half_bad, good + bad, n)
    return _hypergeometric(rng, half_good, half_bad, first) + _hypergeometric(rng, good - half_good, bad - half_bad, n - first)


def _split(rng, part: int, whole: int, n: int) -> int:
    """Draws that fall on ``part`` of ``whole`` places, from the normal law within its exact limits.

    Only for over 10^9 places, where the law's own spread is far over its error.
    """
    p = part / whole
    spread = (n * p * (1 - p) * (whole - n) / max(1, whole - 1)) ** 0.5
    return int(min(part, n, max(0, n - (whole - part), round(rng.normal(n * p, spread)))))


def shuffle(rows: DataFrame, shards: int, seed: int = 20240607) -> DataFrame:
    """``rows`` with shard and slot: a uniform random place in shards of exact size.

    ``rows`` is written once to the shared folder with the input partition and
    place of each row, so what is dealt out is what was counted, also when a
    task or an executor is lost.
    """
    fixed = cut(rows.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    counted = {r["part"]: r["n"] for r in fixed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    parts = sorted(counted)
    matrix = dict(zip(parts, communication_matrix([counted[p] for p in parts], shards, seed), strict=True))
    schema = T.StructType([*fixed.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("draw", T.LongType())])

    def deal(rows: pa.Table) -> pa.Table:
        """One input partition: a random permutation of its row of the matrix, and a number for the second one."""
        import numpy as np

        rows = rows.sort_by("at")
        p = rows.column("part")[0].as_py()
        rng = np.random.default_rng([seed, p])
        target = rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), matrix[p]))
        draw = rng.integers(0, 1 << 62, rows.num_rows)
        return rows.append_column("shard", pa.array(target)).append_column("draw", pa.array(draw))

    dealt = fixed.groupBy("part").applyInArrow(deal, schema)
    dealt = dealt.withColumn("piece", F.shiftright("draw", 62 - PIECES.bit_length() + 1))
    sizes = dealt.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # at most shards * PIECES rows, whatever the input
    placed = dealt.join(F.broadcast(starts), ["shard", "piece"])
    order = Window.partitionBy("shard", "piece").orderBy("draw", "at")
    slotted = placed.withColumn("slot", F.col("start") + F.row_number().over(order) - 1)
    return slotted.select(*rows.columns, "shard", F.col("slot").cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: every document's place under the law ``rows``."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    light = columns(docs, "doc_id", "text").select(
        "doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32")
    )
    return shuffle(light, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
