"""Running totals over one global order without putting a group in one task.

A window over ``partitionBy(key)`` sorts a whole key in one task. Here a key is
cut into chunks of consecutive order values: chunk totals are made with a
partial aggregate, only those totals are scanned per key, and rows are scanned
inside their own chunk. Where the order column is a unique integer per key and
dense, chunks are cut by its value and never hold more than ``chunk`` rows. Any
other order (time stamps, for one) is cut at sampled splitters instead: rows are
range-partitioned by key and order, scanned where they lie, and the partitions'
totals are carried on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.operators.joins import is_bounded
from wirelens.sources.work import written

CHUNK = 65_536


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    totals: dict[str, tuple[str, Column]],
    chunk: int | None = CHUNK,
    ties: tuple[str, ...] = (),
    piece: str | None = None,
) -> DataFrame:
    """Add, per entry ``name: (kind, value)``, the value over all earlier rows.

    ``kind`` is ``sum`` or ``max``; the current row is excluded, and rows with
    none before get 0 for sums and NULL for maxima. With ``chunk`` None the rows
    are cut at sampled splitters; values are then whole numbers. Rows of equal
    order come in the order of the columns ``ties``, else in any order.
    ``piece`` names a column for the number of the chunk that a row lies in.
    """
    if chunk is None:
        return _running_sampled(df, keys, order, totals, ties, piece)
    staged = df.withColumn("_chunk", F.floor(F.col(order) / chunk)).withColumns(
        {f"_v_{n}": v for n, (_, v) in totals.items()}
    )
    fold = {"sum": F.sum, "max": F.max}
    parts = staged.groupBy(*keys, "_chunk").agg(*[fold[k](f"_v_{n}").alias(f"_p_{n}") for n, (k, _) in totals.items()])
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_chunk").alias("_k_chunk"),
        *[fold[k](f"_p_{n}").over(across).alias(f"_b_{n}") for n, (k, _) in totals.items()],
    )
    same = F.col("_chunk") == F.col("_k_chunk")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    within = Window.partitionBy(*keys, "_chunk").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = staged.join(bases, same, "left")
    out = joined
    for n, (k, _) in totals.items():
        local = fold[k](f"_v_{n}").over(within)
        if k == "sum":
            out = out.withColumn(n, F.coalesce(F.col(f"_b_{n}"), F.lit(0)) + F.coalesce(local, F.lit(0)))
        else:
            out = out.withColumn(n, F.greatest(F.col(f"_b_{n}"), local))
    out = out if piece is None else out.withColumn(piece, F.col("_chunk"))
    scratch = ["_chunk", "_k_chunk"] + [f"_k_{k}" for k in keys]
    scratch += [f"_{p}_{n}" for n in totals for p in ("v", "b")]
    return out.drop(*scratch)


def _changes(columns, before):
    """For sorted key columns where a new key begins; ``before`` are the keys of the row ahead of the first one, if any."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(columns[0]) if columns else 0
    out = np.zeros(n, bool)
    for i, column in enumerate(columns):
        ahead = column.slice(0, 1) if before is None else before[i]
        shifted = pa.concat_arrays([ahead, column.slice(0, n - 1)])
        differs = pc.fill_null(pc.not_equal(column, shifted), False)
        one_null = pc.xor(pc.is_null(column), pc.is_null(shifted))
        out |= np.asarray(pc.or_(differs, one_null))
    return out


def _scan_partition(keys: int, kinds: list[str]):
    """Exclusive running values inside one sorted partition; columns are keys, values, then the rest."""

    def run(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        before, carried = None, [None] * len(kinds)
        for batch in batches:
            if not batch.num_rows:
                continue
            n, held = batch.num_rows, batch.columns
            fresh = _changes(held[:keys], before) if keys else np.zeros(n, bool)
            before = [c.slice(n - 1, 1) for c in held[:keys]] or None
            segment = pd.Series(np.cumsum(fresh))
            out = []
            for i, kind in enumerate(kinds):
                value = held[keys + i]
                none = np.asarray(value.is_null())
                lowest = 0 if kind == "sum" else np.iinfo(np.int64).min
                plain = np.where(none, lowest, np.asarray(value.fill_null(0)))
                if carried[i] is not None and not fresh[0]:
                    plain = plain.copy()
                    first = plain[0]
                    plain[0] = first + carried[i] if kind == "sum" else max(first, carried[i])
                grouped = pd.Series(plain).groupby(segment)
                upto = (grouped.cumsum() if kind == "sum" else grouped.cummax()).to_numpy()
                ahead = np.append(lowest if carried[i] is None else carried[i], upto[:-1])
                ahead[fresh] = lowest
                carried[i] = upto[-1]
                out.append(pa.array(ahead, pa.int64(), mask=None if kind == "sum" else ahead == lowest))
            yield pa.RecordBatch.from_arrays([*held, pa.array([part] * n, pa.int32()), *out], [f"c{k}" for k in range(len(held) + 1 + len(out))])

    return run


def _running_sampled(
    df: DataFrame, keys: list[str], order: str, totals: dict[str, tuple[str, Column]], ties: tuple[str, ...] = (), piece: str | None = None
) -> DataFrame:
    """``running`` by range partitions: one shuffle of the rows, whatever their order looks like."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names, kinds = list(totals), [k for k, _ in totals.values()]
    values = [v.cast("long").alias(f"_v_{n}") for n, (_, v) in totals.items()]
    staged = df.select(*[F.col(f"`{k}`").alias(f"_k_{i}") for i, k in enumerate(keys)], *values, *[F.col(f"`{c}`") for c in df.columns])
    tags = [f"_k_{i}" for i in range(len(keys))]
    ranged = staged.repartitionByRange(parts, *tags, order).sortWithinPartitions(*tags, order, *ties)
    local = [T.StructField("_part", T.IntegerType()), *[T.StructField(f"_l_{n}", T.LongType()) for n in names]]
    # written, as totals and rows must come from the same cut
    rows = written(ranged.mapInArrow(_scan_partition(len(keys), kinds), T.StructType([*staged.schema.fields, *local])), "scan")
    fold = {"sum": F.sum, "max": F.max}
    sums = rows.groupBy(*tags, "_part").agg(*[fold[k](f"_v_{n}").alias(f"_p_{n}") for n, k in zip(names, kinds, strict=True)])
    across = Window.partitionBy(*tags).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        *[F.col(t).alias(f"{t}b") for t in tags], F.col("_part").alias("_partb"), *[fold[k](f"_p_{n}").over(across).alias(f"_b_{n}") for n, k in zip(names, kinds, strict=True)]
    ).filter(" OR ".join(f"_b_{n} IS NOT NULL" for n in names))
    same = F.col("_part") == F.col("_partb")
    for t in tags:
        same = same & F.col(t).eqNullSafe(F.col(f"{t}b"))
    joined = rows.join(F.broadcast(bases) if is_bounded(bases) else bases, same, "left")
    done = {
        n: F.coalesce(F.col(f"_b_{n}"), F.lit(0)) + F.col(f"_l_{n}") if k == "sum" else F.greatest(f"_b_{n}", f"_l_{n}") for n, k in zip(names, kinds, strict=True)
    }
    told = [] if piece is None else [F.col("_part").alias(piece)]
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(n) for n, c in done.items()], *told)


#: Parts that a search for a value cuts what is left into.
CUTS = 1 << 16


def values_at(df: DataFrame, value: Column, shares: list[float]) -> list[int | None]:
    """For each share the least value that this share of all values doesn't exceed, exactly, as ``percentile_disc`` has it.

    ``value`` is a whole number; NULLs don't count, and without any value there
    is none. The values between which the answer lies are counted in ``CUTS``
    stretches, then those of the one that holds it, down to one value: a few
    passes over the rows, each with a small table of counts, where an exact
    percentile holds every distinct value in one task.
    """
    staged = df.select(value.cast("bigint").alias("v")).filter("v IS NOT NULL")
    total, low, high = staged.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not total:
        return [None] * len(shares)
    # of each search: first and last value that it may end at, and the place of its answer among these
    search = [(low, high, max(1, math.ceil(share * total))) for share in shares]
    while live := sorted({(a, b) for a, b, _ in search if a < b}):
        steps = {(a, b): -(-(b - a + 1) // CUTS) for a, b in live}
        # searches have the same stretch or disjoint ones, so a value is in one at most
        cell = F.lit(None).cast("bigint")
        for i, (a, b) in reversed(list(enumerate(live))):
            place = F.call_function("div", F.col("v") - F.lit(a), F.lit(steps[a, b]).cast("bigint"))
            cell = F.when(F.col("v").between(a, b), place + i * CUTS).otherwise(cell)
        counts: dict = {}
        told = staged.select(cell.alias("c")).filter("c IS NOT NULL").groupBy("c").agg(F.count(F.lit(1)).alias("n")).toArrow()
        for at, n in zip(told["c"].to_pylist(), told["n"].to_pylist(), strict=True):
            counts.setdefault(live[at // CUTS], []).append((at % CUTS, n))
        for j, (a, b, place) in enumerate(search):
            for k, n in sorted(counts.get((a, b), [])):
                if place <= n:
                    start = a + k * steps[a, b]
                    search[j] = (start, min(b, start + steps[a, b] - 1), place)
                    break
                place -= n
    return [a for a, _, _ in search]
