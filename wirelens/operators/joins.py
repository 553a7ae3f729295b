"""Joins of a large table to a definition table of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20


def is_bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether rows and bytes (as text) are within the bounds; looks no further than one row past them."""
    size = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    row = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return row.n <= max_rows and row.b <= max_bytes


def salts_of(df: DataFrame) -> int:
    """Copies of a dimension: enough that a key with a third of all rows is no more than a task's share."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 3)


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "inner",
    spread: list[str] | None = None,
    dim_rows: int | None = None,
    max_rows: int = BROADCAST_ROWS,
    salts: int | None = None,
) -> DataFrame:
    """Equi join that broadcasts ``dim`` only when its size is proven.

    Beyond the bound the rows of ``fact`` are spread over ``salts`` copies of
    the dimension by a hash of ``spread``, so one hot key never lands in one
    task. ``how`` may be inner, left, left_semi or left_anti.
    """
    small = dim_rows <= max_rows if dim_rows is not None else is_bounded(dim, max_rows)
    if small:
        return fact.join(F.broadcast(dim), on, how)
    salts = salts or salts_of(fact)
    spread = spread or [c for c in fact.columns if c not in on]
    salted = fact.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, on + ["_salt"], how).drop("_salt")
