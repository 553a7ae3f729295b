"""Evaluate expressions once per row and keep them from being inlined again.

Catalyst pushes filters through projections by substituting the expressions,
which multiplies deep byte expressions. A one-element ``inline`` is a code-
generated operator that filters and projections are not moved across; the
projection under it evaluates the expressions with common parts shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add (or replace) columns behind such a boundary."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    staged = df.select(*kept, *[v.alias(f"_b_{n}") for n, v in columns.items()])
    held = F.struct(*[F.col(f"`_b_{n}`").alias(n) for n in columns])
    return staged.select(*kept, F.inline(F.array(held)))
