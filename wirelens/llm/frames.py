"""Small helpers of the corpus operators: columns by exact name, bindings, shared work tables."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word rules: space and the control characters 9 to 13.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, matched by exact spelling, whatever other columns exist."""
    have = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(have))])
    return plain.select(*[F.col(f"_c{have.index(n)}").alias(n) for n in names])


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """``df`` with columns ``_c0``..., the new name of each old one, and the way back to ``df``'s own columns."""
    have = df.columns
    names = [f"_c{i}" for i in range(len(have))]
    where = dict(zip(reversed(have), reversed(names), strict=True))
    return df.toDF(*names), where, lambda out: out.select(*names).toDF(*have)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for NULL."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def give_back() -> None:
    """Memory that is free in this process goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for mapInArrow, with its memory given back at the task's end: Spark keeps the process for later tasks."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def work_dir(spark: SparkSession) -> str:
    """A new folder inside ``spark.checkpoint.dir``; a local session without that setting gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local["):
        base = os.path.join(tempfile.gettempdir(), "wirelens-checkpoints")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: no lineage, no cache, safe when executors are lost."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
