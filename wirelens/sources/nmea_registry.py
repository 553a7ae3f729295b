"""Positional fields of the known NMEA-0183 sentences."""

from __future__ import annotations

import csv
from functools import lru_cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Default column name of a value kind.
NAMES = {
    "Time": "UTC",
    "Latitude": "Latitude",
    "Longitude": "Longitude",
    "Date": "Date",
    "Status": "Status",
    "Char": "Indicator",
    "Numeric": "Value",
    "Text": "Text",
}


@lru_cache(maxsize=1)
def _sentences() -> dict[str, list[str]]:
    """Kinds by comma position of each sentence, from the plain table beside this module."""
    text = resources.files("wirelens.sources").joinpath("nmea_sentences.csv").read_text()
    out: dict[str, list[str]] = {}
    for row in csv.DictReader(line for line in text.splitlines() if not line.startswith("#")):
        out.setdefault(row["formatter"], []).append(row["kind"])
    return out


def _names(kinds: list[str]) -> list[str]:
    """Names by kind; the character after a position is its hemisphere; repeats are numbered."""
    stems = []
    for i, kind in enumerate(kinds):
        before = kinds[i - 1] if i else ""
        stems.append({"Latitude": "NS", "Longitude": "EW"}.get(before, NAMES[kind]) if kind == "Char" else NAMES[kind])
    seen: dict[str, int] = {}
    names = []
    for stem in stems:
        seen[stem] = seen.get(stem, 0) + 1
        names.append(f"{stem}{seen[stem]}" if stems.count(stem) > 1 else stem)
    return names


def formatters() -> list[str]:
    return list(_sentences())


def kinds_of(formatter: str) -> dict[int, str] | None:
    """Kind per comma position, or None for a custom formatter."""
    kinds = _sentences().get(formatter.strip().upper())
    return None if kinds is None else {i + 1: kind for i, kind in enumerate(kinds)}


def registry_slots(formatter: str) -> int:
    return len(_sentences().get(formatter.strip().upper(), []))


def nmea_registry(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """(formatter, idx, name, kind); rows of ``extra`` replace whole sentences or add new ones."""
    rows = [
        (f, i + 1, name, kind)
        for f, kinds in _sentences().items()
        for i, (kind, name) in enumerate(zip(kinds, _names(kinds), strict=True))
    ]
    base = spark.createDataFrame(rows, "formatter string, idx int, name string, kind string")
    if extra is None:
        return base
    own = extra.select(F.upper("formatter").alias("formatter"), "idx", "name", "kind")
    return base.join(own.select("formatter").distinct(), "formatter", "left_anti").unionByName(own)
