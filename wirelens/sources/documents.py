"""Tables of Word interface documents as rows of text cells."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ICD_ROWS = (
    "doc string, table_idx int, heading string, page int, table_on_page int, row_idx int, cells array<string>, error string"
)
_NAMES = [c.split()[0] for c in ICD_ROWS.split(", ")]


def _local(element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _attribute(element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), None)


def _is_page_break(element) -> bool:
    name = _local(element)
    if name == "pageBreakBefore":
        return (_attribute(element, "val") or "true").lower() not in ("false", "0", "off", "none")
    return name == "lastRenderedPageBreak" or (name == "br" and _attribute(element, "type") == "page")


def _squeeze(text: str) -> str:
    return " ".join(text.split())


def _outer(element, wanted: str):
    """Descendants of one name, not entering them or nested tables."""
    for child in element:
        name = _local(child)
        if name == wanted:
            yield child
        elif name != "tbl":
            yield from _outer(child, wanted)


def _breaks(element) -> int:
    """Page breaks of a cell: everything but nested tables."""
    own = 0
    for child in element:
        if _local(child) == "tbl":
            continue
        own += _is_page_break(child)
        own += sum(map(_is_page_break, child.iter())) - _is_page_break(child) if _local(child) == "p" else _breaks(child)
    return own


def _cells(row) -> list[str]:
    cells = []
    for cell in _outer(row, "tc"):
        cells.append(_squeeze(" ".join("".join(p.itertext()) for p in _outer(cell, "p"))))
        span = next((_attribute(e, "val") for e in _outer(cell, "gridSpan")), None)
        cells += [""] * (max(int(span), 1) - 1 if span and span.isdigit() else 0)
    return cells


def _document_rows(doc: str, content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    heading, breaks, last_page, on_page, index = "", 0, -1, 0, 0
    stack = [iter([root])]
    while stack:
        element = next(stack[-1], None)
        if element is None:
            stack.pop()
        elif _local(element) == "tbl":
            page = breaks + 1
            on_page, last_page = (on_page + 1 if page == last_page else 1), page
            for i, row in enumerate(_outer(element, "tr")):
                breaks += sum(_breaks(c) for c in _outer(row, "tc"))
                yield doc, index, heading, page, on_page, i, _cells(row), None
            heading, index = "", index + 1
        elif _local(element) == "p":
            breaks += sum(map(_is_page_break, element.iter()))
            heading = _squeeze("".join(element.itertext())) or heading
        else:
            stack.append(iter(element))
    if index == 0:
        yield doc, None, None, None, None, None, None, "no tables"


def _read(batches):
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                rows = list(_document_rows(path, content))
            except KeyError:
                rows = [(path, *[None] * 6, "word/document.xml is missing")]
            except (zipfile.BadZipFile, ElementTree.ParseError) as e:
                rows = [(path, *[None] * 6, f"not a readable document: {type(e).__name__}")]
            yield pd.DataFrame(rows, columns=_NAMES).astype(
                {c: "Int64" for c in ("table_idx", "page", "table_on_page", "row_idx")}
            )


def read_icd_tables(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of all tables in a folder of documents, and documents without any."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.docx")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "content")
    )
    rows = files.mapInPandas(_read, ICD_ROWS)
    good = rows.filter(F.col("error").isNull()).drop("error")
    return good, rows.filter(F.col("error").isNotNull()).select("doc", "error")
