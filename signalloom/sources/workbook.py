"""Sheets of xlsx workbooks, read with the standard library: a zip of XML parts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(name: str) -> int:
    """A is 1, Z is 26, AA is 27."""
    n = 0
    for c in name:
        n = 26 * n + ord(c) - 64
    return n


def _text(node) -> str:
    """All runs of a string, phonetic hints aside."""
    return "".join(t.text or "" for part in node if part.tag in (f"{MAIN}t", f"{MAIN}r") for t in ([part] if part.tag == f"{MAIN}t" else part.findall(f"{MAIN}t")))


def sheet_cells(content: bytes, sheet: str) -> Iterator[tuple[int, int, str | None, bool]]:
    """(row, column, value, is formula) of a sheet's cells that hold something; ValueError if there is no such sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): links[s.get(LINK)] for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")}
        if sheet not in sheets:
            raise ValueError(f"no sheet {sheet!r}, only {sorted(sheets)}")
        strings = [_text(s) for s in ET.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        target = sheets[sheet]
        part = target[1:] if target.startswith("/") else f"xl/{target}"
        for cell in ET.fromstring(book.read(part)).iter(f"{MAIN}c"):
            column, row = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
            value, inner = cell.find(f"{MAIN}v"), cell.find(f"{MAIN}is")
            text = _text(inner) if inner is not None else None if value is None else value.text
            if cell.get("t") == "s" and text is not None:
                text = strings[int(text)]
            formula = cell.find(f"{MAIN}f") is not None
            if text is not None or formula:
                yield int(row), column_number(column), text, formula


def sheet_rows(content: bytes, sheet: str, headers: list[str], first_column: int, header_row: int) -> list[list]:
    """[row number, values..] below the header row; blank rows go, another header or a formula is an error."""
    rows: dict[int, list] = {}
    last = first_column + len(headers)
    for row, column, text, formula in sheet_cells(content, sheet):
        if row >= header_row and first_column <= column < last:
            if formula and row > header_row:
                raise ValueError(f"formula in row {row}")
            rows.setdefault(row, [None] * len(headers))[column - first_column] = text
    found = rows.pop(header_row, None)
    if found != headers:
        raise ValueError(f"unexpected headers {found!r}")
    return [[row, *rows[row]] for row in sorted(rows) if any(v is not None for v in rows[row])]


def read_workbook(spark: SparkSession, path: str, sheet: str, headers: list[str], fields: list[str], first_column: int = 2, header_row: int = 2) -> DataFrame:
    """(path, excel_row, fields..) of the sheet in every workbook under a path, one workbook at a time; all values are text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for where, content in zip(part["path"], part["content"]):
                rows = sheet_rows(content, sheet, headers, first_column, header_row)
                yield pd.DataFrame([[where, *r] for r in rows], columns=["path", "excel_row", *fields])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, excel_row int, " + ", ".join(f"`{f}` string" for f in fields))
