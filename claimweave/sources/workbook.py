"""Rows of many spreadsheet workbooks, one workbook per task record."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from itertools import product
from string import ascii_uppercase
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.session import materialize
from claimweave.sources.files import ROW_NUMBER

SCHEMA = "file string, sheet string, row_number bigint, cells map<string,string>, error string"

# Namespaces of the workbook format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _stream(book: zipfile.ZipFile, member: str, tag: str) -> Iterator[ElementTree.Element]:
    """Complete elements of a tag, each forgotten after use, so a part of any size takes the memory of one element."""
    parents: list[ElementTree.Element] = []
    with book.open(member) as part:
        for event, node in ElementTree.iterparse(part, events=("start", "end")):
            if event == "start":
                parents.append(node)
                continue
            parents.pop()
            if node.tag == tag:
                yield node
                (parents[-1] if parents else node).clear()


def _letters_in_order() -> Iterator[str]:
    """Names of columns from left to right."""
    for size in (1, 2, 3):
        for name in product(ascii_uppercase, repeat=size):
            yield "".join(name)


def _number_text(raw: str) -> str:
    try:
        number = float(raw)
    except ValueError:
        return raw
    return f"{number:.0f}" if number.is_integer() else repr(number)


def _all_text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iterfind(f".//{_MAIN}t"))


def _row_cells(row: ElementTree.Element, strings: list[str]) -> dict[str, str | None]:
    """Text of the cells of a row by column letters."""
    cells: dict[str, str | None] = {}
    for cell in row.iterfind(_MAIN + "c"):
        letters = cell.get("r", "A").rstrip("0123456789").upper()
        kind, raw = cell.get("t", "n"), cell.findtext(_MAIN + "v")
        if kind == "inlineStr":
            raw = _all_text(cell)
        elif raw is not None and kind in _TEXT_OF:
            raw = _TEXT_OF[kind](raw, strings)
        cells[letters] = raw
    return cells


# How stored values of a kind become text; other kinds are text already.
_TEXT_OF = {
    "s": lambda raw, strings: strings[int(raw)],
    "b": lambda raw, strings: "true" if raw == "1" else "false",
    "n": lambda raw, strings: _number_text(raw),
}


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, dict[str, str | None]]]:
    """``(sheet, row number, cells by header)`` of the visible sheets of one workbook, read row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        parts = {r.get("Id"): posixpath.join("/xl", r.get("Target", ""))[1:] for r in _stream(book, "xl/_rels/workbook.xml.rels", _PACKAGE + "Relationship")}
        shown = [(s.get("name"), s.get(_LINK + "id")) for s in _stream(book, "xl/workbook.xml", _MAIN + "sheet") if s.get("state") in (None, "visible")]
        if not shown:
            raise ValueError("workbook has no visible sheet")
        has_strings = "xl/sharedStrings.xml" in book.namelist()
        strings = [_all_text(item) for item in _stream(book, "xl/sharedStrings.xml", _MAIN + "si")] if has_strings else []
        for sheet, link in shown:
            rows = (_row_cells(row, strings) for row in _stream(book, parts[link], _MAIN + "row"))
            header = {letters: (name or "").strip() for letters, name in next(rows, {}).items()}
            gap = any(a != b for a, b in zip(header, _letters_in_order(), strict=False))
            if not header or gap or not all(header.values()) or ROW_NUMBER in header.values() or len({*header.values()}) < len(header):
                raise ValueError(f"unusable header in sheet {sheet}")
            for number, cells in enumerate(rows, 1):
                yield sheet, number, {name: cells.get(letters) for letters, name in header.items()}


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["file", "sheet", "row_number", "cells", "error"]
    for batch in batches:
        for file, content in zip(batch["path"], batch["content"]):
            rows = []
            try:
                for sheet, number, cells in workbook_rows(content):
                    rows.append((file, sheet, number, cells, None))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            except (ValueError, KeyError, AttributeError, IndexError, zipfile.BadZipFile, ElementTree.ParseError) as fault:
                rows.append((file, None, None, None, str(fault)))
            yield pd.DataFrame(rows, columns=columns)


def scan_workbooks(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` of workbooks given as ``path, content``; cells are text keyed by header.

    Spark distributes the workbooks; only the unpacking of one file is Python.
    """
    scanned = files.select("path", "content").mapInPandas(_scan, SCHEMA)
    return (
        scanned.filter(F.col("error").isNull()).drop("error"),
        scanned.filter(F.col("error").isNotNull()).select("file", F.array("error").alias("violations")),
    )


def read_workbooks(spark: SparkSession, path: str, max_bytes: int = 1_000_000_000) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` of all workbooks below a folder; a file beyond the size limit is a reject and is not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    rows, rejects = scan_workbooks(found.filter(F.col("length") <= max_bytes))
    large = found.filter(F.col("length") > max_bytes)
    return rows, rejects.unionByName(large.select(F.col("path").alias("file"), F.array(F.lit("too_large")).alias("violations")))


def sheet_table(rows: DataFrame, sheet: str, columns: list[str]) -> DataFrame:
    """One sheet as a table of strings with its row numbers."""
    picked = [F.try_element_at("cells", F.lit(name)).alias(name) for name in columns]
    return rows.filter(F.col("sheet") == sheet).select("file", *picked, F.col("row_number").alias(ROW_NUMBER))


def read_workbook_sheet(spark: SparkSession, path: str, sheet: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` of one sheet of all workbooks below ``path``; columns in order of their names."""
    rows, rejects = read_workbooks(spark, path)
    rows = materialize(rows.filter(F.col("sheet") == sheet), "sheet")
    # One name per column of the sheet.
    names = [r["name"] for r in rows.select(F.explode(F.map_keys("cells")).alias("name")).distinct().orderBy("name").collect()]
    return sheet_table(rows, sheet, names).drop("file"), rejects
