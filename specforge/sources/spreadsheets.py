"""Spreadsheets (xlsx, xlsm, ods) from their XML, read with Spark's binaryFile source: no office library is needed."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from specforge.schemas import CORRUPT, MATRIX_ROWS

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
#: Repeats of an ods cell or row beyond these are padding of the sheet (fixed values).
MOST_COLUMNS, MOST_ROWS = 500, 10_000
Sheet = tuple[str, list[list[str]]]


def column_number(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_xlsx(data: bytes) -> list[Sheet]:
    """Values of visible rows; hidden columns are blank; merged cells hold the value of their first cell."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = []
        for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            path = targets[s.get(f"{REL}id")].lstrip("/")
            root = ET.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}"))
            sheets.append((s.get("name"), _xlsx_rows(root, shared)))
        return sheets


def _xlsx_rows(root: ET.Element, shared: list[str]) -> list[list[str]]:
    hidden_columns = {k for c in root.iter(f"{MAIN}col") if c.get("hidden") in ("1", "true") for k in range(int(c.get("min")) - 1, int(c.get("max")))}
    grid: dict[int, dict[int, str]] = {}
    hidden_rows = set()
    for row in root.iter(f"{MAIN}row"):
        at = int(row.get("r", len(grid) + 1)) - 1
        if row.get("hidden") in ("1", "true"):
            hidden_rows.add(at)
        cells = grid.setdefault(at, {})
        for c in row.iter(f"{MAIN}c"):
            k = column_number(c.get("r")) if c.get("r") else len(cells)
            v = c.find(f"{MAIN}v")
            text = "".join(t.text or "" for t in c.iter(f"{MAIN}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
            cells[k] = (shared[int(text)] if c.get("t") == "s" and text else text).strip()
    for m in root.iter(f"{MAIN}mergeCell"):
        a, _, b = m.get("ref").partition(":")
        (r0, c0), (r1, c1) = ((int(re.search(r"\d+", x)[0]) - 1, column_number(x)) for x in (a, b or a))
        value = grid.get(r0, {}).get(c0, "")
        for r in range(r0, r1 + 1):
            for c in range(c0, c1 + 1):
                grid.setdefault(r, {})[c] = value
    width = max((k for cells in grid.values() for k in cells), default=-1) + 1
    return [["" if c in hidden_columns else grid.get(r, {}).get(c, "") for c in range(width)] for r in range(max(grid, default=-1) + 1) if r not in hidden_rows]


def read_ods(data: bytes) -> list[Sheet]:
    """Cells with repeats spelled out, row spans carried down, filtered and collapsed rows left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        raw = z.read("content.xml")
    try:
        root = ET.fromstring(raw)
    except ET.ParseError:  # stray control characters and bare ampersands are the usual damage
        text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", raw.decode("utf-8", "replace"))
        root = ET.fromstring(re.sub(r"&(?!(?:#\d+|#x[0-9a-fA-F]+|\w+);)", "&amp;", text))
    sheets = []
    for table in root.iter(f"{TABLE}table"):
        rows, spans = [], {}
        for row in table.iter(f"{TABLE}table-row"):
            cells: list[str] = []
            for c in row:
                if c.tag not in (f"{TABLE}table-cell", f"{TABLE}covered-table-cell"):
                    continue
                value = "\n".join("".join(p.itertext()) for p in c.iter(f"{TEXT}p")).strip()
                for _ in range(min(int(c.get(f"{TABLE}number-columns-repeated", 1)), MOST_COLUMNS)):
                    at = len(cells)
                    left, held = spans.get(at, (0, ""))
                    cells.append(value or (held if left else ""))
                    down = int(c.get(f"{TABLE}number-rows-spanned", 1)) - 1
                    spans[at] = (down, value) if down > 0 else (max(0, left - 1), held)
            if row.get(f"{TABLE}visibility") in ("filter", "collapse"):
                continue
            times = int(row.get(f"{TABLE}number-rows-repeated", 1))
            rows += [cells] * (min(times, MOST_ROWS) if any(cells) else min(times, 1))
        sheets.append((table.get(f"{TABLE}name"), rows))
    return sheets


READERS = {"xlsx": read_xlsx, "xlsm": read_xlsx, "ods": read_ods}


def read_spreadsheet(name: str, data: bytes) -> list[Sheet]:
    suffix = name.rpartition(".")[2].lower()
    if suffix not in READERS:
        raise ValueError(f"no reader for .{suffix}")
    return READERS[suffix](data)


def matrix_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all spreadsheets below a path; a file that can't be read gives one row in a sheet named `_corrupt`."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch.path, batch.content, strict=True):
                name = file.rpartition("/")[2]
                try:
                    rows = [(name, k, sheet, n, cells) for k, (sheet, own) in enumerate(read_spreadsheet(name, bytes(content))) for n, cells in enumerate(own)]
                except Exception as problem:  # noqa: BLE001  one damaged file doesn't end the job; it is reported
                    rows = [(name, 0, CORRUPT, 0, [str(problem)])]
                yield pd.DataFrame(rows, columns=["file_name", "sheet_idx", "sheet_name", "row_index", "cells"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xlsx,xlsm,ods}").load(path).select("path", "content")
    return files.mapInPandas(read, MATRIX_ROWS)
