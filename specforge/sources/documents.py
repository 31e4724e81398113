"""Text files and Word documents as blocks and as texts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specforge.schemas import BLOCKS, IMAGES

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
INSTRUCTION = re.compile(r"<<[^>]*>>")
OPEN_POINT = re.compile(r"\b(?:TBD|XXX|TODO)\b", re.I)
CONTENTS = re.compile(r"\.{3,}\s*\d+\s*$|^\s*\d+\s*$")


def heading_level(style: str) -> int | None:
    m = re.search(r"(?:heading|titre)\s*(\d)", style or "", re.I)
    return min(int(m[1]), 6) if m else None


def _text(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{W}t")).strip()


def _red(p: ET.Element) -> bool:
    return any((c.get(f"{W}val") or "").upper().startswith(("FF", "FE", "C")) for c in p.iter(f"{W}color"))


def _body(data: bytes) -> list[ET.Element]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return list(ET.fromstring(z.read("word/document.xml")).find(f"{W}body"))


def docx_blocks(name: str, data: bytes, order: str = "paragraphs") -> list[tuple]:
    """Blocks of a document: all paragraphs, then all tables; or, with order='document', as they stand."""
    body = [x for x in _body(data) if x.tag in (f"{W}p", f"{W}tbl")]
    if order == "paragraphs":
        body.sort(key=lambda x: x.tag != f"{W}p")
    out: list[tuple] = []
    section = ""

    def add(kind: str, text: str, level: int | None = None, template: bool = False, header: str | None = None) -> None:
        out.append((name, len(out), kind, level, section, text, template, header))

    for x in body:
        if x.tag == f"{W}p":
            text = _text(x)
            if not text or CONTENTS.search(text):
                continue
            style = x.find(f"{W}pPr/{W}pStyle")
            level = heading_level(style.get(f"{W}val") if style is not None else "")
            template = bool(INSTRUCTION.search(text)) or (bool(OPEN_POINT.search(text)) and len(text) < 50) or _red(x)
            if level:
                section = text
            add("heading" if level else "template_instruction" if template else "paragraph", text, level, template)
            continue
        rows = [[_text(c) for c in r.iter(f"{W}tc")] for r in x.iter(f"{W}tr")]
        header = " | ".join(rows[0]) if rows else ""
        add("table", header)
        for r in rows[1:]:
            add("table_row", " | ".join(r), header=header)
        add("table_end", "")
    return out


def docx_text(data: bytes) -> str:
    return "\n".join(b[5] for b in docx_blocks("", data, "document") if b[5])


def docx_images(name: str, data: bytes) -> list[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("word/_rels/document.xml.rels"))} if "word/_rels/document.xml.rels" in z.namelist() else {}
        section, out = "", []
        for x in ET.fromstring(z.read("word/document.xml")).find(f"{W}body"):
            style = x.find(f"{W}pPr/{W}pStyle")
            if style is not None and heading_level(style.get(f"{W}val")):
                section = _text(x)
            for blip in x.iter(f"{A}blip"):
                target = rels.get(blip.get(f"{R}embed"), "")
                if f"word/{target}" in z.namelist():
                    image = z.read(f"word/{target}")
                    out.append((name, section, target.rpartition("/")[2], "image/" + target.rpartition(".")[2], len(image), image))
        return out


def _mapped(spark: SparkSession, path: str, pattern: str, make, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch.path, batch.content, strict=True):
                yield pd.DataFrame(make(file.rpartition("/")[2], bytes(content)), columns=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content").mapInPandas(read, schema)


def blocks(spark: SparkSession, path: str, order: str = "paragraphs") -> DataFrame:
    return _mapped(spark, path, "*.docx", lambda n, d: docx_blocks(n, d, order), BLOCKS)


def images(spark: SparkSession, path: str) -> DataFrame:
    return _mapped(spark, path, "*.docx", docx_images, IMAGES)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, text) of txt and docx files; what can't be read is empty.  One row per name: the greatest text of files of one name."""

    def make(name: str, data: bytes) -> list[tuple]:
        try:
            return [(name, docx_text(data) if name.lower().endswith(".docx") else data.decode("utf-8", "replace"))]
        except Exception:  # noqa: BLE001  the contract of this reader: failures are empty texts
            return [(name, "")]

    return _mapped(spark, path, "*.{txt,docx}", make, "file_name string, text string").groupBy("file_name").agg(F.max("text").alias("text"))


def requirement_tables(found: DataFrame) -> DataFrame:
    """(doc_id, table_index, row_index, section, cells) of blocks: rows of tables as requirement extraction wants them, row 0 being the header."""
    d = found.where("block_type in ('table', 'table_row')").select(F.col("source_file").alias("doc_id"), "block_id", F.coalesce("section_context", F.lit("")).alias("section"), "block_type", "text")
    d = d.withColumn("table_index", (F.sum((F.col("block_type") == "table").cast("int")).over(Window.partitionBy("doc_id").orderBy("block_id")) - 1).cast("int"))
    d = d.withColumn("row_index", F.row_number().over(Window.partitionBy("doc_id", "table_index").orderBy("block_id")) - 1)
    return d.select("doc_id", "table_index", "row_index", "section", F.transform(F.split("text", r"\|"), lambda x: F.trim(x)).alias("cells"))
