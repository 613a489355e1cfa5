"""Files of unknown dialect or without a Spark reader, as cells in long form: one row per cell, so that files of any shape share a table.

Files are read by Spark as binary rows; each row is decoded where it lies. Cells: path, table, row, col, name, value.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "path string, `table` string, row int, col int, name string, value string"
ENCODINGS = ("utf-8-sig", "utf-8", "cp1251", "latin-1")
DELIMITERS = ",;\t|"


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def decoded(content: bytes) -> str:
    """The first encoding that fits; the last fits anything."""
    for name in ENCODINGS:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    raise AssertionError


def dialect(text: str) -> type[csv.Dialect] | str:
    try:
        return csv.Sniffer().sniff(text[:4096], DELIMITERS)
    except csv.Error:
        return "excel"


def _cells(path: str, table: str, rows: list[list]) -> list[tuple]:
    """Rows under their first row as header; a blank header is ``Column n``; short rows end in nulls."""
    if not rows:
        return []
    names = [str(h).strip() if h not in (None, "") and str(h).strip() else f"Column {k + 1}" for k, h in enumerate(rows[0])]
    return [(path, table, r, c, names[c], row[c] if c < len(row) else None) for r, row in enumerate(rows[1:]) for c in range(len(names))]


def csv_cells(path: str, content: bytes) -> list[tuple]:
    text = decoded(content)
    return _cells(path, "0", [r for r in csv.reader(io.StringIO(text, newline=""), dialect(text)) if r])


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def xlsx_cells(path: str, content: bytes) -> list[tuple]:
    """Values of every sheet; blocks of rows between blank rows are tables of their own, a lone first cell is a title."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = links[sheet.get(f"{_REL}id")].lstrip("/")
        root = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
        blocks: list[list[list]] = [[]]
        last = 0
        for row in root.iter(f"{_MAIN}row"):
            at = int(row.get("r", last + 1))
            values: list = []
            for cell in row.iter(f"{_MAIN}c"):
                ref = re.match(r"[A-Z]+", cell.get("r", ""))
                col = sum((ord(ch) - 64) * 26**k for k, ch in enumerate(reversed(ref[0]))) - 1 if ref else len(values)
                raw = cell.find(f"{_MAIN}v")
                value = raw.text if raw is not None else "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) or None
                if cell.get("t") == "s" and raw is not None:
                    value = shared[int(raw.text)]
                elif cell.get("t") == "b":
                    value = "true" if value == "1" else "false"
                elif value is not None and cell.get("t", "n") == "n" and re.fullmatch(r"-?\d+\.0+", value):
                    value = value.split(".")[0]
                values += [None] * (col - len(values)) + [value]
            if at > last + 1 or not any(v not in (None, "") for v in values):
                blocks.append([])
            if any(v not in (None, "") for v in values):
                blocks[-1].append(values)
            last = at
        blocks = [b for b in blocks if b]
        for k, rows in enumerate(blocks):
            title = rows[0][0] if len(rows) > 2 and sum(v not in (None, "") for v in rows[0]) == 1 else None
            name = sheet.get("name") + (f" · {title}" if title else f" · {k + 1}" if len(blocks) > 1 else "")
            out += _cells(path, name, rows[1:] if title else rows)
    return out


def docx_cells(path: str, content: bytes) -> list[tuple]:
    """Tables of a document with at least two filled rows."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    out = []
    for k, table in enumerate(root.iter(f"{_WORD}tbl")):
        rows = [["".join(t.text or "" for t in cell.iter(f"{_WORD}t")).strip() for cell in row.iter(f"{_WORD}tc")] for row in table.iter(f"{_WORD}tr")]
        rows = [r for r in rows if any(r)]
        if len(rows) >= 2:
            out += _cells(path, str(k), rows)
    return out


PARSERS = {"csv": csv_cells, "tsv": csv_cells, "xlsx": xlsx_cells, "docx": docx_cells}


def read_cells(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Cells of all files of a kind under ``path``."""
    parse = PARSERS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, c in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(parse(p, bytes(c)), columns=["path", "table", "row", "col", "name", "value"])

    return files(spark, path, f"*.{kind}").mapInPandas(run, CELLS)


def as_table(cells: DataFrame, names: list[str]) -> DataFrame:
    """One chosen table's cells as rows."""
    return cells.groupBy("path", "table", "row").pivot("name", names).agg(F.first("value", ignorenulls=True))
