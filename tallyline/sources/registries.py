"""Registry files (CSV, JSON, XLSX) and the registry template."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators.registry import COLUMNS, canonical_columns

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry by its extension, with all columns as text under their canonical names."""
    kind = path.lower().rpartition(".")[2]
    readers = {"csv": _csv, "json": _json, "xlsx": _xlsx}
    if kind not in readers:
        raise ValueError(f"unknown registry format: {path}")
    return readers[kind](spark, path)


def _filled(df: DataFrame) -> DataFrame:
    rows = canonical_columns(df).select(*(F.trim(c).alias(c) for c in COLUMNS))
    return rows.where(F.concat(*COLUMNS) != "")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """The separator is ``;`` if the header has more of them than commas; empty rows are skipped."""
    head = (spark.read.text(path).limit(1).collect() or [[""]])[0][0]
    sep = ";" if head.count(";") > head.count(",") else ","
    return _filled(spark.read.csv(path, header=True, sep=sep, mode="PERMISSIVE", quote='"', escape='"', multiLine=True))


def _json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects; values aren't trimmed and empty rows stay."""
    return canonical_columns(spark.read.option("multiLine", "true").option("primitivesAsString", "true").json(path))


def _sheet_file(z: zipfile.ZipFile, sheet: str | None) -> str:
    """Where a workbook keeps the sheet of a name, without one its first sheet in the workbook's order."""
    if "xl/workbook.xml" not in z.namelist():
        return min((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    places = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for entry in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        if sheet in (None, entry.get("name")):
            return posixpath.normpath(posixpath.join("/xl", places[entry.get(_LINK)]))[1:]
    raise ValueError(f"no sheet {sheet}")


def sheet_cells(content: bytes, sheet: str | None = None) -> list[tuple[int, int, str]]:
    """(row, column, text) of a sheet of an XLSX file, the first without a name; rows and cells without a place follow the one before."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        out, number = [], 0
        for row in ElementTree.fromstring(z.read(_sheet_file(z, sheet))).iter(f"{_MAIN}row"):
            number, column = int(row.get("r") or number + 1), 0
            for cell in row.findall(f"{_MAIN}c"):
                column += 1
                if place := cell.get("r"):
                    column = 0
                    for c in place.rstrip("0123456789"):
                        column = column * 26 + ord(c) - 64
                raw = cell.findtext(f"{_MAIN}v")
                text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) if cell.get("t") == "inlineStr" else shared[int(raw)] if cell.get("t") == "s" else raw
                if text:
                    out.append((number - 1, column - 1, text))
        return out


def read_cells(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(row, column, value) of a sheet, the first without a name; one workbook, at most the upload limit in size."""
    content = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    return spark.createDataFrame(sheet_cells(content, sheet), "row int, column int, value string")


def _xlsx(spark: SparkSession, path: str) -> DataFrame:
    cells = read_cells(spark, path)
    heads = {r.column: r.value for r in cells.where("row = 0").collect()}
    if not heads:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS))
    wide = cells.where("row > 0").groupBy("row").agg(*(F.max(F.when(F.col("column") == i, F.col("value"))).alias(name) for i, name in sorted(heads.items())))
    return _filled(wide)


def write_template(rows: DataFrame, path: str) -> None:
    """The registry template as CSV with ``;`` and a byte-order mark on the header."""
    marked = rows.select(F.col(COLUMNS[0]).alias("﻿" + COLUMNS[0]), *COLUMNS[1:])
    marked.coalesce(1).write.mode("overwrite").csv(path, sep=";", header=True)
