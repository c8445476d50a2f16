"""Registry templates as XLSX: a sheet of rows with lists to choose from, and a sheet that explains the columns.

Workbooks are written where the rows are, row by row into the packed file, so a
task holds the packed bytes of one workbook and never its rows.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.operators.registry import COLUMNS, HEADER_ALIASES, STAGES, STATUSES

# Names of the sheets, and what a column must be.
REGISTRY, INSTRUCTION = "Реестр", "Инструкция"
REQUIRED, RECOMMENDED = ("object_id", "file_name", "sha256", "doc_stage"), ("discipline", "document_code", "revision", "approval_status", "approval_date")
CHOICES = {"doc_stage": STAGES, "approval_status": STATUSES}
#: Rows that the lists to choose from cover.
LISTED_ROWS = 2000

_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
    + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in (1, 2)) + "</Types>",
    "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_NS}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{name}" sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate((REGISTRY, INSTRUCTION), 1)) + "</sheets></workbook>",
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in (1, 2)) + f'<Relationship Id="rId3" Type="{_REL}/styles" Target="styles.xml"/></Relationships>',
    # the second cell format is text, so that no program turns "1-12" into a date
    "xl/styles.xml": f'<styleSheet xmlns="{_NS}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf numFmtId="49" applyNumberFormat="1"/></cellXfs></styleSheet>',
}


def _column(n: int) -> str:
    return chr(65 + n) if n < 26 else _column(n // 26 - 1) + chr(65 + n % 26)


def _row(number: int, cells: list[str | None]) -> str:
    # characters that XML can't hold are left out
    clean = lambda v: escape("".join(c for c in v if c >= " " or c in "\t\n"))
    return f'<row r="{number}">' + "".join(f'<c r="{_column(i)}{number}" s="1" t="inlineStr"><is><t xml:space="preserve">{clean(v)}</t></is></c>' for i, v in enumerate(cells) if v) + "</row>"


def titles() -> dict[str, str]:
    """A Russian heading for each column: its first name among those that readers know."""
    return {c: next((a for a in HEADER_ALIASES.get(c, "").split("|") if "а" <= a[:1] <= "я"), c) for c in COLUMNS}


def instructions() -> list[list[str]]:
    need = lambda c: "обязательно" if c in REQUIRED else "желательно" if c in RECOMMENDED else "по необходимости"
    known = titles()
    return [["Поле", "Название", "Заполнение", "Допустимые значения"], *([c, known[c], need(c), ", ".join(CHOICES.get(c, ()))] for c in COLUMNS)]


class Workbook:
    """One workbook, written as rows come."""

    def __init__(self, heads: list[str]):
        self.bytes = io.BytesIO()
        self.zip = zipfile.ZipFile(self.bytes, "w", zipfile.ZIP_DEFLATED)
        for name, text in _PARTS.items():
            self.zip.writestr(name, _HEAD + text)
        with self.zip.open("xl/worksheets/sheet2.xml", "w") as part:
            rows = "".join(_row(n, cells) for n, cells in enumerate(instructions(), 1))
            part.write(f'{_HEAD}<worksheet xmlns="{_NS}"><sheetData>{rows}</sheetData></worksheet>'.encode())
        self.part = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.part.write(f'{_HEAD}<worksheet xmlns="{_NS}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>'.encode())
        self.rows = 0
        self.add(heads)

    def add(self, cells: list[str | None]) -> None:
        self.rows += 1
        self.part.write(_row(self.rows, cells).encode())

    def done(self) -> bytes:
        lists = "".join(f'<dataValidation type="list" allowBlank="1" showErrorMessage="1" sqref="{_column(COLUMNS.index(c))}2:{_column(COLUMNS.index(c))}{LISTED_ROWS}"><formula1>"{",".join(v)}"</formula1></dataValidation>' for c, v in CHOICES.items())
        self.part.write(f'</sheetData><dataValidations count="{len(CHOICES)}">{lists}</dataValidations></worksheet>'.encode())
        self.part.close()
        self.zip.close()
        return self.bytes.getvalue()


def template_workbooks(rows: DataFrame, key: str, order: list[str], russian: bool = False) -> DataFrame:
    """(key, content): a workbook of the registry ``rows`` of each key, in the order of the columns given.

    Headings are the columns' names, or Russian ones; readers know both. Keys
    are sorted inside partitions and a workbook is written as its rows go by.
    """
    heads = list(titles().values()) if russian else list(COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, book = None, None
        kind = None

        def finished() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([book.done()], pa.binary())], [key, "content"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if book is None or row[0] != now:
                    if book is not None:
                        yield finished()
                    now, book = row[0], Workbook(heads)
                book.add(list(row[1:]))
        if book is not None:
            yield finished()

    sorted_rows = rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order)
    return sorted_rows.select(F.col(key).alias("_key"), *(F.col(c).cast("string") for c in COLUMNS)).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, content binary")


def write_template_workbook(rows: DataFrame, path: str, order: list[str], russian: bool = False) -> None:
    """One workbook of all ``rows`` at a path or URI that pyarrow's file systems know; without rows, the empty template."""
    from pyarrow import fs

    made = template_workbooks(rows.withColumn("_book", F.lit(0)), "_book", order, russian).first()
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_output_stream(inner) as out:
        out.write(bytes(made.content) if made else Workbook(list(titles().values()) if russian else list(COLUMNS)).done())
