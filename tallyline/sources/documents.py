"""Files to layouts: XML, DOCX and PDF.

Bytes can only be taken apart in Python, so these are ``mapInArrow`` over
``binaryFile`` rows: one file a row, no shuffle.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tallyline.sources import pdf

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def sniff_bytes(content: bytes) -> str | None:
    """pdf, docx, xml or None, as the upload check decides."""
    if content.startswith(b"%PDF-"):
        return "pdf"
    if content.startswith(b"PK\x03\x04"):
        try:
            return "docx" if "word/document.xml" in zipfile.ZipFile(io.BytesIO(content)).namelist() else None
        except zipfile.BadZipFile:
            return None
    return "xml" if content.removeprefix(b"\xef\xbb\xbf").lstrip(b" \t\r\n").startswith(b"<?xml") else None


def xml_lines(content: bytes) -> list[str]:
    """A line per element whose text before its first child isn't blank: up to three tags of its place, without namespaces, then the text.

    Lines come in the order in which elements end. The parser hands over pieces,
    so nothing but the open elements is held.
    """
    lines: list[str] = []
    open_: list[tuple[str, list[str]]] = []  # place of each open element, and its text so far
    leading = False  # whether the innermost element has had no child

    def begin(name: str, _: dict) -> None:
        nonlocal leading
        above = open_[-1][0].split("/")[-2:] if open_ else []
        open_.append(("/".join([*above, name.rpartition(" ")[2]]), []))
        leading = True

    def words(piece: str) -> None:
        if leading:
            open_[-1][1].append(piece)

    def finish(_: str) -> None:
        nonlocal leading
        place, pieces = open_.pop()
        if said := " ".join("".join(pieces).split()):
            lines.append(f"{place}: {said}")
        leading = False

    parser = expat.ParserCreate(namespace_separator=" ")
    parser.StartElementHandler, parser.CharacterDataHandler, parser.EndElementHandler = begin, words, finish
    parser.Parse(content, True)
    return lines


def sniff_worker(content: bytes) -> str:
    """pdf, docx or xml, as the parsing worker decides: any leading ``<`` is XML, any zip is DOCX, and the rest raises."""
    head = content[:1024].lstrip(b"\xef\xbb\xbf \t\r\n")
    if content.startswith(b"%PDF"):
        return "pdf"
    if content.startswith(b"PK"):
        return "docx"
    if head.startswith(b"<"):
        return "xml"
    raise ValueError("unknown format")


def docx_lines(content: bytes) -> Iterator[str]:
    """Paragraphs and table rows (cells joined by " | ") of the body, in order.

    The document is parsed as it is unpacked, and no more than a row and the one
    above it is held. A cell that spans columns counts once in its row; one that
    goes on from above has the text of the cell that it is a part of. Text is
    that of runs and of runs in links; tables inside cells are left out.
    """
    found: list[str] = []
    open_: list[str] = []
    said: list[str] = []
    above: dict[int, str] = {}
    row: dict[int, str] = {}
    cells: list[str] = []
    paragraphs: list[str] = []
    at, span, goes_on = 0, 1, False
    signs = {"tab": "\t", "cr": "\n", "noBreakHyphen": "-", "ptab": "\t"}
    in_cell = ["document", "body", "tbl", "tr", "tc"]

    def place() -> list[str]:
        return open_[:-1]

    def begin(name: str, attributes: dict) -> None:
        nonlocal at, span, goes_on, said, paragraphs, cells, row, above
        tag = name.rpartition(" ")[2]
        number = lambda other: int(attributes.get(f"{_WORD[1:-1]} val", other))
        open_.append(tag)
        where = place()
        if tag == "p" and where in (["document", "body"], in_cell):
            said = []
        elif tag == "tbl" and where == ["document", "body"]:
            above = {}
        elif tag == "tr" and where == in_cell[:3]:
            row, cells, at = {}, [], 0
        elif tag == "gridBefore" and where == [*in_cell[:4], "trPr"]:
            at = number(0)
        elif tag == "tc" and where == in_cell[:4]:
            paragraphs, span, goes_on = [], 1, False
        elif tag == "gridSpan" and where == [*in_cell, "tcPr"]:
            span = max(1, number(1))
        elif tag == "vMerge" and where == [*in_cell, "tcPr"]:
            goes_on = attributes.get(f"{_WORD[1:-1]} val", "continue") == "continue"
        elif running() and tag in signs:
            said.append(signs[tag])
        elif running() and tag == "br" and attributes.get(f"{_WORD[1:-1]} type", "textWrapping") == "textWrapping":
            said.append("\n")

    def running() -> bool:
        """Whether what is open stands in a run of a paragraph that counts."""
        where = place()
        for base in (["document", "body", "p"], [*in_cell, "p"]):
            if where[: len(base)] == base and where[len(base) :] in (["r"], ["hyperlink", "r"]):
                return True
        return False

    def words(piece: str) -> None:
        if open_[-1] == "t" and running():
            said.append(piece)

    def finish(_: str) -> None:
        nonlocal at, above
        tag = open_.pop()
        if tag == "p" and open_ == ["document", "body"]:
            found.append("".join(said).strip())
        elif tag == "p" and open_ == in_cell:
            paragraphs.append("".join(said))
        elif tag == "tc" and open_ == in_cell[:4]:
            text = above[at] if goes_on and at in above else " ".join("\n".join(paragraphs).split())
            cells.append(text)
            row.update(dict.fromkeys(range(at, at + span), text))
            at += span
        elif tag == "tr" and open_ == in_cell[:3]:
            above = row
            found.append(" | ".join(c for c in cells if c))

    parser = expat.ParserCreate(namespace_separator=" ")
    parser.StartElementHandler, parser.CharacterDataHandler, parser.EndElementHandler = begin, words, finish
    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open("word/document.xml") as part:
        while piece := part.read(1 << 16):
            parser.Parse(piece, False)
            yield from (t for t in found if t)
            found.clear()
    parser.Parse(b"", True)
    yield from (t for t in found if t)


#: A row a page: those of PDF files with boxes, one page for DOCX and XML.
FILE_PAGES = f"{pdf.PAGES}, kind string"


def pages_of_files(files: DataFrame) -> DataFrame:
    """Pages (``FILE_PAGES``) of ``files`` (path, content) of any kind, that may have page_from and page_to for PDF.

    A file is taken for what its bytes say, not its name. One that can't be
    read, and null content, gives one row with the error. A file is one row of
    one task; give large PDF files as several rows with page ranges.
    """
    ranges = [F.col(c).cast("int") if c in files.columns else F.lit(None).cast("int").alias(c) for c in ("page_from", "page_to")]
    arrow = to_arrow_schema(_parse_datatype_string(FILE_PAGES))
    empty = dict.fromkeys(f.name for f in arrow)

    def pages(path: str, content: bytes, first: int | None, last: int | None) -> Iterator[dict]:
        kind = sniff_bytes(content)
        if kind == "pdf":
            yield from (row | {"kind": kind} for row in pdf.read_pages(path, content, first, last))
            return
        try:
            if kind is None:
                raise ValueError("unknown format")
            lines = list(docx_lines(content) if kind == "docx" else xml_lines(content))
            yield empty | {"path": path, "page": 1, "n_pages": 1, "method": kind, "chars": sum(map(len, lines)), "lines": [{"text": t, "bbox": None} for t in lines], "kind": kind}
        except Exception as e:  # noqa: BLE001  a bad file is a row, not a failed job
            yield empty | {"path": path, "kind": kind, "error": f"{type(e).__name__}: {e}"[:500]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ((batch.column(c)[i].as_py() for c in range(4)) for batch in batches for i in range(len(batch)))
        yield from pdf.in_batches((row for path, content, first, last in files for row in pages(path, content or b"", first, last)), arrow)

    return files.select(F.col("path").cast("string"), F.col("content").cast("binary"), *ranges).mapInArrow(run, FILE_PAGES)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, length) of the files under ``path``, in any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", "length")


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files under ``path``; a file that can't be read gives one row with its error."""
    pages = pages_of_files(read_files(spark, path))
    each = pages.select("path", "kind", "page", F.posexplode_outer("lines").alias("line", "l"), "error")
    return each.where("l is not null or error is not null").select("path", "kind", "page", "line", F.col("l.text").alias("text"), "error")


def write_layouts(layouts: DataFrame, folder: str, job: str) -> str:
    """Layout lines of a job as JSON under a fixed key, so that a repeated job overwrites its own."""
    path = f"{folder.rstrip('/')}/layouts/job={job}"
    layouts.write.mode("overwrite").json(path)
    return path


def with_digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of files, hashed where they are read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
