"""PDF pages by data source and by column, DOCX tables, and the way from files to findings."""

from __future__ import annotations

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tallyline.operators import layout
from tallyline.plans import reconciliation
from tallyline.queries.files import pdf_bytes
from tallyline.sources import documents, pdf

TEP = ["Технико-экономические показатели", "Площадь застройки — 1 250,5 м²", "Общая площадь здания: 8 400 м²", "Количество этажей: 9"]


def packed_pdf(content: str, font: str, extra: str = "", page: str = "") -> bytes:
    """A PDF whose objects lie in an object stream, found by a cross-reference stream with row predictors."""
    inner = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Count 1 /Kids [3 0 R] >>", 3: f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 200 100] /Contents 6 0 R /Resources << /Font << /F1 4 0 R >> /XObject << /X1 7 0 R >> >> {page} >>", 4: font}
    offsets, body = [], ""
    for number, text in inner.items():
        offsets.append(f"{number} {len(body)}")
        body += text + " "
    head = " ".join(offsets) + " "
    out, places = bytearray(b"%PDF-1.7\n"), {}

    def stream(number: int, info: str, data: bytes) -> None:
        places[number] = len(out)
        squeezed = zlib.compress(data)
        out.extend(f"{number} 0 obj << {info} /Filter /FlateDecode /Length {len(squeezed)} >> stream\r\n".encode() + squeezed + b"\r\nendstream endobj\n")

    stream(5, f"/Type /ObjStm /N {len(inner)} /First {len(head)}", (head + body).encode())
    stream(6, "", content.encode("latin-1"))
    stream(7, "/Type /XObject /Subtype /Form /Matrix [1 0 0 1 0 -40]", extra.encode("latin-1"))
    rows = [(0, 0, 255)] + [(2, 5, i) for i in range(4)] + [(1, places[n], 0) for n in (5, 6, 7)] + [(1, len(out), 0)]
    flat = [bytes([kind]) + at.to_bytes(3, "big") + bytes([rest]) for kind, at, rest in rows]
    up, above = b"", bytes(5)
    for row in flat:
        up += b"\2" + bytes((a - b) & 255 for a, b in zip(row, above))
        above = row
    squeezed, at = zlib.compress(up), len(out)
    out.extend(f"8 0 obj << /Type /XRef /Size 9 /W [1 3 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 5 >> /Length {len(squeezed)} >> stream\n".encode() + squeezed + b"\nendstream endobj\n")
    return bytes(out) + f"startxref\n{at}\n%%EOF".encode()


LATIN = "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /afii10017 /afii10065 /uni00B2 /eacute] >> /FirstChar 32 /Widths [" + " ".join(["500"] * 200) + "] >>"


def test_text_operators():
    content = r"BT /F1 10 Tf 20 80 Td (A\(b\) \101) Tj 0 -20 Td [(one) -2000 (two) 50 (x)] TJ 10 TL T* <01020304> ' ET q 2 0 0 1 0 0 cm BT /F1 10 Tf 1 0 0 1 20 10 Tm (wide) Tj ET Q /X1 Do BI /W 1 ID (Tj) EI"
    page = next(pdf.read_pages("p", packed_pdf(content, LATIN, "BT /F1 10 Tf 100 80 Td (form) Tj ET")))
    assert page["error"] is None and (page["n_pages"], page["width"], page["height"], page["method"]) == (1, 200.0, 100.0, "needs_ocr")
    said = {x["text"]: x["bbox"] for x in page["lines"]}
    assert list(said) == ["A(b) A", "one twox", "Аа²é form", "wide"]
    assert said["wide"] == [0.2, 0.82, 0.4, 0.92] and said["A(b) A"][:2] == [0.1, 0.12]
    assert [b[1] for b in said.values()] == sorted(b[1] for b in said.values())


def test_turned_page():
    page = next(pdf.read_pages("p", packed_pdf("BT /F1 10 Tf 0 1 -1 0 50 20 Tm (up) Tj ET", LATIN, page="/Rotate 90")))
    assert (page["width"], page["height"]) == (100.0, 200.0) and [x["text"] for x in page["lines"]] == ["up"]
    x0, y0, x1, y1 = page["lines"][0]["bbox"]
    assert 0 <= x0 < x1 <= 1 and 0 <= y0 < y1 <= 1 and round((x1 - x0) * 100, 3) == 10.0


def test_page_range_and_scans():
    data = pdf_bytes([[f"Страница номер {i} " + "текст " * 8] for i in range(1, 6)])
    assert [p["page"] for p in pdf.read_pages("p", data, 2, 3)] == [2, 3]
    assert [p["page"] for p in pdf.read_pages("p", data, 4, 99)] == [4, 5]
    assert [p["page"] for p in pdf.read_pages("p", data, 0, None)] == [1, 2, 3, 4, 5]
    parts = [[p["page"] for p in pdf.read_pages("p", data, share=(i, 3))] for i in range(3)]
    assert sorted(sum(parts, [])) == [1, 2, 3, 4, 5]
    assert [p["method"] for p in pdf.read_pages("p", pdf_bytes([TEP, []]))] == ["vector_text", "needs_ocr"]


@pytest.mark.parametrize("broken", [b"", b"MZ", b"%PDF-1.4 nothing", pdf_bytes([TEP])[:400], pdf_bytes([TEP]).replace(b"/Kids", b"/Kidz").replace(b"/Pages 2", b"/Pages 9"), pdf_bytes([TEP]).replace(b"/Root", b"/Encrypt << >> /Root")])
def test_broken_files_are_rows(broken):
    rows = list(pdf.read_pages("p", broken))
    assert len(rows) == 1 and rows[0]["error"].startswith("REJECTED_CORRUPTED") and rows[0]["page"] is None


def test_data_source(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.pdf").write_bytes(pdf_bytes([[f"Документ {i}", *TEP]] * (i + 1)))
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "_hidden").write_bytes(b"x")
    spark.dataSource.register(pdf.PdfPages)
    whole = spark.read.format("pdf_pages").load(str(tmp_path))
    key = F.concat_ws(":", F.element_at(F.split("path", "/"), -1), F.coalesce("page", F.lit(0)), F.size("lines"))
    want = sorted([f"{i}.pdf:{p}:5" for i in range(5) for p in range(1, i + 2)] + ["bad.pdf:0"])
    assert sorted(r[0].removesuffix(":-1") for r in whole.select(key).collect()) == want
    split = spark.read.format("pdf_pages").option("splitBytes", "400").load(str(tmp_path))
    assert sorted(r[0].removesuffix(":-1") for r in split.select(key).collect()) == want and split.rdd.getNumPartitions() > 6
    assert sorted(r.page for r in spark.read.format("pdf_pages").option("pages", "2-3").load(str(tmp_path)).where("page is not null").collect()) == [2, 2, 2, 2, 3, 3, 3]
    files = documents.read_files(spark, str(tmp_path)).where("path like '%.pdf'")
    both = pdf.pages_of(files).select(F.element_at(F.split("path", "/"), -1).alias("f"), "page", "chars", "lines", "error")
    assert both.exceptAll(whole.select(F.element_at(F.split("path", "/"), -1).alias("f"), "page", "chars", "lines", "error")).count() == 0


WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def cell(*paragraphs: str, props: str = "") -> str:
    return f"<w:tc><w:tcPr>{props}</w:tcPr>" + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "</w:tc>"


def test_docx_tables():
    down, on = '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    nested = "<w:tbl><w:tr>" + cell("inside") + "</w:tr></w:tbl>"
    rows = [
        cell("Показатель", props='<w:gridSpan w:val="2"/>') + cell("Ед."),
        cell("Площадь", props=down) + cell("общая") + cell("м²"),
        cell("", props=on) + cell("жилая", "полная") + cell("м²"),
        cell("", props=on) + cell("", props='<w:gridSpan w:val="2"/>'),
        "<w:trPr><w:gridBefore w:val=\"1\"/></w:trPr>" + cell("сдвиг") + cell("x"),
        cell(""),
    ]
    table = "<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>"
    first = '<w:p><w:r><w:t>Пояснительная </w:t><w:tab/><w:t>записка</w:t></w:r><w:hyperlink><w:r><w:t xml:space="preserve"> ссылка</w:t></w:r></w:hyperlink><w:ins><w:r><w:t>нет</w:t></w:r></w:ins></w:p>'
    assert list(documents.docx_lines(docx(first + table + "<w:p/>" + f"<w:tbl><w:tr><w:tc>{nested}<w:p><w:r><w:t>a</w:t><w:br/><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"))) == [
        "Пояснительная \tзаписка ссылка", "Показатель | Ед.", "Площадь | общая | м²", "Площадь | жилая полная | м²", "Площадь", "сдвиг | x", "a b",
    ]


def test_docx_of_many_rows():
    rows = "".join(f"<w:tr>{cell(f'строка {i}')}{cell(str(i))}</w:tr>" for i in range(20000))
    got = list(documents.docx_lines(docx(f"<w:tbl>{rows}</w:tbl>")))
    assert len(got) == 20000 and got[-1] == "строка 19999 | 19999"


def test_files_to_findings(spark, tmp_path):
    for name, data in {
        "1-PD.pdf": pdf_bytes([TEP, ["Высота здания: 30 м", "и ещё несколько слов на этой странице"]]),
        "1-RD.docx": docx("<w:p><w:r><w:t>Общая площадь здания: 8 000 м²</w:t></w:r></w:p><w:tbl><w:tr>" + cell("Высота здания") + cell("31 м") + "</w:tr></w:tbl>"),
        "2-PD.pdf": pdf_bytes([["Высота здания: 30 м"]]),  # too few characters: no text layer
        "2-ID.xml": '<?xml version="1.0" encoding="utf-8"?><a><b>Высота здания: 31 м</b></a>'.encode(),
        "3-PD.pdf": b"%PDF-1.7 broken",
    }.items():
        (tmp_path / name).write_bytes(data)
    pages = documents.pages_of_files(documents.read_files(spark, str(tmp_path)))
    name = F.element_at(F.split("path", "/"), -1)
    files = documents.read_files(spark, str(tmp_path)).select("path", name.alias("file_id"), F.substring(name, 1, 1).alias("process_id"), F.substring(name, 3, 2).alias("stage"))
    graded = {r.id: r.quality for r in layout.file_quality(pages.withColumn("id", name)).collect()}
    assert graded == {"1-PD.pdf": "OK", "1-RD.docx": "OK", "2-PD.pdf": "ABSTAIN", "2-ID.xml": "OK", "3-PD.pdf": "FAILED"}
    facts = {(r.file_id, r.param_code): r for r in reconciliation.facts_of_pages(pages, files).collect()}
    assert facts["1-PD.pdf", "M-008"].page == 2 and facts["1-PD.pdf", "M-008"].method == "vector_text" and facts["1-RD.docx", "M-008"].bbox == [0.0, 0.0, 1.0, 1.0]
    assert not any(f.startswith(("2-PD", "3-PD")) for f, _ in facts)
    got = {(r.process_id, r.param_code): (r.place, r.finding_status, r.delta) for r in reconciliation.protocol_of_files(pages, files).collect()}
    assert got["1", "M-002"] == (1, "CANDIDATE", "-400") and got["1", "M-008"] == (2, "CANDIDATE", "1") and got["2", "M-008"] == (1, "MISSING_EVIDENCE", None)
    lines = {(r.path.rpartition("/")[2], r.line): (r.text, r.error) for r in documents.read_layouts(spark, str(tmp_path)).collect()}
    assert lines["2-ID.xml", 0] == ("a/b: Высота здания: 31 м", None) and lines["3-PD.pdf", None][1].startswith("REJECTED_CORRUPTED")


def test_plain_pages_equal_those_put_in_order_glyph_by_glyph(monkeypatch):
    two = "BT /F1 10 Tf 20 80 Td (right ) Tj ( left) Tj 0 -30 Td <2041> Tj ET 1 0 0 1 0 0 cm"
    files = [pdf_bytes([TEP, [" ", "  в начале  и в конце ", "𝔘 и é"], []]), packed_pdf(two, LATIN), packed_pdf("BT /F1 10 Tf 20 80 Td <4142> Tj 0 -20 Td <43> Tj ET", LATIN)]
    plain = [list(pdf.read_pages("p", f)) for f in files]
    assert plain[0][0]["lines"][1]["text"] == TEP[1] and [x["text"] for x in plain[2][0]["lines"]] == ["AB", "C"]
    monkeypatch.setattr(pdf, "_plain_lines", lambda *_: None)
    monkeypatch.setattr(pdf.Font, "run", lambda *_: None)
    assert plain == [list(pdf.read_pages("p", f)) for f in files]


def test_contents_of_words_equal_those_read_one_by_one():
    def one_by_one(body):
        at, item = 0, None
        while item != b"":
            item, at = pdf.value(body, at)
            yield item

    for body in (b"BT /F1 11.0 Tf -.5 +3 Td <0041>Tj<42> ' T* ET", b"<0041 0042> Tj", b"<004> Tj", b"1 0 R x", b"/ 1 Tf", b"q 1-2 5. true null", b"[<41> -20 (b)] TJ % end\nET", b""):
        assert [(type(x), x) for x in pdf._content(body)] == [(type(x), x) for x in one_by_one(body)]


def test_pages_of_small_files_share_batches():
    row = {"path": "p", "page": 1, "n_pages": 1, "method": "vector_text", "width": 1.0, "height": 1.0, "chars": 2, "lines": [{"text": "ab", "bbox": [0.0, 0.0, 1.0, 1.0]}, {"text": "c", "bbox": None}], "error": None}
    rows = [row | {"path": str(i)} for i in range(300)] + [row | {"lines": None, "chars": None, "error": "x"}]
    import pyarrow as pa

    line = pa.struct([("text", pa.string()), ("bbox", pa.list_(pa.float64()))])
    schema = pa.schema([("path", pa.string()), ("page", pa.int32()), ("n_pages", pa.int32()), ("method", pa.string()), ("width", pa.float64()), ("height", pa.float64()), ("chars", pa.int32()), ("lines", pa.list_(line)), ("error", pa.string())])
    batches = list(pdf.in_batches(iter(rows), schema))
    assert [len(b) for b in batches] == [301] and batches[0].to_pylist() == rows
    assert len(list(pdf.in_batches(iter(rows), schema, chars=100))) == 7


def test_protocol_reads_each_file_once(spark):
    files = spark.createDataFrame([("a", bytearray(pdf_bytes([TEP])))], "path string, content binary")
    known = spark.createDataFrame([("a", "f", 1, "PD")], "path string, file_id string, process_id long, stage string")
    plan = reconciliation.protocol_of_files(documents.pages_of_files(files), known)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
