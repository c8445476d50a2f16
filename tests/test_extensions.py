"""Sheets by order and name, the matrix, key order, and the documented extensions on small rows."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyline.operators import extensions as X
from tallyline.sources import catalogues, documents, events, registries

_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(sheets: list[tuple[str, str, str]]) -> bytes:
    """A workbook of (name, file, rows' XML) in workbook order."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        listed = "".join(f'<sheet name="{name}" sheetId="{i}" r:id="rId{i}"/>' for i, (name, _, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Target="{"/xl/" if i % 2 else ""}{file}"/>' for i, (_, file, _) in enumerate(sheets, 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for _, file, rows in sheets:
            z.writestr(f"xl/{file}", f'<worksheet xmlns="{_NS}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def text(value: str, place: str = "") -> str:
    return f'<c t="inlineStr"{f" r={chr(34)}{place}{chr(34)}" if place else ""}><is><t>{value}</t></is></c>'


def test_sheets(spark, tmp_path):
    bare = f"<row>{text('Код')}{text('Наименование')}</row><row>{text('M-001')}{text('Площадь', 'B2')}</row><row>{text('M-015', 'A3')}{text('Надёжность')}</row>"
    content = book([("first", "worksheets/sheet2.xml", f"<row r='1'>{text('x', 'AB1')}{text('y')}</row>"), ("МАТРИЦА", "worksheets/sheet1.xml", bare)])
    assert registries.sheet_cells(content) == [(0, 27, "x"), (0, 28, "y")]
    with pytest.raises(ValueError):
        registries.sheet_cells(content, "absent")
    (tmp_path / "m.xlsx").write_bytes(content)
    rules = spark.sql("select * from values ('M-015', 'ordinal_decrease', 'reliability'), ('M-002', null, null) as t(param_code, rule_type, scale)")
    params = catalogues.read_matrix(spark, str(tmp_path / "m.xlsx")).select("code", "name").union(spark.sql("select 'M-002', 'z'"))
    assert {r.code: (r.name, r.data_type, r.scale) for r in catalogues.enrich(params, rules).collect()} == {"M-001": ("Площадь", "string", None), "M-015": ("Надёжность", "ordinal", "reliability"), "M-002": ("z", "number", None)}
    assert catalogues.active_version(spark.createDataFrame([], "matrix_version string, is_active boolean")).first()[0] == ""


def test_key_order_and_layouts(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 7).cast("string").alias("key"), (1000 - F.col("id")).alias("seq"))
    dealt = events.in_key_order(rows).withColumns({"task": F.spark_partition_id(), "at": F.monotonically_increasing_id()}).collect()
    by_key = {k: [r for r in sorted(dealt, key=lambda r: r.at) if r.key == k] for k in {r.key for r in dealt}}
    assert all(len({r.task for r in rs}) == 1 and [r.seq for r in rs] == sorted(r.seq for r in rs) for rs in by_key.values())
    for _ in range(2):
        path = documents.write_layouts(rows, str(tmp_path), "j1")
    assert spark.read.json(path).count() == 1000


def test_completeness(spark):
    sources = spark.sql("select * from values ('a', 'PD', true), ('a', 'ID', false) as t(param_code, doc_stage, required)")
    stages = spark.sql("select * from values (1, 'PD', 'UPLOADED', false), (1, 'ID', 'MISSING', null), (2, 'PD', 'MISSING', false), (3, 'PD', 'PARTIAL', true), (3, 'ID', 'UPLOADED', false), (4, 'PD', 'UPLOADED', false), (4, 'ID', 'UPLOADED', false) as t(process_id, doc_stage, upload_status, unclear)")
    pairs = spark.sql("select id as process_id, code as param_code from range(1, 6) lateral view explode(array('a', 'b')) as code")
    got = {(r.process_id, r.param_code): r.completeness_status for r in X.completeness(pairs, sources, stages).collect()}
    want = {1: "NOT_APPLICABLE", 2: "MISSING_EVIDENCE", 3: "CLARIFICATION_REQUIRED", 4: None, 5: "MISSING_EVIDENCE"}
    assert got == {(k, "a"): v for k, v in want.items()} | {(k, "b"): None for k in want}


def test_parts_and_suspicions(spark):
    found = spark.sql("select 'f' as id, 'c' as check_id, 'p' as process_id, 'CANDIDATE' as finding_status")
    parts = X.split_finding(found, spark.sql("select * from values ('f', 'one'), ('f', 'two'), ('g', 'lost') as t(parent_finding_id, comment)")).collect()
    assert sorted((r.parent_finding_id, r.comment, r.inspector_status) for r in parts) == [("f", "one", "PENDING"), ("f", "two", "PENDING")] and len({r.id for r in parts}) == 2
    both = X.with_suspicions(found, spark.sql("select 's' as id, 'p' as process_id, 0.5 as confidence"))
    assert {r.id: (r.finding_status, r.check_id) for r in both.collect()} == {"f": ("CANDIDATE", "c"), "s": ("SUSPICION", None)}
    tables = spark.sql("select * from values ('SUSPICION', 'PENDING'), ('CANDIDATE', 'CLARIFICATION_REQUIRED'), ('CANDIDATE', null), (null, 'PENDING') as t(f, i)").select(X.section(F.col("f"), F.col("i")))
    assert [r[0] for r in tables.collect()] == ["suspicions", "completeness", "candidates", None]
