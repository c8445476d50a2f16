"""Registry templates as workbooks, read back."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyline.operators.registry import COLUMNS
from tallyline.sources import registries, workbooks


def rows(spark):
    base = {c: "" for c in COLUMNS}
    listed = [base | {"file_name": f"{i}.pdf", "sha256": "0" * 63 + str(i % 10), "doc_stage": "PD", "revision": "1-12", "discipline": 'АР & "КР" <1>', "approval_date": "15.03.2026", "object_id": f"o{i % 3}"} for i in range(40)]
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in listed], ", ".join(f"{c} string" for c in COLUMNS))


@pytest.mark.parametrize("russian", [False, True])
def test_read_back(spark, tmp_path, russian):
    path = str(tmp_path / "t.xlsx")
    workbooks.write_template_workbook(rows(spark), path, ["file_name"], russian)
    back = registries.read_registry(spark, path)
    assert back.exceptAll(rows(spark)).count() == rows(spark).exceptAll(back).count() == 0
    heads = [r.value for r in registries.read_cells(spark, path).where("row = 0").orderBy("column").collect()]
    assert heads == (list(workbooks.titles().values()) if russian else list(COLUMNS)) and len(set(heads)) == len(COLUMNS)
    cells = registries.read_cells(spark, path, workbooks.INSTRUCTION)
    assert cells.where("column = 0").count() == len(COLUMNS) + 1 and cells.where("value = 'PD, RD, ID'").count() == 1
    sheet = zipfile.ZipFile(path).read("xl/worksheets/sheet1.xml").decode()
    assert 'sqref="D2:D2000"' in sheet and '"PD,RD,ID"' in sheet


def test_a_workbook_a_key(spark):
    made = {r.object_id: r.content for r in workbooks.template_workbooks(rows(spark), "object_id", ["file_name"]).collect()}
    assert sorted(made) == ["o0", "o1", "o2"]
    for key, content in made.items():
        cells = registries.sheet_cells(bytes(content))
        names = [v for r, c, v in cells if c == COLUMNS.index("file_name") and r]
        assert names == sorted(f"{i}.pdf" for i in range(40) if f"o{i % 3}" == key)


def test_no_rows_and_many(spark, tmp_path):
    path = str(tmp_path / "e.xlsx")
    workbooks.write_template_workbook(rows(spark).limit(0), path, ["file_name"])
    assert registries.read_registry(spark, path).count() == 0
    many = spark.range(20000).select(*(F.col("id").cast("string").alias(c) for c in COLUMNS))
    content = workbooks.template_workbooks(many.withColumn("k", F.lit(1)), "k", ["file_name"]).first().content
    assert len(registries.sheet_cells(bytes(content))) == 20001 * len(COLUMNS) and zipfile.ZipFile(io.BytesIO(content)).testzip() is None
