"""Rule folders, workbooks, templates, schemas, SQL functions and the reconciliation plan."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyline.functions.sql import register_functions
from tallyline.operators import registry, report
from tallyline.plans import reconciliation
from tallyline.sources import catalogues, registries, schemas

SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def workbook(rows) -> bytes:
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v) + "</row>" for r, row in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", SHEET.format(body))
    return out.getvalue()


def test_rules_folder(spark, tmp_path):
    (tmp_path / "scales.yaml").write_text('# ranks\nreliability: ["III|3", "II|2", "I|1"]\n')
    (tmp_path / "M-015.yaml").write_text("# name\ncode: M-015\ntype: ordinal_decrease\nscale: reliability\n")
    (tmp_path / "M-002.yaml").write_text("code: M-002\ntype: numeric_delta_pct\npct: 1\n")
    got = {r.param_code: r for r in catalogues.read_rules(spark, str(tmp_path)).collect()}
    assert got["M-002"].pct == 1.0 and [(a["rank"], a.alias) for a in got["M-015"].aliases][:2] == [(0, "III"), (0, "3")]
    (tmp_path / "bad.yaml").write_text("type: numeric_equal\n")
    with pytest.raises(ValueError):
        catalogues.read_rules(spark, str(tmp_path))


def test_workbooks(spark, tmp_path):
    path = tmp_path / "r.xlsx"
    path.write_bytes(workbook([["Файл", "Стадия"], ["a.pdf", " РД "], [], ["b.pdf", ""]]))
    got = {r.file_name: r.doc_stage for r in registries.read_registry(spark, str(path)).collect()}
    assert got == {"a.pdf": "РД", "b.pdf": ""}
    path.write_bytes(workbook([["title"], ["Код", "Наименование", "Ед. изм."], ["M-001", "Площадь", "м²"], ["прочее", "x"], ["M-002", "Высота", ""]]))
    params = catalogues.matrix_params(registries.read_cells(spark, str(path)))
    assert sorted((r.code, r.name, r.unit) for r in params.collect()) == [("M-001", "Площадь", "м²"), ("M-002", "Высота", None)]
    assert '"matrix_version":"v1"' in catalogues.matrix_json(params, "v1").first().json
    path.write_bytes(workbook([["Код", "Наименование"], ["M-001", "a"], ["M-001", "b"]]))
    with pytest.raises(ValueError):
        catalogues.matrix_params(registries.read_cells(spark, str(path)))


def test_template_is_read_back(spark, tmp_path):
    files = spark.createDataFrame(
        [("1", "o", "a.pdf", "f" * 64, "PD", "AR", "c", "1", "APPROVED", "2026-03-15", "", "", None, "2", "ACCEPTED"), ("2", "o", "b.pdf", "e" * 64, "PD", "AR", "c", "2", "DRAFT", None, "", "", "1", None, "REJECTED_SIZE")],
        "file_id string, object_id string, file_name string, sha256 string, doc_stage string, discipline string, document_code string, revision string, approval_status string, approval_date string, sheet_page_range string, signature_status string, predecessor_id string, successor_id string, check_status string",
    ).withColumn("approval_date", F.to_date("approval_date"))
    registries.write_template(registry.template(files), str(tmp_path / "t.csv"))
    got = registry.normalize_rows(registries.read_registry(spark, str(tmp_path / "t.csv"))).collect()
    assert [(r.file_name, r.approval_date, r.successor_ref, r.object_id) for r in got] == [("a.pdf", "2026-03-15", "b.pdf", "o")]


def test_schemas_and_functions(spark):
    df = spark.createDataFrame([("PD",), ("XX",), (None,)], "doc_stage string")
    assert [r.doc_stage for r in schemas.violations(df, {"doc_stage": "doc_stage"}).collect()] == ["XX"]
    for ddl in schemas.TABLES.values():
        assert spark.createDataFrame([], ddl).count() == 0
    assert "pct_of" in register_functions(spark)
    row = spark.sql("select parse_number('1 250,5 м²') a, normalize_token(' в30,5') b, normalize_text('A-б!') c, pct_of(0D, 1D) d").first()
    assert (row.a, row.b, row.c, row.d) == (1250.5, "B30.5", "a б", float("inf"))


def test_lines_to_protocol(spark):
    lines = spark.createDataFrame(
        [("pd", 1, 0, "Площадь застройки — 1 250,5 м²"), ("rd", 1, 0, "Площадь застройки 1200 м²"), ("pd", 1, 1, "Бетон класса В25"), ("rd", 1, 1, "Бетон класса В30"), ("rd", 1, 2, "Высота порога 0,02 м"), ("xx", 1, 0, "Этажность 5")],
        "id string, page int, line int, text string",
    ).selectExpr("*", "cast(null as array<double>) as bbox", "cast(null as string) as next_text", "cast(null as array<double>) as next_bbox")
    files = spark.createDataFrame([("pd", "p", "PD"), ("rd", "p", "RD"), ("xx", "p", None)], "file_id string, process_id string, stage string")
    found = reconciliation.findings_of_facts(reconciliation.facts_of_lines(lines, files))
    got = {r.param_code: (r.finding_status, r.delta, r.place) for r in reconciliation.protocol_of(found).collect()}
    assert got == {"M-001": ("CANDIDATE", "-50.5", 1), "M-118": ("CANDIDATE", None, 2), "M-055": ("NEGATIVE_VERIFIED", None, 3)}


def test_outbox(spark):
    rows = [("a", "pending", 1), ("b", "published", 1), ("c", "failed", 0), ("d", "publishing", 0)]
    df = spark.createDataFrame(rows, "event_id string, status string, t int").select("event_id", "status", *(F.timestamp_seconds("t").alias(c) for c in ("available_at", "created_at", "locked_at")))
    assert [r.event_id for r in report.claimable(df, F.timestamp_seconds(F.lit(5))).collect()] == ["c", "a"]
    assert {r.event_id: r.status for r in report.requeue_stuck(df, F.timestamp_seconds(F.lit(200))).collect()}["d"] == "pending"


def test_contract_odd_values(spark):
    """Escaped, infinite and empty values, names with signs, and a document that is read once."""
    from tallyline.sources.contracts import first_error

    schema = {"type": "object", "required": ["s"], "additionalProperties": False, "properties": {"s": {"type": "string", "minLength": 3, "pattern": "^a.c"}, "n": {"type": ["number", "null"], "maximum": 1}, "i": {"type": "integer"}, "u": {"type": "string", "format": "uuid"}, "l": {"type": "array", "items": {"enum": ["x", True, None, 2]}}}}
    want = {
        '{"s":"a\\tc"}': None, '{"s":"a\\""}': "s: minLength", '{"s":"abd"}': "s: pattern", '{"s":"abc","n":1e400}': "n: maximum", '{"s":"abc","n":"Infinity"}': "n: type", '{"s":"abc","n":-1e400}': None,
        '{"s":"abc","n":null}': None, '{"s":"abc","i":2.0}': None, '{"s":"abc","i":2.5}': "i: type", '{"s":"abc","u":"x"}': "u: format", '{"s":"abc","l":["x",true,null,2,"true"]}': "l/4: enum", '{"s":"abc","l":[]}': None,
        '{"s":"abc","l":{}}': "l: type", "{}": "<root>: required s", "[]": "<root>: type", "3": "<root>: type", '{"s":null}': "s: type", '{"s":"abc","z":1}': "<root>: additionalProperties",
    }
    df = spark.createDataFrame(list(want.items()), "v string, want string")
    got = df.select("v", "want", first_error(F.parse_json("v"), schema).alias("got"))
    assert [r for r in got.collect() if r.got != r.want] == []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") + plan.count("parse_json") == 1


def test_contract_laid_out(spark):
    """Places as columns give what the one expression gives, on odd values too, and fields need no lambdas: these are interpreted."""
    from tallyline.sources import contracts as C

    leaf = {"s": {"type": "string", "minLength": 3, "pattern": "^a.c"}, "n": {"type": ["number", "null"], "maximum": 1}, "t": {"type": ["string", "null"]}, "b": {"type": "boolean"}, "e": {"enum": ["x", True, None, 2]}, "r": {"type": "number"}, "y": {"type": "array"}}
    inner = {"type": ["object", "null"], "required": ["s", "q"], "properties": leaf, "additionalProperties": False}
    schema = {"type": "object", "additionalProperties": False, "properties": {**leaf, "o": inner, "l": {"type": "array", "minItems": 1, "maxItems": 3, "items": leaf["n"]}, "m": {"type": "array", "items": inner}}}
    values = ["1", "2", "2.5", "1e400", "-1e400", "1e3", '"a"', '"abc"', '"a\\tc"', '"a\\"\\"\\""', '"Infinity"', '"NaN"', '"x"', "true", "null", "{}", "[]", "[1,2]", '["a"]', "[null,0,1e400]", "[1,1,1,1]", '{"s":"abc","q":1}', '{"s":"abc"}', '[{"s":"abc"},3]', '{"s":"abc","z":0}']
    rows = [f'{{"{name}":{v}}}' for name in (*schema["properties"], "z") for v in values] + [f'{{"o":{{"s":"abc","{name}":{v}}}}}' for name in leaf if name != "s" for v in values] + ["{}", "[]", "3", "null", '"a"', None]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    got = C.with_first_error(df, F.parse_json("v"), schema, "got")
    assert got.columns == ["v", "got"]
    both = got.withColumn("want", C.first_error(F.parse_json("v"), schema)).collect()
    assert [r for r in both if r.got != r.want] == [] and len({r.want for r in both}) > 20

    laid = C.with_first_error(df, F.parse_json("v"), {"type": "object", "properties": {f"f{i}": leaf["s"] for i in range(20)}}, "got")
    plan = laid._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("parseJson") + plan.count("parse_json") == 1
