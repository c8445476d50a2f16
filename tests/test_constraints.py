"""Constraints of the reconciliation tables on a few broken rows."""

from __future__ import annotations

from pyspark.sql.types import _parse_datatype_string

from tallyline.operators import constraints as C
from tallyline.sources import schemas


def table(spark, name, *rows):
    schema = _parse_datatype_string(schemas.TABLES[name])
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def test_all_tables_are_declared(spark):
    assert len(schemas.TABLES) == 28 == len(schemas.KEYS)
    for name, keys in schemas.KEYS.items():
        columns = {f.name for f in _parse_datatype_string(schemas.TABLES[name])}
        assert columns >= set(keys.replace("|", " ").split())
    for c in C.declared():
        assert c.table in schemas.TABLES
        if isinstance(c, C.Reference):
            assert {f.name for f in _parse_datatype_string(schemas.TABLES[c.parent])} >= set(c.parent_columns)
    assert C.violations({name: table(spark, name) for name in ("users", "audit_log", "files")}, C.declared()).count() == 0


def test_broken_rows(spark):
    tables = {
        "objects": table(spark, "objects", {"id": "o"}),
        "processes": table(spark, "processes", {"id": "p", "object_id": "o", "status": "READY"}, {"id": "q", "object_id": "lost", "status": "ODD", "scenario": "FULL"}, {"id": "r"}),
        "files": table(spark, "files", {"file_id": "f", "process_id": "p", "sha256": "x", "predecessor_id": "g"}, {"file_id": "g", "process_id": "p", "sha256": "x", "doc_stage": "PD"}, {"file_id": "g", "process_id": "q", "sha256": None, "successor_id": "h"}, {"file_id": "i", "process_id": "q", "sha256": None}),
        "dispute_log": table(spark, "dispute_log", {"id": "d", "resolved_by": "nobody"}),
    }
    got = {tuple(r) for r in C.violations(tables, C.declared()).collect()}
    assert got == {
        ("processes", "object_id references objects", "lost", 1), ("processes", "status in process_status", "q", 1), ("files", "unique file_id", "g", 2), ("files", "unique process_id sha256", "p|x", 2), ("files", "successor_id references files", "h", 1),
    }
