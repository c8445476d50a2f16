"""Rule vectors, scales and number parsing."""

from __future__ import annotations

import math
import uuid

import pytest
from pyspark.sql import functions as F

from tallyline.functions import scalars as S
from tallyline.operators import rules as R
from tallyline.plans import catalogue

VECTORS = [
    ("M-001", "100", "90", "CANDIDATE", "-10"),
    ("M-001", "1 250,5 м²", "1250.5", "NEGATIVE_VERIFIED", None),
    ("M-001", "abc", "1", "NOT_COMPARABLE", None),
    ("M-001", " ", "1", "MISSING_EVIDENCE", None),
    ("M-002", "100", "101", "NEGATIVE_VERIFIED", None),
    ("M-002", "100", "101.1", "CANDIDATE", "1.1"),
    ("M-002", "0", "0", "NEGATIVE_VERIFIED", None),
    ("M-002", "0", "1", "CANDIDATE", "1"),
    ("M-003", "10", "9", "CANDIDATE", "-1"),
    ("M-003", "10", "11", "NEGATIVE_VERIFIED", None),
    ("M-132", "100", "104", "NEGATIVE_VERIFIED", None),
    ("M-132", "100", "106", "CANDIDATE", "6"),
    ("M-008", "10", "10.1", "CANDIDATE", "0.1"),
    ("M-041", None, "0.9", "NEGATIVE_VERIFIED", None),
    ("M-041", None, "0.8", "CANDIDATE", None),
    ("M-041", "1", "", "MISSING_EVIDENCE", None),
    ("M-118", None, "0.02", "CANDIDATE", None),
    ("M-118", None, "0.014", "NEGATIVE_VERIFIED", None),
    ("M-055", "В30", "B25", "CANDIDATE", None),
    ("M-055", "B25", "В30 W6", "NEGATIVE_VERIFIED", None),
    ("M-055", "B30W6", "B30", "NEGATIVE_VERIFIED", None),
    ("M-055", "B99", "B30", "NOT_COMPARABLE", None),
    ("M-057", "A500C", "А400", "CANDIDATE", None),
    ("M-022", "II", "III", "CANDIDATE", None),
    ("M-022", "2", "II", "NEGATIVE_VERIFIED", None),
    ("M-021", "A+", "A++", "NEGATIVE_VERIFIED", None),
    ("M-052", "RAL 9003, матовый", "ral 9003 матовый!", "NEGATIVE_VERIFIED", None),
    ("M-052", "RAL 9003", "RAL 9005", "CANDIDATE", None),
    ("M-999", "1", "1", "NOT_COMPARABLE", None),
]


def test_vectors(spark):
    df = spark.createDataFrame([(i, *v[:3]) for i, v in enumerate(VECTORS)], "i int, param_code string, expected string, actual string")
    got = {r.i: r for r in R.evaluate(df, catalogue.rules(spark)).collect()}
    assert [(v[0], v[1], v[2], got[i].finding_status, got[i].delta) for i, v in enumerate(VECTORS)] == VECTORS
    assert got[13].expected_value is None and got[13].actual_value == "0.9"
    assert got[3].actual_value is None and got[28].expected_value is None


def test_unknown_type_comes_before_blanks(spark):
    row = spark.range(1).select(R.status_of(F.lit("presence"), F.lit(None).cast("string"), F.lit(None).cast("string"), *[F.lit(0.0)] * 3).alias("s")).first()
    assert row.s == "NOT_COMPARABLE"


def test_catalogue_is_whole():
    rows = catalogue.rule_rows()
    assert len(rows) == len({r[0] for r in rows}) == 71
    assert all((r[1] == "ordinal_decrease") == (r[6] is not None) for r in rows)
    assert len(catalogue.SCALES["concrete"]) == 13


@pytest.mark.parametrize("text,value", [("1 250,5", 1250.5), ("5 / 6", 5.0), ("12 34", 1234.0), ("-10 м", -10.0), ("1 000", 1000.0), ("нет", None), ("", None)])
def test_parse_number(spark, text, value):
    assert spark.range(1).select(S.parse_number(F.lit(text)).alias("x")).first().x == value


def test_numbers_as_text(spark):
    values = [-10.0, 1250.5, 0.0, 100.0, 1e7, 12345678.0, 1e-7, 0.014, -0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(S.fmt_num(F.col("v")).alias("t"))
    assert [r.t for r in df.collect()] == ["-10", "1250.5", "0", "100", "10000000", "12345678", "0.0000001", "0.014", "0"]


def test_pct_of(spark):
    row = spark.range(1).select(S.pct_of(F.lit(0.0), F.lit(1.0)).alias("a"), S.pct_of(F.lit(-50.0), F.lit(-40.0)).alias("b")).first()
    assert math.isinf(row.a) and row.b == 20


def test_uuid5_equals_the_standard(spark):
    ns = S.FACT_NAMESPACE
    names = ["a|b|M-001|1|цитата", "", "x" * 300]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(S.uuid5(F.col("n")).alias("u")).collect()
    assert [r.u for r in got] == [str(uuid.uuid5(uuid.UUID(ns), n)) for n in names]


@pytest.mark.parametrize("text,iso", [("2026-03-15", "2026-03-15"), ("15.03.2026", "2026-03-15"), ("5.3.2026", "2026-03-05"), ("5/3/2026", "2026-03-05"), ("15.03.26", "2026-03-15"), ("2026-03-15T10:00:00Z", "2026-03-15"), ("2026-03-15 10:00:00", "2026-03-15"), ("15.03.2026 г.", None), ("soon", None)])
def test_dates(spark, text, iso):
    got = spark.range(1).select(S.parse_date(F.lit(text)).cast("string").alias("d")).first().d
    assert got == iso


def test_units_and_boxes(spark):
    row = spark.range(1).select(
        S.to_matrix_unit(F.lit(800.0), F.lit("мм"), F.lit("м")).alias("a"),
        S.to_matrix_unit(F.lit(5.0), F.lit("кв. м."), F.lit("м²")).alias("b"),
        S.canon_unit(F.lit(" КВ. М. ")).alias("c"),
        S.norm_bbox(*map(F.lit, (-5.0, 10.0, 5.0, 10.0, 10.0, 100.0))).alias("d"),
        S.union_bbox(F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.4))), F.lit(None).cast("array<double>")).alias("e"),
    ).first()
    assert (row.a, row.b, row.c) == (0.8, 5.0, "м²")
    assert row.d == [0.0, 0.1, 0.5, 0.1001] and row.e == [0.1, 0.2, 0.3, 0.4]
