"""Every query with SQL equals DuckDB on the small tables; streams are replayed."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tallyline.queries import all_queries
from tallyline.queries.streams import _envelopes
from tallyline.streaming import events as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def cell(x):
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return "~"
    return repr(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_equals_sql(spark, duck, name):
    query, sql = all_queries()[name]
    got, want = query(spark, SF).toPandas(), duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_replay_changes_nothing(spark, tmp_path):
    _envelopes(spark, SF).write.text(str(tmp_path / "in"))
    counts = []
    for _ in range(2):
        events = E.decode(spark.readStream.text(str(tmp_path / "in")))
        E.to_files(E.first_only(events.where("invalid is null")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        counts.append(spark.read.parquet(str(tmp_path / "out")).count())
        _envelopes(spark, SF).write.mode("append").text(str(tmp_path / "in"))
    assert counts[0] == counts[1] > 0


def test_failing_handler_goes_to_dead_letters(spark, tmp_path):
    _envelopes(spark, SF).limit(50).write.text(str(tmp_path / "in"))

    def broken(df):
        raise ValueError("handler")

    E.consume(E.decode(spark.readStream.text(str(tmp_path / "in"))), broken, str(tmp_path / "out"), str(tmp_path / "dead"), str(tmp_path / "state")).awaitTermination()
    dead = spark.read.parquet(str(tmp_path / "dead/batch=*"))
    assert dead.where("invalid = 'handler'").count() > 0
