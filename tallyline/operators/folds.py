"""Ordered folds: per key, rows in order go through a step that keeps a small state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

_EMPTY = object()


def ordered_fold(rows: DataFrame, key: str, order: list[Column], start: Callable[[Any], Any], step: Callable[[Any, dict], Iterator[dict]], schema: str) -> DataFrame:
    """What ``step(state, row)`` yields for the rows of each key in ``order``; ``start(key)`` makes a key's state.

    One shuffle by key, a sort inside partitions, then a pass that holds a batch
    of rows and the state of one key: a key's rows are never gathered, however
    many it has. Ties of ``order`` must be broken by the caller.
    """
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    assert isinstance(rows.schema, StructType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = _EMPTY, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[key] != now:
                    now = row[key]
                    state = start(now)
                out += step(state, row)
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
