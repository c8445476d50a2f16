"""Constraints of tables as one plan: rows whose values aren't allowed, keys that repeat, references that lead nowhere."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.sources import schemas


@dataclass(frozen=True)
class Unique:
    """No two rows share these columns; rows with a null among them are free, as in SQL."""

    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Reference:
    """Values of these columns are found among the parent's; rows with a null among them are free."""

    table: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class Check:
    """``holds`` isn't false on any row; null passes."""

    table: str
    name: str
    holds: Column
    key: tuple[str, ...]


Constraint = Unique | Reference | Check


def _shown(columns: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns))


def _row(df: DataFrame, table: str, name: Column | str, key: Column, n: Column) -> DataFrame:
    return df.select(F.lit(table).alias("table"), (F.lit(name) if isinstance(name, str) else name).alias("constraint"), key.alias("key"), n.cast("long").alias("n"))


def violations(tables: dict[str, DataFrame], constraints: list[Constraint]) -> DataFrame:
    """(table, constraint, key, n): each broken key or value with the number of its rows.

    The checks of a table are one pass over it. Keys are counted before they
    meet: repeated ones by an aggregate that combines where the rows are,
    references by an anti-join of the distinct values, so that neither a hot key
    nor a wide row goes through a shuffle. Tables that aren't given are passed over.
    """
    out = []
    for name, df in tables.items():
        checks = [c for c in constraints if isinstance(c, Check) and c.table == name]
        for key in dict.fromkeys(c.key for c in checks):
            broken = F.array_compact(F.array(*(F.when(~c.holds, F.lit(c.name)) for c in checks if c.key == key)))
            each = df.select(_shown(key).alias("key"), F.explode(broken).alias("name"))
            out.append(_row(each.groupBy("name", "key").agg(F.count(F.lit(1)).alias("n")), name, F.col("name"), F.col("key"), F.col("n")))
    for c in constraints:
        if c.table not in tables or isinstance(c, Check):
            continue
        known = tables[c.table].dropna(subset=list(c.columns)).groupBy(*c.columns).agg(F.count(F.lit(1)).alias("n"))
        if isinstance(c, Unique):
            out.append(_row(known.where("n > 1"), c.table, f"unique {' '.join(c.columns)}", _shown(c.columns), F.col("n")))
        elif c.parent in tables:
            parent = tables[c.parent].select(*(F.col(p).alias(f"_{i}") for i, p in enumerate(c.parent_columns))).distinct()
            lost = known.join(parent, [F.col(x) == F.col(f"_{i}") for i, x in enumerate(c.columns)], "left_anti")
            out.append(_row(lost, c.table, f"{' '.join(c.columns)} references {c.parent}", _shown(c.columns), F.col("n")))
    if not out:
        raise ValueError("no constraint has its table")
    return reduce(DataFrame.unionByName, out)


def declared() -> list[Constraint]:
    """The constraints of the reconciliation tables: keys, references and value lists."""
    out: list[Constraint] = []
    for table, keys in schemas.KEYS.items():
        out += [Unique(table, tuple(k.split())) for k in keys.split("|")]
    for table, listed in schemas.REFERENCES.items():
        for item in listed.split():
            column, _, to = item.partition(">")
            parent, _, of = to.partition(".")
            out.append(Reference(table, (column,), parent, (of,)))
    for table, listed in schemas.LISTED.items():
        for item in listed.split():
            column, _, kind = item.partition("=")
            out.append(Check(table, f"{column} in {kind}", schemas.allowed(kind, F.col(column)), tuple(schemas.KEYS[table].split("|")[0].split())))
    return out
