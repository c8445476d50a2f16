"""Rule, scale, matrix and fact files."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.scalars import CYRILLIC, LATIN

FACT_SCHEMA = (
    "fact_id string, process_id string, file_id string, file_sha256 string, stage string, param_code string, rule_code string, element_key string, "
    "value_raw string, value_norm string, unit string, page int, bbox array<double>, quote string, confidence double, method string, quality string, "
    "has_change_notice boolean, extractor_version string"
)
_KEYS = {"type": "rule_type", "pct": "pct", "threshold": "threshold", "tolerance_pct": "tolerance_pct", "scale": "scale", "code": "param_code"}


def token(text: str) -> str:
    """Driver-side twin of ``normalize_token`` for the few entries of a scale."""
    return text.strip().upper().translate(str.maketrans(CYRILLIC + ",", LATIN + "."))


def _flat_yaml(text: str) -> dict[str, str]:
    """The flat ``key: value`` subset of YAML that rule files use; anything else is an error."""
    out = {}
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not line:
            continue
        m = re.fullmatch(r"([A-Za-z_]+):\s*(.+)", line)
        if not m:
            raise ValueError(f"not a rule line: {line!r}")
        out[m[1]] = m[2].strip().strip("\"'")
    return out


def read_scales(spark: SparkSession, path: str) -> dict[str, list[tuple[int, str]]]:
    text = spark.read.text(path, wholetext=True).first()[0]
    return {k: [(rank, token(a)) for rank, entry in enumerate(re.findall(r"\"([^\"]*)\"", v)) for a in entry.split("|")] for k, v in _flat_yaml(text).items()}


def read_rules(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.yaml`` of a folder but scales.yaml; one bad file fails the whole load. Of several files of a code the last by name counts."""
    from tallyline.plans.catalogue import RULE_SCHEMA

    known = read_scales(spark, f"{folder}/scales.yaml")
    files = spark.read.text(f"{folder}/*.yaml", wholetext=True).select("value", F.col("_metadata.file_name").alias("name")).where("name <> 'scales.yaml'")
    rows: dict[str, tuple] = {}
    for r in files.orderBy("name").collect():  # a catalogue: one file a parameter
        rule = _flat_yaml(r.value)
        if not rule.get("code"):
            raise ValueError(f"{r.name}: no code")
        scale = rule.get("scale")
        if scale and scale not in known:
            raise ValueError(f"{r.name}: unknown scale {scale}")
        if rule.get("type") == "ordinal_decrease" and not scale:
            raise ValueError(f"{r.name}: an ordinal rule needs a scale")
        number = lambda k: float(rule.get(k, 0) or 0)  # noqa: B023, E731
        rows[rule["code"]] = (rule["code"], rule.get("type"), number("pct"), number("threshold"), number("tolerance_pct"), scale, known.get(scale))
    return spark.createDataFrame(list(rows.values()), RULE_SCHEMA)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts of JSON lines: blank lines are skipped, a bad line fails the load. ``seq`` keeps the order in a file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("seq")).where("trim(value) <> ''")
    return lines.withColumn("f", F.from_json("value", FACT_SCHEMA, {"mode": "FAILFAST"})).select("f.*", "source", "seq")


def write_facts(facts: DataFrame, folder: str, job: str) -> str:
    """Facts of a job under a fixed key, so that a repeated job overwrites its own."""
    path = str(PurePosixPath(folder) / "facts" / f"job={job}")
    facts.write.mode("overwrite").json(path)
    return path


# The matrix sheet, its header cells and their columns.
MATRIX_SHEET = "МАТРИЦА"
MATRIX_HEADERS = {"код": "code", "code": "code", "наименование": "name", "параметр": "name", "name": "name", "ед. изм.": "unit", "единица": "unit", "unit": "unit", "приоритет": "priority", "раздел": "section"}


def matrix_params(cells: DataFrame) -> DataFrame:
    """Parameters from the cells (row, column, value) of the matrix sheet, columns found by header text.

    Rows whose code isn't M-nnn are left out. A repeated code or a missing code
    or name column raises.
    """
    names = F.create_map(*(F.lit(v) for pair in MATRIX_HEADERS.items() for v in pair))
    heads = cells.withColumn("name", F.try_element_at(names, F.lower(F.trim("value")))).where("name is not null")
    first = heads.where("name = 'code'").agg(F.min("row")).first()[0]
    found = {r.name: r.column for r in heads.where(F.col("row") == first).collect()} if first is not None else {}
    if not {"code", "name"} <= found.keys():
        raise ValueError("the matrix sheet needs columns for code and name")
    wide = cells.where(F.col("row") > first).groupBy("row").agg(*(F.max(F.when(F.col("column") == c, F.trim("value"))).alias(n) for n, c in found.items()))
    params = wide.where(F.col("code").rlike(r"^M-\d{3}$"))
    if twice := params.groupBy("code").count().where("count > 1").limit(1).collect():
        raise ValueError(f"code {twice[0].code} is repeated")
    return params


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Parameters of a workbook's matrix sheet, which is found by its name."""
    from tallyline.sources.registries import read_cells

    return matrix_params(read_cells(spark, path, MATRIX_SHEET))


def enrich(params: DataFrame, rules: DataFrame) -> DataFrame:
    """``params`` (code, ...) with the rule_type and scale of their rule and the data_type that follows: string without a rule.

    The catalogue is broadcast: one row a parameter.
    """
    known = rules.select(F.col("param_code").alias("code"), "rule_type", "scale", F.lit(True).alias("_known"))
    kind = F.when(F.col("_known").isNull() | (F.col("rule_type") == "text_mismatch"), "string").when(F.col("rule_type") == "ordinal_decrease", "ordinal").otherwise("number")
    return params.drop("rule_type", "scale", "data_type").join(F.broadcast(known), "code", "left").withColumn("data_type", kind).drop("_known")


def active_version(params: DataFrame) -> DataFrame:
    """One row: the matrix_version of active parameters that is last as text, empty without any."""
    return params.where("is_active").agg(F.coalesce(F.max("matrix_version"), F.lit("")).alias("matrix_version"))


def matrix_json(params: DataFrame, version: str) -> DataFrame:
    """One row: the catalogue as JSON (a few hundred parameters)."""
    cols = [c for c in params.columns if c != "row"]
    return params.agg(F.to_json(F.struct(F.lit(version).alias("matrix_version"), F.array_sort(F.collect_list(F.struct(*cols))).alias("params"))).alias("json"))
