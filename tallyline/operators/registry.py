"""Document registry: headers, row normalisation, matching to files, template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions import scalars as S

# Registry columns in template order, header aliases, synonyms and allowed values.
COLUMNS = "object_id file_name sha256 doc_stage discipline document_code revision approval_status approval_date sheet_page_range predecessor_ref successor_ref signature_status".split()
HEADER_ALIASES = {
    "object_id": "id объекта|объект",
    "file_name": "имя файла|файл|file|filename",
    "sha256": "хеш|хэш|контрольная сумма|file_hash|hash",
    "doc_stage": "стадия|doc stage",
    "discipline": "раздел|дисциплина|раздел (дисциплина)",
    "document_code": "шифр|шифр документа",
    "revision": "редакция|ревизия",
    "approval_status": "статус утверждения|статус",
    "approval_date": "дата утверждения",
    "sheet_page_range": "листы|лист|страницы|листы / страницы|лист/страница|sheet/page",
    "predecessor_ref": "предыдущая редакция|предшественник",
    "successor_ref": "следующая редакция|преемник",
    "signature_status": "подпись|статус подписи",
}
STAGE_SYNONYMS = {"ПД": "PD", "РД": "RD", "ИД": "ID"}
STATUS_SYNONYMS = {
    "APPROVED": "УТВЕРЖДЕНО|УТВЕРЖДЕНА|УТВ",
    "FOR_CONSTRUCTION": "В ПРОИЗВОДСТВО РАБОТ|В ПРОИЗВОДСТВО|ДЛЯ СТРОИТЕЛЬСТВА",
    "DRAFT": "ЧЕРНОВИК",
    "SUPERSEDED": "ЗАМЕНЕНО|ЗАМЕНЕНА|УСТАРЕЛО|УСТАРЕЛА",
    "CANCELLED": "АННУЛИРОВАНО|АННУЛИРОВАНА|ОТМЕНЕНО|ОТМЕНЕНА",
}
STAGES = ("PD", "RD", "ID")
STATUSES = ("DRAFT", "APPROVED", "FOR_CONSTRUCTION", "SUPERSEDED", "CANCELLED")


def canonical_header(name: str) -> str:
    low = name.lstrip("﻿").strip().lower()
    return next((c for c, aliases in HEADER_ALIASES.items() if low in aliases.split("|")), low)


def canonical_columns(df: DataFrame) -> DataFrame:
    """All registry columns as text, found by header or alias; absent ones are empty."""
    found: dict[str, str] = {}
    for c in df.columns:
        found.setdefault(canonical_header(c), c)
    return df.select(*(F.coalesce(F.col(f"`{found[c]}`").cast("string"), F.lit("")).alias(c) if c in found else F.lit("").alias(c) for c in COLUMNS))


def _mapped(x: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for pair in names.items() for v in pair)), x), x)


def normal_stage(x: Column) -> Column:
    return _mapped(F.upper(F.trim(x)), STAGE_SYNONYMS)


def normal_status(x: Column) -> Column:
    names = {alias: code for code, aliases in STATUS_SYNONYMS.items() for alias in aliases.split("|")}
    return F.translate(_mapped(F.upper(S.squash_spaces(x)), names), " ", "_")


def normalize_rows(rows: DataFrame) -> DataFrame:
    """Registry rows in canonical values with ``issues``, an array of (field, problem, fatal)."""
    trimmed = rows.withColumns({c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in COLUMNS})
    sha, given = S.valid_sha256(F.col("sha256")), F.col("sha256")
    stage, status, date = normal_stage(F.col("doc_stage")), normal_status(F.col("approval_status")), S.parse_date(F.col("approval_date"))
    issue = lambda cond, field, problem, fatal: F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(problem).alias("problem"), F.lit(fatal).alias("fatal")))
    issues = [
        issue((given != "") & (sha == ""), "sha256", "not a sha256", False),
        issue((sha == "") & (F.col("file_name") == ""), "file_name", "neither name nor sha256", True),
        issue(stage == "", "doc_stage", "empty", True),
        issue((stage != "") & ~stage.isin(*STAGES), "doc_stage", "not a stage", True),
        issue(status == "", "approval_status", "empty", False),
        issue((status != "") & ~status.isin(*STATUSES), "approval_status", "not a status", True),
        issue(F.col("approval_date") == "", "approval_date", "empty", False),
        issue((F.col("approval_date") != "") & date.isNull(), "approval_date", "not a date", True),
        *(issue(F.col(c) == "", c, "empty", False) for c in ("discipline", "document_code", "revision")),
    ]
    found = trimmed.withColumn("issues", F.filter(F.array(*issues), lambda i: i.isNotNull()))
    iso = F.when(F.col("approval_date") == "", F.lit("")).otherwise(F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.col("approval_date")))
    return found.withColumns({"sha256": sha, "doc_stage": stage, "approval_status": status, "approval_date": iso})


def usable(rows: DataFrame) -> DataFrame:
    return rows.where(~F.exists("issues", lambda i: i["fatal"]))


def _process(df: DataFrame) -> Column:
    """A row's process as text; frames without the column are of one process."""
    return F.coalesce(F.col("process_id").cast("string"), F.lit("")) if "process_id" in df.columns else F.lit("")


def _last(files: DataFrame, column: str, into: str) -> DataFrame:
    """The last uploaded file of each process and value of a column."""
    return files.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(_process(files).alias("_process"), F.col(column).alias("_key")).agg(F.max_by("file_id", F.struct("uploaded_at", "file_id")).alias(into))


def resolve(rows: DataFrame, files: DataFrame, sha: Column, name: Column, into: str) -> DataFrame:
    """``rows`` with the id of their process's file of that digest, else of that exact name; of equals the last uploaded.

    Empty keys become keys of their own, so that they spread over all tasks
    and meet nothing.
    """
    met = rows.withColumns({"_process": _process(rows), "_row": F.monotonically_increasing_id()})
    for key, column, found in ((sha, "sha256", "_by_sha"), (name, "file_name", "_by_name")):
        own = F.coalesce(F.nullif(key, F.lit("")), F.concat(F.lit("\0"), F.col("_row").cast("string")))
        met = met.withColumn("_key", own).join(_last(files, column, found), ["_process", "_key"], "left").drop("_key")
    return met.withColumn(into, F.coalesce("_by_sha", "_by_name")).drop("_process", "_row", "_by_sha", "_by_name")


def match_rows(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Normalised ``rows`` with file_id, predecessor_id, successor_id and match_status (MATCHED, UNMATCHED or INVALID)."""
    met = resolve(rows, files, F.col("sha256"), F.col("file_name"), "file_id")
    for ref in ("predecessor", "successor"):
        met = resolve(met, files, S.valid_sha256(F.col(f"{ref}_ref")), F.col(f"{ref}_ref"), f"{ref}_id")
    bad = F.exists("issues", lambda i: i["fatal"])
    return met.withColumn("match_status", F.when(bad, "INVALID").when(F.col("file_id").isNull(), "UNMATCHED").otherwise("MATCHED"))


def template(files: DataFrame) -> DataFrame:
    """Registry template rows of accepted files: dates as dd.MM.yyyy, references as file names."""
    names = files.select(F.col("file_id").alias("ref"), F.col("file_name").alias("ref_name"))
    out = files.where("check_status = 'ACCEPTED'")
    for ref in ("predecessor", "successor"):
        out = out.join(names.select(F.col("ref").alias(f"{ref}_id"), F.col("ref_name").alias(f"{ref}_ref")), f"{ref}_id", "left")
    shown = {"approval_date": F.date_format(F.col("approval_date"), "dd.MM.yyyy")}
    return out.select(*(F.coalesce(shown.get(c, F.col(c)).cast("string"), F.lit("")).alias(c) for c in COLUMNS))


def mark_duplicates(files: DataFrame) -> DataFrame:
    """Second and later files of one digest in a process keep no digest and get a note."""
    own = F.coalesce("sha256", F.concat(F.lit("\0"), F.col("file_id").cast("string")))  # files without a digest don't meet in one task
    order = Window.partitionBy("process_id", own).orderBy("uploaded_at", "file_id")
    marked = files.withColumn("_n", F.when(F.col("sha256").isNotNull(), F.row_number().over(order)))
    return marked.withColumn("note", F.when(F.col("_n") > 1, "duplicate content")).withColumn("sha256", F.when(F.col("_n") == 1, F.col("sha256"))).drop("_n")
