"""Rule evaluation: one CASE per wide row of expected and actual values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import scalars as S

CANDIDATE, VERIFIED, MISSING, NOT_COMPARABLE = "CANDIDATE", "NEGATIVE_VERIFIED", "MISSING_EVIDENCE", "NOT_COMPARABLE"
NUMERIC = ("numeric_equal", "numeric_delta_pct", "numeric_decrease", "numeric_increase")
THRESHOLD = ("threshold_min", "threshold_max")
PAIRED = (*NUMERIC, "ordinal_decrease", "text_mismatch")


def breach(rule_type: Column, e: Column, a: Column, pct: Column, tolerance: Column) -> Column:
    """Whether numbers break a numeric rule."""
    off = S.pct_of(e, a)
    return (
        F.when(rule_type == "numeric_equal", (a != e) & ~((tolerance > 0) & (off <= tolerance)))
        .when(rule_type == "numeric_delta_pct", off > pct)
        .when(rule_type == "numeric_decrease", a < e)
        .otherwise((a > e) & ((pct == 0) | (off > pct)))
    )


def numeric_status(rule_type: str, e: Column, a: Column, pct: float = 0.0, tolerance: float = 0.0) -> Column:
    """Status of typed numbers under one numeric rule: no text is parsed."""
    bad = breach(F.lit(rule_type), e, a, F.lit(float(pct)), F.lit(float(tolerance)))
    return F.when(a.isNull() | e.isNull(), MISSING).when(bad, CANDIDATE).otherwise(VERIFIED)


def threshold_status(rule_type: str, a: Column, threshold: float) -> Column:
    return F.when(a.isNull(), MISSING).when(a < threshold if rule_type == "threshold_min" else a > threshold, CANDIDATE).otherwise(VERIFIED)


def status_of(rule_type: Column, expected: Column, actual: Column, pct: Column, threshold: Column, tolerance: Column, aliases: Column | None = None) -> Column:
    """The engine's status for one comparison.

    No rule or an unknown type is not comparable before blanks are looked at;
    then a blank side that the type needs is missing evidence; then a value that
    doesn't parse, or has no rank, is not comparable.
    """
    e, a = S.parse_number(expected), S.parse_number(actual)
    pct, threshold, tolerance = (F.coalesce(x, F.lit(0.0)) for x in (pct, threshold, tolerance))
    numeric = breach(rule_type, e, a, pct, tolerance)
    limit = F.when(rule_type == "threshold_min", a < threshold).otherwise(a > threshold)
    either = lambda bad: F.when(bad, CANDIDATE).otherwise(VERIFIED)
    out = (
        F.when(rule_type.isNull() | ~rule_type.isin(*PAIRED, *THRESHOLD), NOT_COMPARABLE)
        .when(S.blank(actual) | (rule_type.isin(*PAIRED) & S.blank(expected)), MISSING)
        .when(rule_type.isin(*THRESHOLD), F.when(a.isNull(), NOT_COMPARABLE).otherwise(either(limit)))
        .when(rule_type.isin(*NUMERIC), F.when(a.isNull() | e.isNull(), NOT_COMPARABLE).otherwise(either(numeric)))
        .when(rule_type == "text_mismatch", either(S.normalize_text(expected) != S.normalize_text(actual)))
    )
    if aliases is None:
        return out.otherwise(NOT_COMPARABLE)
    er, ar = S.rank_of(expected, aliases), S.rank_of(actual, aliases)
    return out.otherwise(F.when(aliases.isNull() | (er < 0) | (ar < 0), NOT_COMPARABLE).otherwise(either(ar < er)))


def rationale_of(status: Column, rule_type: Column, expected: Column, actual: Column, e: Column, a: Column, pct: Column, threshold: Column, scale: Column) -> Column:
    """Why a comparison has its status; null for a verified one. ``e`` and ``a`` are the numbers of both sides.

    Fixed values: the wordings that a report shows.
    """
    pct, threshold = (F.coalesce(x, F.lit(0.0)) for x in (pct, threshold))
    say = lambda text, *x: F.format_string(text, *x)
    unread = say("не удалось разобрать числовое значение %s", S.quoted(F.when(rule_type.isin(*THRESHOLD) | e.isNotNull(), actual).otherwise(expected)))
    missing = F.when(rule_type.isin(*THRESHOLD), "нет значения в РД/ИД для проверки порога").otherwise("нет значения для сравнения (ПД или РД/ИД)")
    unknown = F.when(rule_type.isNull(), "правило для параметра не реализовано (RULE_NOT_IMPLEMENTED)").when(~rule_type.isin(*PAIRED, *THRESHOLD), say("неизвестный тип правила %s (RULE_NOT_IMPLEMENTED)", S.quoted(rule_type)))
    incomparable = F.coalesce(unknown, F.when(rule_type == "ordinal_decrease", say("значение не найдено в шкале %s: %s / %s", S.quoted(scale), S.quoted(expected), S.quoted(actual))).otherwise(unread))
    found = (
        F.when(rule_type == "numeric_equal", say("значение в РД/ИД (%s) не совпадает с ПД (%s)", actual, expected))
        .when(rule_type == "numeric_delta_pct", say("расхождение %s%% превышает допустимые %s%%", S.fmt_significant(S.pct_of(e, a), 3), S.fmt_significant(pct, 3)))
        .when(rule_type == "numeric_decrease", say("значение в РД/ИД (%s) меньше, чем в ПД (%s)", actual, expected))
        .when(rule_type == "numeric_increase", say("значение в РД/ИД (%s) больше, чем в ПД (%s)", actual, expected))
        .when(rule_type == "threshold_min", say("значение %s меньше минимально допустимого %s", S.fmt_significant(a, 4), S.fmt_significant(threshold, 4)))
        .when(rule_type == "threshold_max", say("значение %s больше максимально допустимого %s", S.fmt_significant(a, 4), S.fmt_significant(threshold, 4)))
        .when(rule_type == "ordinal_decrease", say("понижение по шкале %s: в РД/ИД %s ниже, чем в ПД %s", S.quoted(scale), S.quoted(actual), S.quoted(expected)))
        .when(rule_type == "text_mismatch", say("формулировка в РД/ИД (%s) отличается от ПД (%s)", S.quoted(actual), S.quoted(expected)))
    )
    return F.when(status == MISSING, missing).when(status == NOT_COMPARABLE, incomparable).when(status == CANDIDATE, found)


def evaluate(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """``pairs`` (param_code, expected, actual, ...) with finding_status, expected_value, actual_value, delta and rationale.

    The catalogue is broadcast: one row a parameter. Missing and not comparable
    results carry no values, threshold ones no expected value, and only numeric
    candidates a delta.
    """
    met = pairs.join(F.broadcast(rules), "param_code", "left")
    met = met.withColumn("finding_status", status_of(F.col("rule_type"), F.col("expected"), F.col("actual"), F.col("pct"), F.col("threshold"), F.col("tolerance_pct"), F.col("aliases")))
    met = met.withColumns({"_e": S.parse_number(F.col("expected")), "_a": S.parse_number(F.col("actual"))})
    shown = F.col("finding_status").isin(CANDIDATE, VERIFIED)
    delta = S.fmt_num(S.round6(F.col("_a") - F.col("_e")))
    return met.select(
        *pairs.columns,
        "rule_type",
        "finding_status",
        F.when(shown & ~F.col("rule_type").isin(*THRESHOLD), F.col("expected")).alias("expected_value"),
        F.when(shown, F.col("actual")).alias("actual_value"),
        F.when((F.col("finding_status") == CANDIDATE) & F.col("rule_type").isin(*NUMERIC), delta).alias("delta"),
        rationale_of(F.col("finding_status"), F.col("rule_type"), F.col("expected"), F.col("actual"), F.col("_e"), F.col("_a"), F.col("pct"), F.col("threshold"), F.col("scale")).alias("rationale"),
    )


def extended_status(rule_type: Column, expected: Column, actual: Column, allowed: Column) -> Column:
    """Documented types without an implementation to match: presence, set_difference and tolerance. An extension of ours."""
    a, e = S.parse_number(actual), S.parse_number(expected)
    return (
        F.when(rule_type.isin("presence", "set_difference"), F.when(S.blank(expected), NOT_COMPARABLE).when(S.blank(actual), CANDIDATE).otherwise(VERIFIED))
        .when(rule_type == "tolerance", F.when(a.isNull() | e.isNull() | allowed.isNull(), NOT_COMPARABLE).when(F.abs(a - e) > allowed, CANDIDATE).otherwise(VERIFIED))
        .otherwise(NOT_COMPARABLE)
    )
