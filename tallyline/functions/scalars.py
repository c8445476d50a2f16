"""Scalar functions as column expressions: numbers, tokens, texts, units, dates, boxes, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cyrillic letters that look like Latin ones, and the Latin ones.
CYRILLIC, LATIN = "АВСЕКМНОРТХ", "ABCEKMHOPTX"
# Unit spellings and lengths in metres.
UNIT_ALIASES = {"м2": "м²", "м^2": "м²", "кв.м": "м²", "квм": "м²", "м3": "м³", "м^3": "м³", "куб.м": "м³", "кубм": "м³"}
METRES = {"мм": 0.001, "см": 0.01, "м": 1.0}
# Date layouts in the order they are tried.
DATE_LAYOUTS = ["yyyy-MM-dd", "dd.MM.yyyy", "d.M.yyyy", "dd/MM/yyyy", "d/M/yyyy", "dd.MM.yy", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss"]
FACT_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"

_NUMBER = r"[-+]?\d+(?:[.,]\d+)?"


def blank(x: Column) -> Column:
    """Null or white space alone."""
    return F.coalesce(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), F.lit("")) == ""


def null_if_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _first_number(compact: Column) -> Column:
    return F.nullif(F.translate(F.regexp_extract(compact, _NUMBER, 0), ",", "."), F.lit("")).try_cast("double")


def parse_number(x: Column) -> Column:
    """First number after deleting spaces, no-break spaces and tabs; null if there is none."""
    return _first_number(F.translate(x, "   \t", ""))


def parse_number_any_space(x: Column) -> Column:
    """As :func:`parse_number`, deleting all Unicode white space."""
    return _first_number(F.regexp_replace(x, r"(?U)\s", ""))


def _let(x: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(x), use), 0)


def _without_exponent(text: Column) -> Column:
    sign, mantissa, power = (F.regexp_extract(text, r"^(-?)([0-9.]+)E(-?[0-9]+)$", i) for i in (1, 2, 3))
    digits, whole = F.translate(mantissa, ".", ""), power.try_cast("int") + 1  # one digit stands before the point of a mantissa
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -whole), digits)
    large = F.concat(digits, F.repeat(F.lit("0"), whole - F.length(digits)))
    between = F.concat(digits.substr(F.lit(1), whole), F.lit("."), digits.substr(whole + 1, F.length(digits)))
    return F.concat(sign, F.when(whole <= 0, small).when(whole >= F.length(digits), large).otherwise(between))


def fmt_num(x: Column) -> Column:
    """Shortest plain decimal of a double: ``-10``, ``1250.5``, never an exponent."""
    text = x.cast("string")
    plain = F.when(text.contains("E"), _let(text, _without_exponent)).otherwise(text)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""), "^-0$", "0")


def round6(x: Column) -> Column:
    """Half away from zero at six places."""
    return F.round(x, 6)


def fmt_significant(x: Column, places: int) -> Column:
    """A double to ``places`` significant digits: plain, or with an exponent where it is below -4 or at least ``places``."""

    def shown(text: Column) -> Column:
        power = F.regexp_extract(text, r"e([+-][0-9]+)$", 1).try_cast("int")
        short = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+e", "$1e"), r"\.e", "e")
        return F.when((power < -4) | (power >= places), short).otherwise(fmt_num(text.cast("double")))

    special = F.when(F.isnan(x), "NaN").when(x == float("inf"), "+Inf").when(x == float("-inf"), "-Inf")
    return F.coalesce(special, _let(F.format_string(f"%.{places - 1}e", x), shown))


def quoted(x: Column) -> Column:
    """In double quotes, with backslashes, quotes, line feeds and tabs escaped."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), x, F.lit('"'))


def pct_of(expected: Column, actual: Column) -> Column:
    """Difference in per cent of ``expected``; of zero it is 0 or infinite."""
    share = F.abs(actual - expected) / F.nullif(F.abs(expected), F.lit(0.0)) * 100
    return F.when(expected == 0, F.when(actual == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(share)


def normalize_token(x: Column) -> Column:
    """Trimmed upper case, look-alike letters to Latin, comma to point."""
    return F.translate(F.upper(F.trim(x)), CYRILLIC + ",", LATIN + ".")


def ordinal_canon(x: Column) -> Column:
    return F.translate(F.upper(F.regexp_replace(x, r"(?U)\s+", "")), CYRILLIC + ",", LATIN + ".")


def tokens(x: Column) -> Column:
    return F.split(normalize_token(x), r"[\s;/()]+")


def rank_of(x: Column, aliases: Column) -> Column:
    """Rank of a value on a scale of (rank, alias): the first token that is an alias, else the longest alias (two letters at least) that begins a token, of equally long ones the first token's; -1 if none."""
    found = F.filter(F.transform(tokens(x), lambda t: F.get(F.filter(aliases, lambda a: a["alias"] == t), 0)["rank"]), lambda r: r.isNotNull())
    begun = lambda t, i: F.transform(F.filter(aliases, lambda a: (F.length(a["alias"]) >= 2) & F.startswith(t, a["alias"])), lambda a: F.struct(F.length(a["alias"]).alias("n"), (-i).alias("first"), a["rank"].alias("rank")))
    longest = F.array_max(F.flatten(F.transform(tokens(x), begun)))["rank"]
    return F.coalesce(F.get(found, 0), longest, F.lit(-1))


def normalize_text(x: Column) -> Column:
    """Lower case, every run of other than letters and digits one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def squash_spaces(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def squash(x: Column) -> Column:
    """For checking a quote: no white space, lower case, comma to point."""
    return F.translate(F.lower(F.regexp_replace(x, r"(?U)\s+", "")), ",", ".")


def canon_unit(x: Column) -> Column:
    unit = F.trim(F.regexp_replace(F.translate(F.lower(F.trim(x)), " ", " "), r"\.+$", ""))
    compact = F.translate(unit, " ", "")
    names = F.create_map(*(F.lit(v) for pair in UNIT_ALIASES.items() for v in pair))
    return F.coalesce(F.try_element_at(names, unit), F.try_element_at(names, compact), compact)


def to_matrix_unit(value: Column, found: Column, target: Column) -> Column:
    """A value in the target unit: lengths are converted, all else stays."""
    metres = F.create_map(*(F.lit(v) for pair in METRES.items() for v in pair))
    a, b = (F.try_element_at(metres, canon_unit(F.coalesce(u, F.lit("")))) for u in (found, target))
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), F.round(value * a / b, 9)).otherwise(value)


def parse_date(x: Column) -> Column:
    """The first of the date layouts that fits the whole text."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(x), F.lit(layout)) for layout in DATE_LAYOUTS)).cast("date")


def valid_sha256(x: Column) -> Column:
    """Lower-case digest, or empty if it isn't one."""
    low = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return F.when(low.rlike("^[0-9a-f]{64}$"), low).otherwise(F.lit(""))


def priority(x: Column) -> Column:
    return F.upper(F.regexp_extract(F.coalesce(x, F.lit("")), r"(?i)^\s*(HIGH|MEDIUM|LOW)", 1))


def norm_bbox(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Box in shares of the page: clamped to [0, 1], widened by 1e-4 where degenerate, five places."""
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    a, b, c, d = clamp(x0 / width), clamp(y0 / height), clamp(x1 / width), clamp(y1 / height)

    def widened(lo: Column, hi: Column) -> tuple[Column, Column]:
        end = F.when(hi <= lo, F.least(F.lit(1.0), lo + 1e-4)).otherwise(hi)
        return F.when(end <= lo, end - 1e-4).otherwise(lo), end

    (a, c), (b, d) = widened(a, c), widened(b, d)
    return F.array(*(F.round(v, 5) for v in (a, b, c, d)))


def union_bbox(p: Column, q: Column) -> Column:
    """Smallest box around both; a null box gives the other."""
    both = F.array(F.least(p[0], q[0]), F.least(p[1], q[1]), F.greatest(p[2], q[2]), F.greatest(p[3], q[3]))
    return F.when(p.isNull(), q).when(q.isNull(), p).otherwise(both)


def uuid5(name: Column, namespace: str = FACT_NAMESPACE) -> Column:
    """Name-based UUID, version 5."""

    def shown(h: Column) -> Column:
        variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
        return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))

    return _let(F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8"))), shown)


def strip_fences(x: Column) -> Column:
    """The body of a fenced JSON answer, or the text itself."""
    body = F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(x.contains("```") & (body != ""), body).otherwise(F.trim(x))


def relay_backoff(attempts: Column) -> Column:
    """Seconds before an outbox row is published again."""
    return F.least(F.pow(F.lit(2.0), F.least(attempts, F.lit(10))), F.lit(60.0))


def worker_backoff(attempts: Column) -> Column:
    """Seconds before a worker handles an event again."""
    return F.least(F.pow(F.lit(2.0), attempts - 1), F.lit(30.0))


def consumer_backoff(attempts: Column) -> Column:
    return attempts.cast("double")
