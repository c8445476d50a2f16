"""SQL names for the scalar functions that a query text may want; SQL functions, not Python ones."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tallyline.functions.scalars import CYRILLIC, LATIN


def register_functions(spark: SparkSession) -> list[str]:
    """Create temporary SQL functions and return their names. Catalyst inlines them."""
    made = {
        "parse_number(x STRING) RETURNS DOUBLE": r"try_cast(nullif(translate(regexp_extract(translate(x, '   \t', ''), '[-+]?\\d+(?:[.,]\\d+)?', 0), ',', '.'), '') AS DOUBLE)",
        "normalize_token(x STRING) RETURNS STRING": f"translate(upper(trim(x)), '{CYRILLIC},', '{LATIN}.')",
        "normalize_text(x STRING) RETURNS STRING": r"trim(regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', ' '))",
        "pct_of(e DOUBLE, a DOUBLE) RETURNS DOUBLE": "CASE WHEN e = 0 THEN CASE WHEN a = 0 THEN 0.0D ELSE double('Infinity') END ELSE abs(a - e) / abs(e) * 100 END",
        "round6(x DOUBLE) RETURNS DOUBLE": "round(x, 6)",
        "squash_spaces(x STRING) RETURNS STRING": r"trim(regexp_replace(x, '(?U)\\s+', ' '))",
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in made]
