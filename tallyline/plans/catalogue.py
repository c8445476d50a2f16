"""The rule catalogue and its scales as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Ordered scales, worst first; aliases of one rank by "|".
SCALES = {
    "concrete": ["B7.5", "B10", "B12.5", "B15", "B20", "B25", "B30", "B35", "B40", "B45", "B50", "B55", "B60"],
    "rebar": ["A240", "A400", "A500", "A600"],
    "steel": ["C235", "C245", "C255", "C345", "C390", "C440"],
    "fire_resistance": ["V|5", "IV|4", "III|3", "II|2", "I|1"],
    "kpo": ["C3", "C2", "C1", "C0"],
    "energy_class": ["G", "F", "E", "D", "C", "B", "A", "A+", "A++"],
    "reliability": ["III|3", "II|2", "I|1"],
    "km": ["KM5", "KM4", "KM3", "KM2", "KM1", "KM0"],
}

# The rules by type; "=" gives a percentage, threshold or scale.
RULES = {
    "numeric_equal": "M-001 M-004 M-005 M-006 M-007 M-009 M-010 M-054",
    "numeric_delta_pct": "M-002=1 M-024=5 M-025=5 M-067=2 M-093=5",
    "numeric_decrease": "M-003 M-012 M-013 M-027 M-028 M-037 M-038 M-058 M-059 M-060 M-061 M-062 M-064 M-103 M-120 M-125 M-127 M-128 M-129",
    "numeric_increase": "M-008 M-014 M-016 M-017 M-018 M-019 M-020 M-082=10 M-126 M-131 M-132=5",
    "threshold_min": "M-030=4.2 M-040=1.2 M-041=0.9 M-047=1.5 M-049=1.2 M-084=3.5 M-104=1.2 M-105=0.9 M-116=1.5 M-117=1.5",
    "threshold_max": "M-118=0.014",
    "ordinal_decrease": "M-015=reliability M-021=energy_class M-022=fire_resistance M-023=kpo M-050=km M-055=concrete M-056=steel M-057=rebar M-107=km M-124=energy_class",
    "text_mismatch": "M-043 M-052 M-069 M-072 M-075 M-106 M-109",
}

# Units of the numeric parameters that have one beside their name.
UNITS = {
    "м²": "M-001 M-002 M-003 M-025 M-027 M-028",
    "м³": "M-004 M-005 M-006 M-024 M-093",
    "м": "M-008 M-009 M-030 M-040 M-041 M-047 M-049 M-084 M-104 M-105 M-116 M-117 M-118",
    "мм": "M-054 M-058 M-059 M-061 M-062 M-064 M-125 M-128",
    "мм²": "M-060 M-069",
    "шт.": "M-010 M-012 M-037 M-038 M-120 M-129",
    "ед.": "M-007 M-013",
    "%": "M-019 M-020",
    "кВт": "M-014",
    "м³/сут": "M-016",
    "Гкал/ч": "M-017",
    "м³/ч": "M-018",
    "м³ / т": "M-067",
    "дни": "M-082",
    "мин": "M-103",
    "Вт/(м·С)": "M-126",
    "м²·С/Вт": "M-127",
    "кВт·ч/м²": "M-131",
    "тыс. руб.": "M-132",
}

RULE_SCHEMA = "param_code string, rule_type string, pct double, threshold double, tolerance_pct double, scale string, aliases array<struct<rank:int,alias:string>>"


def scale_aliases(order: list[str]) -> list[tuple[int, str]]:
    from tallyline.sources.catalogues import token

    return [(rank, token(alias)) for rank, aliases in enumerate(order) for alias in aliases.split("|")]


def rule_rows() -> list[tuple]:
    out = []
    for kind, listed in RULES.items():
        for item in listed.split():
            code, _, arg = item.partition("=")
            number = float(arg) if arg and kind != "ordinal_decrease" else 0.0
            scale = arg if kind == "ordinal_decrease" else None
            out.append((code, kind, number if kind.startswith("numeric") else 0.0, number if kind.startswith("threshold") else 0.0, 0.0, scale, scale_aliases(SCALES[scale]) if scale else None))
    return sorted(out)


def rules(spark: SparkSession) -> DataFrame:
    """The built-in catalogue: 71 rows, always small enough to broadcast."""
    return spark.createDataFrame(rule_rows(), RULE_SCHEMA)


def scales(spark: SparkSession) -> DataFrame:
    """(scale, rank, alias), ranks rising from the worst."""
    return spark.createDataFrame([(s, r, a) for s, order in SCALES.items() for r, a in scale_aliases(order)], "scale string, rank int, alias string")


def param_units() -> dict[str, str]:
    return {code: unit for unit, codes in UNITS.items() for code in codes.split()}
