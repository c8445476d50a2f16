"""Facts from lines by labelled patterns, and the check of facts that a model proposes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import scalars as S

# The parts and labels of the patterns. NUMBER: code, unit, label; ORDINAL and TEXT: code, expression.
NUM = r"(?<num>\d{1,3}(?:[  ]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)"
GAP = r"[^\d\n]{0,40}?"
UNITS = {
    "LEN": r"(?<unit>мм|см|м)(?![\w²³])",
    "AREA": r"(?<unit>м\s?[²2]|кв\.?\s?м)",
    "VOL": r"(?<unit>м\s?[³3]|куб\.?\s?м)",
    "NONE": r"(?<unit>)",
    "KW": r"(?<unit>к?вт)",
    "PCT": r"(?<unit>%)",
    "RUB": r"(?<unit>тыс\.?\s?руб\.?|млн\.?\s?руб\.?)",
}
NUMBER = [
    ("M-001", "AREA", r"площад[ьи]\s+застройки"),
    ("M-002", "AREA", r"общая\s+площадь\s+(?:жилого\s+)?здания|площадь\s+здания\s+общая"),
    ("M-003", "AREA", r"полезн\w+\s+площадь|расч[её]тн\w+\s+площадь"),
    ("M-005", "VOL", r"строительн\w+\s+объ[её]м[^\d\n]{0,25}?подземн\w+|подземн\w+\s+част\w+[^\d\n]{0,25}?объ[её]м"),
    ("M-006", "VOL", r"строительн\w+\s+объ[её]м[^\d\n]{0,25}?надземн\w+|надземн\w+\s+част\w+[^\d\n]{0,25}?объ[её]м"),
    ("M-004", "VOL", r"(?:общий\s+)?строительн\w+\s+объ[её]м(?![^\d\n]{0,25}?(?:под|над)земн)"),
    ("M-007", "NONE", r"этажность(?:\s*\(?надземная\)?)?|количество\s+(?:надземных\s+)?этажей|число\s+этажей"),
    ("M-008", "LEN", r"высота\s+здания"),
    ("M-010", "NONE", r"(?:общее\s+)?количество\s+квартир|число\s+квартир"),
    ("M-012", "NONE", r"количество\s+машино-?мест[^\d\n]{0,30}?подземн\w*|подземн\w+[^\d\n]{0,30}?машино-?мест"),
    ("M-014", "KW", r"расч[её]тн\w+\s+(?:электрическ\w+\s+)?мощность"),
    ("M-016", "NONE", r"суточн\w+\s+расход\w*[^\d\n]{0,25}?вод\w*|водопотреблени\w+[^\d\n]{0,15}?суточн\w*"),
    ("M-017", "NONE", r"суммарн\w+\s+тепловая\s+нагрузка"),
    ("M-018", "NONE", r"максимальн\w+\s+часов\w+\s+расход\s+газа"),
    ("M-019", "PCT", r"коэффициент\s+застройки"),
    ("M-020", "PCT", r"коэффициент\s+использования\s+территории"),
    ("M-027", "AREA", r"площадь\s+озеленени\w+|площадь\s+газонов"),
    ("M-028", "AREA", r"площадь\s+(?:детских\s+и\s+спортивных\s+)?площадок"),
    ("M-030", "LEN", r"ширина\s+(?:внутриплощадочных\s+)?(?:пожарных\s+)?проезд\w*|ширина\s+дорог\w*"),
    ("M-037", "NONE", r"количество\s+(?:наземных\s+)?парковочных\s+мест"),
    ("M-040", "LEN", r"ширина\s+(?:эвакуационн\w+\s+|магистральн\w+\s+)*коридор\w*"),
    ("M-041", "LEN", r"ширина\s+(?:эвакуационн\w+\s+)?(?:выход\w*|двер\w+)"),
    ("M-047", "LEN", r"глубина\s+тамбур\w*"),
    ("M-049", "LEN", r"высота\s+ограждени\w+"),
    ("M-118", "LEN", r"высота\s+порог\w*"),
    ("M-058", "LEN", r"толщина\s+(?:монолитной\s+)?фундаментной\s+плиты|толщина\s+ростверка"),
    ("M-059", "LEN", r"толщина\s+(?:монолитн\w+\s+)?плит\w*\s+перекрыти\w+"),
    ("M-061", "LEN", r"толщина\s+несущих\s+(?:монолитных\s+)?стен"),
    ("M-125", "LEN", r"толщина\s+(?:теплоизоляционного\s+слоя|утеплител\w+)"),
    ("M-128", "LEN", r"толщина\s+(?:теплоизоляционного\s+слоя|утеплител\w+)[^\n]{0,40}?(?:кровл|чердач|покрыти)"),
    ("M-126", "NONE", r"коэффициент\s+теплопроводности"),
    ("M-131", "NONE", r"удельн\w+\s+годов\w+\s+расход\w*\s+тепловой\s+энергии"),
    ("M-132", "RUB", r"итогов\w+\s+стоимост\w+|стоимость\s+строительства"),
    ("M-086", "NONE", r"максимальн\w+\s+численность"),
    ("M-103", "NONE", r"(?:противопожарн\w+\s+двер\w*|двер\w+\s+противопожарн\w+)[^\d\n]{0,40}?EI[\s-]*"),
]
ORDINAL = [
    ("M-055", r"(?:бетон\w*|класс\w*\s+бетона)[^\n\d]{0,50}?(?<![A-Za-zА-Яа-я])(?<val>[BbВв]\d{1,2}(?:[.,]5)?)(?![\d\w])"),
    ("M-056", r"стал[ьи][^\n\d]{0,25}?(?<![A-Za-zА-Яа-я])(?<val>[CcСс](?:235|245|255|345|390|440))(?!\d)"),
    ("M-057", r"арматур\w*[^\n\d]{0,30}?(?<![A-Za-zА-Яа-я])(?<val>[AaАа](?:240|400|500|600)[CcСс]?)(?![\d\w])"),
    ("M-021", r"класс\w*\s+энергетическ\w+\s+эффективности(?:\s+здания)?[^\w\n]{0,10}(?<val>(?-i:[A-GАВСЕ]\+{0,2}))(?![\w])"),
    ("M-022", r"степень\s+огнестойкости(?:\s+здания)?[^\w\n]{0,10}(?<val>(?-i:[IV]{1,3}|[1-5]))(?![\w])"),
    ("M-023", r"класс\w*\s+конструктивной\s+пожарной\s+опасности[^\w\n]{0,10}(?<val>[CcСс]\s?[0-3])(?!\d)"),
    ("M-015", r"категори\w+\s+надежности\s+электроснабжения[^\w\n]{0,10}(?<val>(?-i:[IV]{1,3}|[1-3]))(?![\w])"),
    ("M-107", r"(?:отделк\w*|материал\w*)[^\n]{0,60}?(?<val>[КK][МM]\s?[0-5])(?!\d)"),
]
TEXT = [("M-052", r"(?:фасад\w*|облицов\w+)[^\n]{0,60}?(?<val>RAL\s?\d{4})")]
EXCLUDE = {"M-125": r"кровл|чердач|покрыти"}
CONFIDENCE = {"number": 0.85, "ordinal": 0.85, "string": 0.8}
NO_UNIT = ("", "—", "ед.", "шт.")
FLAGS, WORD_START = "(?iU)", r"(?<![\w])"


def _sure(parsed) -> list[set[str]]:
    """Sets of lower-case texts; of each set every match has one at least."""
    sure: list[set[str]] = []
    run = ""
    for op, arg in [*parsed, (None, None)]:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg).lower()
            continue
        if run:
            sure.append({run})
            run = ""
        if name == "SUBPATTERN":
            sure += _sure(arg[-1])
        elif name == "BRANCH":
            parts = [_required(p) for p in arg[1]]
            sure.append(set().union(*parts) if all(parts) else set())
        elif name == "MAX_REPEAT" and arg[0] > 0:
            sure += _sure(arg[2])
    return [x for x in sure if x]


def _required(parsed) -> set[str]:
    """The set of which texts are longest; none if nothing is sure."""
    return max(_sure(parsed), key=lambda x: (min(map(len, x)), -len(x)), default=set())


def stems(expression: str) -> list[str]:
    """What the lower-case text must hold, one of them at least, for an expression to match; empty if that can't be told."""
    return sorted(_required(_parsed(expression)))


def _begins(parsed) -> set[str]:
    """Lower-case texts without white space of which every match begins with one; none if that can't be told."""
    items, run = list(parsed), ""
    for op, arg in items:
        if str(op) != "LITERAL" or chr(arg).isspace():
            break
        run += chr(arg).lower()
    if run or not items:
        return {run} - {""}
    name, arg = str(items[0][0]), items[0][1]
    if name == "SUBPATTERN":
        return _begins(arg[-1])
    parts = [_begins(p) for p in arg[1]] if name == "BRANCH" else [_begins(arg[2]), *([] if arg[0] else [_begins(items[1:])])] if name == "MAX_REPEAT" else []
    return set().union(*parts) if all(parts) else set()


def _parsed(expression: str):
    from re import _parser

    return _parser.parse(expression.replace("(?<num>", "(?P<num>").replace("(?<val>", "(?P<val>").replace("(?<unit>", "(?P<unit>"))


class Pattern:
    """One pattern: its expression, the numbers of its value and unit groups, the stems without which it can't match and the heads that its matches begin with."""

    def __init__(self, code: str, kind: str, expression: str, indexed: bool = True):
        self.code, self.kind, self.expression = code, kind, FLAGS + WORD_START + expression
        self.stems = stems(expression) if indexed else []
        self.heads = sorted(_begins(_parsed(expression))) if indexed else []
        # what else is sure, if it is Cyrillic: a Latin letter may stand for others that lower case keeps apart
        more = [sorted(x) for x in _sure(_parsed(expression)) if all(re.fullmatch("[а-яё]{3,}", t) for t in x)] if indexed else []
        self.needs = [x for x in (self.stems, *(x for x in more if x != self.stems)) if x and x != self.heads]

    def may_match(self, head: Column, lower: Column) -> Column:
        """Whether the line has a head, and it and the next what else a match needs, in lower case: a look at plain characters, which spares most expressions.

        A head has no white space, so it doesn't go over a line's end: of the next line's match nothing is looked for here.
        """
        tried = [reduce(lambda a, b: a | b, map(of.contains, texts)) for of, texts in ((head, self.heads), *((lower, x) for x in self.needs)) if texts]
        return reduce(lambda a, b: a & b, tried, F.lit(True))

    def match(self, text: Column) -> Column:
        """(at, value, unit) of the first match, ``at`` counting from 0; for texts that have one."""
        unit = F.regexp_extract(text, self.expression, 2) if self.kind == "number" else F.lit("")
        return F.struct((F.regexp_instr(text, F.lit(self.expression)) - 1).alias("at"), F.trim(F.regexp_extract(text, self.expression, 1)).alias("value"), F.trim(unit).alias("unit"))

    def find(self, text: Column, joined: Column, head: Column, lower: Column) -> Column:
        """The pattern with its match on ``text``, or else on ``joined`` if it begins on ``text``; null without one. ``head`` is ``text`` in lower case, ``lower`` all of both."""
        here, there = text.rlike(self.expression), joined.rlike(self.expression)
        if self.code in EXCLUDE:
            here, there = (x & ~text.rlike(FLAGS + EXCLUDE[self.code]) for x in (here, there))
        row = lambda of, spans: F.struct(F.lit(self.code).alias("param_code"), F.lit(self.kind).alias("kind"), F.lit(spans).alias("spans"), self.match(of).alias("m"))
        return F.when(self.may_match(head, lower), F.when(here, row(text, False)).when(there, row(joined, True)))


def patterns(only: set[str] | None = None, indexed: bool = True) -> list[Pattern]:
    """The patterns in order; ``only`` restricts them, an empty set means all. ``indexed=False`` tries every one on every line."""
    made = [Pattern(c, "number", rf"(?:{label}){GAP}{NUM}\s*(?:{UNITS[unit]})?", indexed) for c, unit, label in NUMBER]
    made += [Pattern(c, "ordinal", x, indexed) for c, x in ORDINAL] + [Pattern(c, "string", x, indexed) for c, x in TEXT]
    return [p for p in made if not only or p.code in only]


def candidates(lines: DataFrame, units: dict[str, str] | None = None, only: set[str] | None = None, indexed: bool = True) -> DataFrame:
    """Candidate facts of ``lines`` (id, page, line, text, bbox, next_text, next_bbox).

    Every pattern is a literal expression of its own, so one pass over the lines
    serves all of them; it is tried only where the line has a text with which
    its matches begin, and it and the next the stems that they need. A match on the line itself is preferred; else the line
    and the next, if the match begins on the line, at 0.05 less confidence. A
    number without a unit beside it loses 0.1 where its parameter has one.
    """
    from tallyline.plans.catalogue import param_units

    units = param_units() if units is None else units
    names = F.create_map(*(F.lit(v) for pair in units.items() for v in pair)) if units else F.create_map().cast("map<string,string>")
    rows = lines.withColumn("joined", F.when(F.col("next_text").isNotNull(), F.concat_ws(" ", "text", "next_text")))
    rows = rows.withColumns({"head": F.lower("text"), "lower": F.lower(F.coalesce("joined", "text"))})
    hits = F.filter(F.array(*(p.find(*map(F.col, ("text", "joined", "head", "lower"))) for p in patterns(only, indexed))), lambda x: x.isNotNull())
    each = rows.withColumn("h", F.explode(hits)).select(*rows.columns, "h.param_code", "h.kind", "h.spans", "h.m.*")
    each = each.where(~F.col("spans") | (F.col("at") < F.length("text"))).withColumn("want", F.coalesce(F.try_element_at(names, "param_code"), F.lit("")))
    number = S.to_matrix_unit(S.parse_number_any_space(F.col("value")), F.when(F.col("unit") == "", F.col("want")).otherwise(F.col("unit")), F.col("want"))
    norm = F.when(F.col("kind") == "number", S.fmt_num(number)).when(F.col("kind") == "ordinal", S.ordinal_canon(F.col("value"))).otherwise(S.squash_spaces(F.col("value")))
    sure = F.when(F.col("kind") == "string", CONFIDENCE["string"]).otherwise(CONFIDENCE["number"])
    less = F.when((F.col("kind") == "number") & (F.col("unit") == "") & ~F.col("want").isin(*NO_UNIT), 0.1).otherwise(0.0)
    return each.select(
        "id", "page", *(["method"] if "method" in lines.columns else []), "line", "param_code", "kind",
        F.trim(F.concat_ws(" ", "value", "unit")).alias("value_raw"),
        norm.alias("value_norm"),
        F.when(F.col("kind") == "number", F.coalesce(F.nullif("want", F.lit("")), F.nullif("unit", F.lit("")))).alias("unit"),
        F.when(F.col("spans"), F.col("joined")).otherwise(F.col("text")).alias("quote"),
        F.when(F.col("spans"), S.union_bbox(F.col("bbox"), F.col("next_bbox"))).otherwise(F.col("bbox")).alias("bbox"),
        F.round(sure - less - F.when(F.col("spans"), 0.05).otherwise(0.0), 2).alias("confidence"),
    )


def verify_proposed(proposed: DataFrame, lines: DataFrame, known: set[str] | None = None) -> DataFrame:
    """Facts that a model proposed (id, page, line, param_code, value), moved to a line that holds the value.

    The cited line counts first, else the first line of the chunk that holds the
    value (both frames may have a ``chunk``; without it a text is one); a value
    that no line holds, and a code that isn't ``known``, is dropped. Values and
    lines are compared without white space, in lower case, commas as points. The
    join is on id and chunk, so it costs a proposal times the lines of its chunk.
    A proposal's unit, the line's box and the chunk come along where there are any.
    """
    if known is not None:
        proposed = proposed.where(F.col("param_code").isin(*known)) if known else proposed.limit(0)
    keys = ["id", "chunk"] if "chunk" in proposed.columns and "chunk" in lines.columns else ["id"]
    has = F.contains(S.squash(F.col("text")), S.squash(F.col("value"))) & (S.squash(F.col("value")) != "")
    more = [c for c in ("unit",) if c in proposed.columns] + [c for c in ("bbox",) if c in lines.columns] + keys[1:]
    met = proposed.withColumn("_p", F.monotonically_increasing_id()).withColumnsRenamed({"page": "cited_page", "line": "cited_line"}).join(lines.select(*keys, "page", "line", "text", *(c for c in more if c == "bbox")), keys).where(has)
    order = F.struct(((F.col("page") != F.col("cited_page")) | (F.col("line") != F.col("cited_line"))).alias("off"), "page", "line")
    best = met.groupBy("_p").agg(F.min_by(F.struct("id", "param_code", "value", "page", "line", "text", *more), order).alias("x"))
    return best.select("x.*", F.lit(0.7).alias("confidence"))


def chunk_lines(lines: Column, size: int = 7000, page: Column | None = None) -> Column:
    """Chunk number of each line of a text: lines, each as ``[page:number] text``, are added while their characters stay within ``size``.

    Lines count from 0 on page ``page`` (1 by default). A line feed counts after
    each line but the last one added.
    """
    page = F.length((F.lit(1) if page is None else page).cast("string"))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["sum"] > 0) & (acc["sum"] + n - 1 > size)
        chunk = acc["chunk"] + F.when(full, 1).otherwise(0)
        return F.struct(F.when(full, n).otherwise(acc["sum"] + n).alias("sum"), chunk.alias("chunk"), F.concat(acc["out"], F.array(chunk)).alias("out"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.transform(lines, lambda t, i: F.length(t) + page + F.length(i.cast("string")) + 5), start, step, lambda acc: acc["out"])
