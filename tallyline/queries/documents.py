"""Content, layout and extraction on documents, pages and benchmark texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.operators import extraction, layout, proposals
from tallyline.queries.comparison import read


def content_sniff(spark, sf_dir):
    """Formats of pages, of documents and of heads that look like PDF, zip and XML."""
    docs = read(spark, sf_dir, "documents")
    heads = F.array(F.lit("%PDF-1.7 "), F.lit("PK\x03\x04"), F.lit('\n <?xml version="1.0"?>'), F.lit(""))
    made = docs.select(F.concat(F.get(heads, (F.col("doc_id") % 4).cast("int")), "text").alias("c"))
    each = made.union(read(spark, sf_dir, "pages").select("html"))
    return each.groupBy(F.coalesce(layout.sniff(F.col("c")), F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_SNIFF = """select kind, count(*) as n from (select case doc_id % 4 when 0 then 'pdf' when 1 then 'zip' when 2 then 'xml' else 'none' end as kind from documents union all select 'none' from pages) group by 1"""


def dup_content_sha256(spark, sf_dir):
    """Documents whose digest an earlier one of the same language has. A digest's first is found by aggregation, so a hot digest is no hot task."""
    t = read(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha256"))
    first = t.groupBy("lang", "sha256").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("lang", "sha256", "first_id")
    return t.join(first, ["lang", "sha256"]).where("doc_id <> first_id").select("doc_id", "first_id", "sha256")


_DUP = "select doc_id, first_id, sha256 from (select doc_id, sha256(text) as sha256, min(doc_id) over (partition by lang, text) as first_id from documents) where doc_id <> first_id"


def layout_lines(spark, sf_dir):
    """Non-blank lines of each document and their characters."""
    lines = layout.text_layout(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return lines.groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("chars"), F.max("line").cast("long").alias("last_line"))


_LINES = """select doc_id, count(*) as n_lines, sum(length(line))::bigint as chars, max(n - 1)::bigint as last_line
  from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n from documents) where trim(line) <> '' group by 1"""


def quality_grade(spark, sf_dir):
    """Grades of documents whose lines are taken as pages, text pages having 200 characters."""
    pages = F.transform(F.split("text", "\n"), lambda t: F.struct(F.length(t).alias("chars"), F.lit("text").alias("method")))
    t = read(spark, sf_dir, "documents").select("doc_id", layout.page_stats(pages, 200).alias("s"))
    return t.select("doc_id", F.col("s.pages").cast("long").alias("pages"), F.col("s.chars").alias("chars"), F.col("s.text_pages").cast("long").alias("text_pages"), F.col("s.quality").alias("quality"))


_GRADE = """select doc_id, pages, chars, text_pages, case when pages = 0 then 'FAILED' when text_pages = 0 then 'ABSTAIN' when text_pages < pages then 'LOW_QUALITY' else 'OK' end as quality
  from (select doc_id, count(*) as pages, sum(length(line))::bigint as chars, count(*) filter (length(line) >= 200) as text_pages from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) group by 1)"""


def _made_lines(spark, sf_dir):
    """Lines of parts as a design document would write them, every third broken before its value."""
    t = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    said = (
        F.when(k % 5 == 0, F.concat(F.lit("Площадь застройки — 1 "), F.lpad(size, 3, "0"), F.lit(",5 м²")))
        .when(k % 5 == 1, F.concat(F.lit("Высота здания: "), size, F.lit(" м")))
        .when(k % 5 == 2, F.concat(F.lit("Бетон класса В"), F.when(F.col("p_size") % 2 == 0, "25").otherwise("30"), F.lit(" монолитный")))
        .when(k % 5 == 3, F.concat(F.lit("Железобетон "), size))
        .otherwise(F.concat(F.lit("ШИРИНА ДВЕРЕЙ, не менее "), size, F.lit("00 мм")))
    )
    broken = (k % 3 == 0) & (k % 5 < 2)
    text = F.when(broken, F.regexp_extract(said, r"^(\D+)", 1)).otherwise(said)
    rest = F.when(broken, F.regexp_extract(said, r"^\D+(.*)$", 1))
    return t.select(k.alias("id"), F.lit(1).alias("page"), F.lit(0).alias("line"), text.alias("text"), F.lit(None).cast("array<double>").alias("bbox"), rest.alias("next_text"), F.lit(None).cast("array<double>").alias("next_bbox"))


def extract_label_value(spark, sf_dir):
    """Facts of labelled values in lines, by the whole pattern table."""
    return extraction.candidates(_made_lines(spark, sf_dir)).select("id", "param_code", "value_norm", "unit", "confidence")


_EXTRACT = """
select * from (select p_partkey as id, case p_partkey % 5 when 0 then 'M-001' when 1 then 'M-008' when 2 then 'M-055' when 4 then 'M-041' end as param_code,
  case p_partkey % 5 when 0 then '1' || lpad(p_size::varchar, 3, '0') || '.5' when 1 then p_size::varchar when 2 then case when p_size % 2 = 0 then 'B25' else 'B30' end
    when 4 then regexp_replace(regexp_replace((p_size / 10)::decimal(9,1)::varchar, '0$', ''), '\\.$', '') end as value_norm,
  case p_partkey % 5 when 0 then 'м²' when 1 then 'м' when 4 then 'м' end as unit,
  case when p_partkey % 3 = 0 and p_partkey % 5 < 2 then 0.8 else 0.85 end::double as confidence from part) where param_code is not null"""


#: A line for each pattern: code, text before the value, unit in the text, and for what isn't a number the value as written and as a fact has it.
SAMPLES = [
    ("M-001", "Площадь застройки", "м²"), ("M-002", "Общая площадь жилого здания", "м²"), ("M-003", "Полезная площадь", "кв. м"), ("M-005", "Строительный объём подземной части", "м³"), ("M-006", "Надземная часть, объем", "куб.м"),
    ("M-004", "Общий строительный объем", "м3"), ("M-007", "Этажность (надземная)", ""), ("M-008", "Высота здания", "м"), ("M-010", "Общее количество квартир", ""), ("M-012", "Количество машиномест в подземной стоянке", ""),
    ("M-014", "Расчетная электрическая мощность", "кВт"), ("M-016", "Суточный расход холодной воды", ""), ("M-017", "Суммарная тепловая нагрузка", ""), ("M-018", "Максимальный часовой расход газа", ""), ("M-019", "Коэффициент застройки", "%"),
    ("M-020", "Коэффициент использования территории", "%"), ("M-027", "Площадь озеленения", "м²"), ("M-028", "Площадь детских и спортивных площадок", "м²"), ("M-030", "Ширина пожарных проездов", "м"), ("M-037", "Количество парковочных мест", ""),
    ("M-040", "Ширина эвакуационных коридоров", "м"), ("M-041", "Ширина эвакуационного выхода", "м"), ("M-047", "Глубина тамбура", "м"), ("M-049", "Высота ограждений", "м"), ("M-118", "Высота порога", "м"), ("M-058", "Толщина фундаментной плиты", "мм"),
    ("M-059", "Толщина плит перекрытия", "мм"), ("M-061", "Толщина несущих стен", "мм"), ("M-125", "Толщина утеплителя", "мм"), ("M-128", "Толщина утеплителя кровли", "мм"), ("M-126", "Коэффициент теплопроводности", ""),
    ("M-131", "Удельный годовой расход тепловой энергии", ""), ("M-132", "Стоимость строительства", "тыс. руб."), ("M-086", "Максимальная численность", ""), ("M-103", "Двери противопожарные EI", ""),
    ("M-055", "Класс бетона", None, "В25", "B25"), ("M-056", "Сталь марки", None, "С345", "C345"), ("M-057", "Арматура", None, "А500С", "A500C"), ("M-021", "Класс энергетической эффективности здания", None, "A+", "A+"), ("M-022", "Степень огнестойкости", None, "II", "II"),
    ("M-023", "Класс конструктивной пожарной опасности", None, "С0", "C0"), ("M-015", "Категория надежности электроснабжения", None, "I", "I"), ("M-107", "Отделка потолков, материал", None, "КМ1", "KM1"), ("M-052", "Облицовка фасада, цвет", None, "RAL 7035", "RAL 7035"),
]


def extract_all_patterns(spark, sf_dir):
    """A line a part, of each of the 44 patterns in turn, among words of no meaning."""
    k = F.col("p_partkey")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (k % len(SAMPLES)).cast("int"))
    value = F.concat_ws(" ", F.col("p_size").cast("string"), F.nullif(pick([s[2] or "" for s in SAMPLES]), F.lit("")))
    other = pick([s[3] if len(s) > 3 else "" for s in SAMPLES])
    text = F.concat(F.lit("см. п. "), F.col("p_name"), F.lit("; "), pick([s[1] for s in SAMPLES]), F.lit(" — "), F.when(other == "", value).otherwise(other))
    none = F.lit(None)
    lines = read(spark, sf_dir, "part").select(k.alias("id"), F.lit(1).alias("page"), F.lit(0).alias("line"), text.alias("text"), none.cast("array<double>").alias("bbox"), none.cast("string").alias("next_text"), none.cast("array<double>").alias("next_bbox"))
    return extraction.candidates(lines).select("id", "param_code", "value_norm", "unit", "confidence")


def _all_sql() -> str:
    from tallyline.plans.catalogue import param_units

    units, rows = param_units(), []
    for n, (code, _, unit, *other) in enumerate(SAMPLES):
        shown = units.get(code)
        sure = (0.8 if code == "M-052" else 0.85) if other or unit or shown in (None, "ед.", "шт.") else 0.75
        rows.append(f"({n}, '{code}', {f"'{other[1]}'" if other else 'null'}, {f"'{shown}'" if shown and not other else 'null'}, {sure})")
    return f"select p_partkey as id, code as param_code, coalesce(said, p_size::varchar) as value_norm, unit, sure::double as confidence from part join (values {', '.join(rows)}) v(n, code, said, unit, sure) on n = p_partkey % {len(SAMPLES)}"


def llm_fact_verify(spark, sf_dir):
    """Values that a model proposed, verified on the text: the benchmark's first words, and a made-up one."""
    bench = read(spark, sf_dir, "benchmark")
    lines = layout.text_layout(bench, "item_id")
    proposed = bench.select(F.col("item_id").alias("id"), F.lit(9).alias("page"), F.lit(0).alias("line"), F.lit("M-001").alias("param_code"), F.when(F.col("item_id") % 3 == 0, "никогда").otherwise(F.upper(F.regexp_extract("text", r"\S+\s+\S+\s*$", 0))).alias("value"))
    return extraction.verify_proposed(proposed, lines).select(F.col("id").alias("item_id"), "page", F.trim("text").alias("quote"))


_VERIFY = """
with l as (select item_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as n, text from benchmark),
v as (select *, lower(regexp_replace(regexp_extract(text, '\\S+\\s+\\S+\\s*$'), '\\s+', '', 'g')) as value from l)
select item_id, 1 as page, trim(arg_min(line, n)) as quote from v
where item_id % 3 <> 0 and value <> '' and contains(lower(regexp_replace(line, '\\s+', '', 'g')), value) group by item_id"""


def _stub(messages: list[dict]) -> str:
    """Stands for a model: it proposes the first word of the first line, an invented value and an unknown code, in odd JSON; it is down for some texts."""
    text = messages[1]["content"].partition("Текст документа:\n")[2]
    if len(text) % 13 == 0:
        raise ConnectionError("down")
    ref, _, line = text.split("\n")[0].removeprefix("[").partition("] ")
    word = (line.split() or [""])[0].replace("\\", "\\\\").replace('"', '\\"')
    fact = f'{{"param_code": "M-052", "value": "{word}", "ref": "{ref}"}}'
    return f'```json\n{{"facts": [{fact}, {{"param_code": "M-052", "value": "никогда7", "ref": "1:0"}}, {{"param_code": "X-1", "value": "{word}", "ref": "{ref}"}},]}}\n```'


def llm_extraction(spark, sf_dir):
    """Chunks of 2000 characters of documents, asked of a stub: its verified facts, and the chunks that failed."""
    docs = read(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").alias("id"), F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    chunks = proposals.chunked(lines, 2000)
    answers = proposals.ask(proposals.questions(chunks, [("M-052", "Цвет облицовки", "")]), _stub, proposals.Limits(tries=2, pause=0.0, budget=1 << 40))
    facts = proposals.candidates(answers, chunks, {"M-052": "string"}, {})
    failed = answers.where("error is not null").select(F.col("id").alias("doc_id"), F.col("chunk").cast("long").alias("chunk"), F.lit(-1).cast("long").alias("line"), F.col("error").alias("value"), "tries")
    return facts.select(F.col("id").alias("doc_id"), F.col("chunk").cast("long").alias("chunk"), F.col("line").cast("long").alias("line"), F.col("value_raw").alias("value"), F.lit(1).alias("tries")).union(failed)


_LLM = """
with recursive l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n from documents),
c as (select doc_id, n, line, length('[1:' || (n - 1) || '] ' || line) + 1 as c from l),
w as (select doc_id, n, c as s, 0 as chunk from c where n = 1
  union all select c.doc_id, c.n, case when w.s + c.c - 1 > 2000 then c.c else w.s + c.c end, case when w.s + c.c - 1 > 2000 then w.chunk + 1 else w.chunk end from w join c on c.doc_id = w.doc_id and c.n = w.n + 1),
g as (select w.doc_id, chunk, min(w.n) as first, sum(c)::bigint - 1 as chars from w join c on c.doc_id = w.doc_id and c.n = w.n group by 1, 2),
f as (select g.*, regexp_extract(line, '[^ \t\n\r\f\v]+') as word from g join c on c.doc_id = g.doc_id and c.n = g.first)
select doc_id, chunk::bigint as chunk, first - 1 as line, word as value, 1 as tries from f where chars % 13 <> 0 and word <> ''
union all select doc_id, chunk, -1, 'ConnectionError: down', 2 from f where chars % 13 = 0"""


def llm_chunks(spark, sf_dir):
    """Chunks of at most 2000 characters that a document's lines fill in order."""
    t = read(spark, sf_dir, "documents").select("doc_id", F.array_max(extraction.chunk_lines(F.split("text", "\n"), 2000)).alias("last"))
    return t.select("doc_id", (F.col("last") + 1).cast("long").alias("chunks"))


_CHUNKS = """
with recursive l as (select doc_id, unnest([length('[1:' || (i - 1) || '] ' || x) + 1 for x, i in string_split(text, chr(10))]) as c, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n from documents),
w as (select doc_id, n, c as s, 0 as chunk from l where n = 1
  union all select l.doc_id, l.n, case when w.s + l.c - 1 > 2000 then l.c else w.s + l.c end, case when w.s + l.c - 1 > 2000 then w.chunk + 1 else w.chunk end from w join l on l.doc_id = w.doc_id and l.n = w.n + 1)
select doc_id, (max(chunk) + 1)::bigint as chunks from w group by 1"""


def ocr_line_build(spark, sf_dir):
    """Lines of OCR words made of lineitems: words of a returned line have negative confidence."""
    t = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.lit(1).alias("page"), F.lit(0).alias("block"), F.lit(0).alias("par"), (F.col("l_linenumber") % 2).alias("line"), F.col("l_linenumber").alias("word"),
        F.col("l_suppkey").cast("string").alias("text"), F.when(F.col("l_returnflag") == "R", -1.0).otherwise(90.0).alias("conf"),
        F.col("l_discount").alias("x0"), F.col("l_tax").alias("y0"), (F.col("l_discount") + 0.1).alias("x1"), (F.col("l_tax") + 0.1).alias("y1"),
    )
    return layout.ocr_lines(t).groupBy("id").agg(F.count(F.lit(1)).alias("n_lines"), F.min(F.length("text")).cast("long").alias("shortest"))


_OCR = """select id, count(*) as n_lines, min(length(text))::bigint as shortest from (select l_orderkey as id, l_linenumber % 2 as line, string_agg(l_suppkey::varchar, ' ' order by l_linenumber) as text
  from lineitem where l_returnflag <> 'R' group by 1, 2) group by 1"""

def content_sniff_each(spark, sf_dir):
    """Format of each document behind one of six heads, byte-order marks and blanks among them."""
    heads = F.array(*map(F.lit, ("%PDF-1.7 ", "PK\x03\x04", '\n <?xml version="1.0"?>', "", "\ufeff\t<?xml?>", " %PDF-")))
    return read(spark, sf_dir, "documents").select("doc_id", layout.sniff(F.concat(F.get(heads, (F.col("doc_id") % 6).cast("int")), "text")).alias("kind"))


def ocr_lines_whole(spark, sf_dir):
    """Lines of OCR words made of lineitems with their text, box and place on the page."""
    t = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.lit(1).alias("page"), F.lit(0).alias("block"), F.lit(0).alias("par"), (F.col("l_linenumber") % 3).alias("line"), F.col("l_linenumber").alias("word"),
        F.col("l_suppkey").cast("string").alias("text"), F.when(F.col("l_returnflag") == "R", -1.0).otherwise(90.0).alias("conf"),
        (F.col("l_linenumber") / 16).alias("x0"), (F.col("l_linenumber") % 3 / 8 + F.col("l_linenumber") / 64).alias("y0"), (F.col("l_linenumber") / 16 + 0.125).alias("x1"), (F.col("l_linenumber") % 3 / 8 + 0.5).alias("y1"),
    )
    return layout.ocr_lines(t).select("id", F.col("n").cast("long").alias("n"), "text", *(F.col("bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


_OCR_WHOLE = """with w as (select l_orderkey as id, l_linenumber as k, l_linenumber % 3 as line, l_suppkey from lineitem where l_returnflag <> 'R'),
l as (select id, line, string_agg(l_suppkey::varchar, ' ' order by k, l_suppkey::varchar) as text, min(k) / 16.0::double as x0, min(line / 8.0 + k / 64.0)::double as y0, max(k / 16.0 + 0.125)::double as x1, max(line / 8.0 + 0.5)::double as y1 from w group by 1, 2)
select id, row_number() over (partition by id order by y0, x0) - 1 as n, text, x0, y0, x1, y1 from l"""

QUERIES = {
    "content_sniff_each": (content_sniff_each, "select doc_id, case doc_id % 6 when 0 then 'pdf' when 1 then 'zip' when 2 then 'xml' when 4 then 'xml' end as kind from documents"),
    "ocr_lines_whole": (ocr_lines_whole, _OCR_WHOLE),
    "content_sniff": (content_sniff, _SNIFF),
    "dup_content_sha256": (dup_content_sha256, _DUP),
    "layout_lines": (layout_lines, _LINES),
    "quality_grade": (quality_grade, _GRADE),
    "extract_label_value": (extract_label_value, _EXTRACT),
    "extract_all_patterns": (extract_all_patterns, _all_sql()),
    "llm_fact_verify": (llm_fact_verify, _VERIFY),
    "llm_chunks": (llm_chunks, _CHUNKS),
    "llm_extraction": (llm_extraction, _LLM),
    "ocr_line_build": (ocr_line_build, _OCR),
}
