"""Scalar functions on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.functions import scalars as S
from tallyline.functions.sql import register_functions
from tallyline.queries.comparison import read


def parse_number(spark, sf_dir):
    """Numbers of customer names and of balances written with thousand spaces and a comma."""
    t = read(spark, sf_dir, "customer")
    written = F.concat(F.lit("≈ "), F.translate(F.format_number("c_acctbal", 2), ",.", " ,"), F.lit(" руб."))
    return t.select("c_custkey", S.parse_number(F.col("c_name")).alias("of_name"), S.parse_number(written).alias("of_balance"))


_PARSE = """select c_custkey, try_cast(nullif(regexp_extract(c_name, '[-+]?\\d+(?:[.,]\\d+)?'), '') as double) as of_name,
  try_cast(replace(regexp_extract(replace(replace(format('{:,.2f}', c_acctbal), ',', ''), '.', ','), '[-+]?\\d+(?:[.,]\\d+)?'), ',', '.') as double) as of_balance from customer"""


def normalize_token(spark, sf_dir):
    t = read(spark, sf_dir, "part")
    return t.select("p_partkey", S.normalize_token(F.concat(F.lit("  в"), F.col("p_brand"), F.lit(",5 "))).alias("token"), S.ordinal_canon(F.concat(F.lit("к м "), F.col("p_size").cast("string"))).alias("canon"))


def normalize_text(spark, sf_dir):
    """Length and digest of every whole text's normal form."""
    plain = S.normalize_text(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.length(plain).cast("long").alias("n"), F.sha2(plain, 256).alias("digest"))


def unit_convert(spark, sf_dir):
    """Sizes in millimetres, centimetres or metres, in metres; another unit stays."""
    t = read(spark, sf_dir, "part")
    unit = F.get(F.array(*map(F.lit, ("мм", "СМ.", "м", "м2"))), (F.col("p_partkey") % 4).cast("int"))
    return t.select("p_partkey", S.canon_unit(unit).alias("unit"), S.to_matrix_unit(F.col("p_size").cast("double"), unit, F.lit("м")).alias("value"))


_UNIT = """select p_partkey, case p_partkey % 4 when 0 then 'мм' when 1 then 'см' when 2 then 'м' else 'м²' end as unit,
  case p_partkey % 4 when 0 then round(p_size * 0.001::double, 9) when 1 then round(p_size * 0.01::double, 9) else p_size::double end as value from part"""


def percent_delta(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_tax") * 100).alias("e"), F.col("l_quantity").alias("a"))
    return t.groupBy("l_orderkey").agg(F.count_if(S.pct_of(F.col("e"), F.col("a")) > 1000).alias("far"), F.count_if(S.pct_of(F.col("e"), F.col("a")) == float("inf")).alias("infinite"))


_PCT = """select l_orderkey, count(*) filter (case when e = 0 then a <> 0 else abs(a - e) / abs(e) * 100 > 1000 end) as far, count(*) filter (e = 0 and a <> 0) as infinite
  from (select l_orderkey, l_tax * 100 as e, l_quantity as a from lineitem) group by 1"""


def bbox_normalize(spark, sf_dir):
    t = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"))
    box = S.norm_bbox(F.col("s") - 5, F.col("s"), F.col("s") + 5, F.col("s"), F.lit(50.0), F.lit(60.0))
    return t.select("p_partkey", *(F.round(box[i], 4).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


_BBOX = """select p_partkey, round(greatest(0, least(1, (s - 5) / 50)), 4) as x0, round(s / 60, 4) as y0, round(greatest(0, least(1, (s + 5) / 50)), 4) as x1, round(s / 60 + 0.0001, 4) as y1
  from (select p_partkey, p_size::double as s from part)"""


def number_format(spark, sf_dir):
    """Plain decimals, and back."""
    t = read(spark, sf_dir, "customer")
    return t.select("c_custkey", S.fmt_num(F.round(F.col("c_acctbal"), 0)).alias("whole"), S.fmt_num(F.col("c_acctbal")).cast("double").alias("back"))


def sql_functions(spark, sf_dir):
    """The registered SQL functions, called from SQL."""
    register_functions(spark)
    read(spark, sf_dir, "supplier").createOrReplaceTempView("tallyline_supplier")
    return spark.sql("select s_suppkey, parse_number(s_name) as number, normalize_token(s_name) as token, pct_of(100D, s_acctbal) as off, round6(s_acctbal / 3) as third from tallyline_supplier")


def date_normalize(spark, sf_dir):
    """Order dates written in five layouts and one that isn't a date."""
    t = read(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    layouts = ("yyyy-MM-dd", "dd.MM.yyyy", "d.M.yyyy", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss")
    written = F.get(F.array(*(F.date_format(d, f) for f in layouts), F.lit("soon")), (F.col("o_orderkey") % 6).cast("int"))
    return t.select("o_orderkey", F.date_format(S.parse_date(written), "yyyy-MM-dd").alias("iso"))


def retry_backoff(spark, sf_dir):
    t = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("attempts"))
    n = F.col("attempts")
    return t.select("attempts", S.relay_backoff(n).alias("relay"), S.worker_backoff(n).alias("worker"), S.consumer_backoff(n).alias("consumer"))


QUERIES = {
    "parse_number": (parse_number, _PARSE),
    "normalize_token": (normalize_token, "select p_partkey, translate(upper(trim('  в' || p_brand || ',5 ')), 'АВСЕКМНОРТХ,', 'ABCEKMHOPTX.') as token, 'KM' || p_size as canon from part"),
    "normalize_text": (normalize_text, "select doc_id, length(t)::bigint as n, sha256(t) as digest from (select doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) as t from documents)"),
    "unit_convert": (unit_convert, _UNIT),
    "percent_delta": (percent_delta, _PCT),
    "bbox_normalize": (bbox_normalize, _BBOX),
    "number_format": (number_format, "select c_custkey, (round(c_acctbal, 0)::bigint)::varchar as whole, c_acctbal as back from customer"),
    "sql_functions": (sql_functions, "select s_suppkey, try_cast(nullif(regexp_extract(s_name, '[-+]?\\d+(?:[.,]\\d+)?'), '') as double) as number, upper(trim(s_name)) as token, abs(s_acctbal - 100) / 100 * 100 as off, round(s_acctbal / 3, 6) as third from supplier"),
    "date_normalize": (date_normalize, "select o_orderkey, case when o_orderkey % 6 = 5 then null else strftime(o_orderdate, '%Y-%m-%d') end as iso from orders"),
    "retry_backoff": (retry_backoff, "select n_nationkey as attempts, least(power(2.0::double, least(n_nationkey, 10)), 60) as relay, least(power(2.0::double, n_nationkey - 1), 30) as worker, n_nationkey::double as consumer from nation"),
}
