"""From files to findings: PDF documents that Spark writes from parts, read back as pages, facts and a protocol."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.plans import reconciliation
from tallyline.queries.comparison import read
from tallyline.sources import documents


@functools.lru_cache(4096)
def _utf16(letter: str) -> str:
    return letter.encode("utf-16-be").hex()


def pdf_bytes(pages: list[list[str]], size: float = 11.0) -> bytes:
    """A PDF of pages of lines, its letters numbered in a table of their own as word processors do."""
    letters = sorted({c for page in pages for line in page for c in line})
    number = {c: f"{i:04X}" for i, c in enumerate(letters, 1)}
    shown = lambda line: "".join(map(number.__getitem__, line))
    cmap = "".join(f"<{i}> <{_utf16(c)}>\n" for c, i in number.items())
    bodies = [f"BT /F1 {size} Tf 1 0 0 1 56 780 Tm {size * 1.4:.1f} TL\n" + "".join(f"<{shown(line)}> Tj T*\n" for line in page) + "ET" for page in pages]
    kids = " ".join(f"{6 + 2 * i} 0 R" for i in range(len(pages)))
    parts = [
        "<< /Type /Catalog /Pages 2 0 R >>",
        f"<< /Type /Pages /Count {len(pages)} /Kids [{kids}] /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> >>",
        "<< /Type /Font /Subtype /Type0 /BaseFont /Sans /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>",
        "<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Sans /DW 520 >>",
        f"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange {len(number)} beginbfchar\n{cmap}endbfchar endcmap",
    ]
    for i, body in enumerate(bodies):
        parts += [f"<< /Type /Page /Parent 2 0 R /Contents {7 + 2 * i} 0 R >>", body]
    out, places = bytearray(b"%PDF-1.7\n"), []
    for i, part in enumerate(parts, 1):
        places.append(len(out))
        if i == 5 or i > 6 and i % 2:
            packed = zlib.compress(part.encode())
            out += f"{i} 0 obj\n<< /Length {len(packed)} /Filter /FlateDecode >>\nstream\n".encode() + packed + b"\nendstream\nendobj\n"
        else:
            out += f"{i} 0 obj\n{part}\nendobj\n".encode()
    table = "".join(f"{at:010d} 00000 n \n" for at in places)
    end = len(out)
    return bytes(out) + f"xref\n0 {len(parts) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(parts) + 1} /Root 1 0 R >>\nstartxref\n{end}\n%%EOF\n".encode()


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PDF files of (path, head, first, second, damage)."""
    for batch in batches:
        made = []
        for head, first, second, damage in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            content = pdf_bytes([[head, *first], second])
            made.append(content[: len(content) // 2] if damage else content)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["path", "content"])


def _parts(spark, sf_dir) -> DataFrame:
    """What is in two documents a part, of the design and the working stage, of two pages: height, area and door width. Some files are cut off, some pages are scans."""
    t = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.explode(F.array(F.lit("PD"), F.lit("RD"))).alias("stage"))
    k, size, working = F.col("k"), F.col("size"), (F.col("stage") == "RD").cast("int")
    area = F.concat(F.lit("Площадь застройки — 1 "), F.lpad((size + working * (k % 4 == 0).cast("int")).cast("string"), 3, "0"), F.lit(",5 м²"))
    height = F.concat(F.lit("Высота здания: "), (size + working * (k % 3 - 1)).cast("string"), F.lit(" м"))
    door = F.concat(F.lit("ШИРИНА ДВЕРЕЙ, не менее "), size.cast("string"), F.lit("00 мм"))
    scanned = (k % 89 == 0) & (working == 0)
    none = F.array().cast("array<string>")
    first = F.when(scanned, none).otherwise(F.array(area, F.lit("Прочие показатели здания без значений"), height))
    second = F.when(scanned, none).otherwise(F.array(door, F.lit("Второй лист пояснительной записки к проекту")))
    head = F.when(scanned, "").otherwise(F.concat(F.lit("Технико-экономические показатели, том "), k.cast("string")))
    return t.select(F.concat_ws("/", F.lit("docs"), k.cast("string"), F.concat(F.col("stage"), F.lit(".pdf"))).alias("path"), head.alias("head"), first.alias("first"), second.alias("second"), ((k % 97 == 0) & (working == 1)).alias("damage"))


def _documents(spark, sf_dir) -> DataFrame:
    """The documents as files. Few bytes, much work: dealt to all cores."""
    return _parts(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism).mapInArrow(_written, "path string, content binary")


def _files(pages: DataFrame) -> DataFrame:
    """Files as the registry knows them: their process and stage are in the path."""
    part = lambda n: F.split_part("path", F.lit("/"), F.lit(n))
    return pages.select("path", F.col("path").alias("file_id"), part(2).cast("long").alias("process_id"), F.regexp_replace(part(3), r"\.pdf$", "").alias("stage"))


def pdf_pages(spark, sf_dir):
    """Pages of the documents with what was read of them."""
    pages = documents.pages_of_files(_documents(spark, sf_dir))
    return pages.select("path", F.coalesce("page", F.lit(0)).alias("page"), "n_pages", "method", "chars", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"), F.split_part("error", F.lit(":"), F.lit(1)).alias("error"))


_TEXTS = """with t as (select p_partkey as k, p_size as size, s.stage, s.w from part cross join (values ('PD', 0), ('RD', 1)) s(stage, w)),
p as (select 'docs/' || k || '/' || stage || '.pdf' as path, k % 97 = 0 and w = 1 as damage, k % 89 = 0 and w = 0 as scanned,
  'Технико-экономические показатели, том ' || k || chr(10) || 'Площадь застройки — 1 ' || lpad((size + case when w = 1 and k % 4 = 0 then 1 else 0 end)::varchar, 3, '0') || ',5 м²' || chr(10) || 'Прочие показатели здания без значений' || chr(10) || 'Высота здания: ' || (size + w * (k % 3 - 1)) || ' м' as first,
  'ШИРИНА ДВЕРЕЙ, не менее ' || size || '00 мм' || chr(10) || 'Второй лист пояснительной записки к проекту' as second from t),
e as (select path, n as page, case when scanned then '' when n = 1 then first else second end as text from p cross join (values (1), (2)) x(n) where not damage)
select path, page, 2 as n_pages, case when text = '' then 'needs_ocr' else 'vector_text' end as method, length(replace(text, chr(10), ''))::int as chars, text, null as error from e
union all select path, 0, null, null, null, null, 'REJECTED_CORRUPTED' from p where damage"""


def files_to_protocol(spark, sf_dir):
    """The numbered findings of each part from its two files: extraction, best facts, comparison by rule."""
    found = reconciliation.protocol_of_files(documents.pages_of_files(_documents(spark, sf_dir)), _files(_parts(spark, sf_dir)))
    return found.select("process_id", F.col("place").cast("long").alias("place"), "param_code", "finding_status", "delta", "expected_value", "actual_value")


_PROTOCOL = """with m(code) as (values ('M-001'), ('M-008'), ('M-041')),
v as (select p_partkey as k, code, case code when 'M-001' then 1000.5 + p_size when 'M-008' then p_size else p_size / 10.0 end as e,
  case code when 'M-001' then 1000.5 + p_size + case when p_partkey % 4 = 0 then 1 else 0 end when 'M-008' then p_size + p_partkey % 3 - 1 else p_size / 10.0 end as a from part cross join m),
n as (select k, code, case when k % 89 = 0 then null else e end as e, case when k % 97 = 0 then null else a end as a from v where k % (89 * 97) <> 0),
s as (select *, case when a is null or e is null and code <> 'M-041' then 'MISSING_EVIDENCE' when code = 'M-001' and a <> e or code = 'M-008' and a > e or code = 'M-041' and a < 0.9 then 'CANDIDATE' else 'NEGATIVE_VERIFIED' end as st from n),
f as (select *, regexp_replace(regexp_replace(e::decimal(12, 1)::varchar, '\\.0$', ''), '^$', '') as es, regexp_replace(a::decimal(12, 1)::varchar, '\\.0$', '') as ac from s)
select k as process_id, row_number() over (partition by k order by case st when 'CANDIDATE' then 0 when 'MISSING_EVIDENCE' then 2 else 4 end, code) as place, code as param_code, st as finding_status,
  case when st = 'CANDIDATE' and code <> 'M-041' then regexp_replace((a - e)::decimal(12, 1)::varchar, '\\.0$', '') end as delta,
  case when st <> 'MISSING_EVIDENCE' and code <> 'M-041' then es end as expected_value, case when st <> 'MISSING_EVIDENCE' then ac end as actual_value from f"""

QUERIES = {"pdf_pages": (pdf_pages, _TEXTS), "files_to_protocol": (files_to_protocol, _PROTOCOL)}
