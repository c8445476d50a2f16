"""Layouts: pages of lines with boxes, their statistics, and OCR lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAYOUT = "array<struct<page:int,method:string,width:double,height:double,chars:int,lines:array<struct<text:string,bbox:array<double>>>>>"
PAGE_CHARS, OTHER_CHARS = 30, 1


def sniff(content: Column) -> Column:
    """Format of the head of a file's text: pdf, zip (docx if a part says so), xml or null."""
    head = F.regexp_replace(content, r"^﻿?[ \t\r\n]*", "")
    return F.when(F.startswith(content, F.lit("%PDF-")), "pdf").when(F.startswith(content, F.lit("PK\x03\x04")), "zip").when(F.startswith(head, F.lit("<?xml")), "xml")


def lines(layouts: DataFrame) -> DataFrame:
    """(id, page, line, text, bbox, next_text, next_bbox) of layouts (id, pages): each line with the next of its page."""
    pages = layouts.select("id", F.explode("pages").alias("p"))
    flat = pages.select("id", F.col("p.page").alias("page"), F.col("p.method").alias("method"), F.col("p.lines").alias("l"))
    each = flat.select("id", "page", "method", F.posexplode(F.transform("l", lambda x, i: F.struct(x.alias("now"), F.get(F.col("l"), i + 1).alias("then")))).alias("line", "x"))
    return each.select("id", "page", "method", "line", F.col("x.now.text").alias("text"), F.col("x.now.bbox").alias("bbox"), F.col("x.then.text").alias("next_text"), F.col("x.then.bbox").alias("next_bbox"))


def lines_of_pages(pages: DataFrame) -> DataFrame:
    """As ``lines``, of a row a page (id, page, method, lines): what a reader of files gives. Pages without lines give none."""
    joined = F.transform("lines", lambda x, i: F.struct(x.alias("now"), F.get(F.col("lines"), i + 1).alias("then")))
    each = pages.select("id", "page", "method", F.posexplode(joined).alias("line", "x"))
    return each.select("id", "page", "method", "line", F.col("x.now.text").alias("text"), F.col("x.now.bbox").alias("bbox"), F.col("x.then.text").alias("next_text"), F.col("x.then.bbox").alias("next_bbox"))


def file_quality(pages: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, pages, chars, text_pages, ocr_pages, quality) of files from a row a page (id, page, kind, method, chars, error).

    PDF pages need 30 characters to count as text, those of other kinds one. A
    page or a file that couldn't be read counts as none.
    """
    sums = pages.groupBy(*keys).agg(*(v.alias(k) for k, v in _page_sums().items()))
    return sums.withColumn("quality", quality(F.col("pages"), F.col("text_pages")))


def page_quality(keys: tuple[str, ...] = ("id",)) -> Column:
    """The grade of ``file_quality`` on each of a file's page rows: the pages are gone through once."""
    sums, file = _page_sums(), Window.partitionBy(*keys)
    return quality(sums["pages"].over(file), sums["text_pages"].over(file))


def _page_sums() -> dict[str, Column]:
    read = F.col("error").isNull() & F.col("page").isNotNull()
    text = read & (F.col("chars") >= F.when(F.col("kind") == "pdf", PAGE_CHARS).otherwise(OTHER_CHARS))
    return {"pages": F.count_if(read), "chars": F.coalesce(F.sum("chars"), F.lit(0)), "text_pages": F.count_if(text), "ocr_pages": F.count_if(read & (F.col("method") == "ocr"))}


def quality(n_pages: Column, text_pages: Column) -> Column:
    return F.when(n_pages == 0, "FAILED").when(text_pages == 0, "ABSTAIN").when(text_pages < n_pages, "LOW_QUALITY").otherwise("OK")


def page_stats(pages: Column, min_chars: int = PAGE_CHARS) -> Column:
    """Pages, characters, text and OCR pages, and the grade of a layout's pages."""
    n, text = F.size(pages), F.size(F.filter(pages, lambda p: p["chars"] >= min_chars))
    return F.struct(
        n.alias("pages"),
        F.aggregate(pages, F.lit(0).cast("long"), lambda s, p: s + p["chars"]).alias("chars"),
        text.alias("text_pages"),
        F.size(F.filter(pages, lambda p: p["method"] == "ocr")).alias("ocr_pages"),
        quality(n, text).alias("quality"),
    )


def ocr_lines(words: DataFrame) -> DataFrame:
    """Lines of OCR words (id, page, block, par, line, word, text, conf, x0, y0, x1, y1): words of negative confidence are dropped."""
    keys = ["id", "page", "block", "par", "line"]
    parts = F.array_sort(F.collect_list(F.struct("word", "x0", "text")))
    made = words.where("conf >= 0 and trim(text) <> ''").groupBy(*keys).agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"),
        F.array(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).alias("bbox"),
    )
    order = Window.partitionBy("id", "page").orderBy(F.col("bbox")[1], F.col("bbox")[0])
    return made.withColumn("n", F.row_number().over(order) - 1).select("id", "page", "n", "text", "bbox")


def text_layout(docs: DataFrame, key: str) -> DataFrame:
    """(id, page, line, text) of plain texts, form feeds ending pages and line feeds lines; blank lines are left out."""
    pages = docs.select(F.col(key).alias("id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\f")).alias("p", "page_text"))
    each = pages.select("id", (F.col("p") + 1).alias("page"), F.posexplode(F.split("page_text", "\r?\n")).alias("n", "text"))
    return each.where("trim(text) <> ''").select("id", "page", F.col("n").alias("line"), "text")
