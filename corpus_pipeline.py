"""Corpus pipeline: toxicity, near duplicates, benchmark leaks, personal data, tokens.

``STAGES`` lists (name, function) in order; each function takes (spark, docs,
sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import read_table, saved, small_or_not
from tallyline.llm.decontaminate import leaks
from tallyline.llm.jaccard_join import near_duplicates
from tallyline.llm.pii import find_spans, mask
from tallyline.llm.piece_codec import encode_documents
from tallyline.llm.toxicity import fit, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go.

    Null and empty texts score as the model's constant and stay unless it
    rejects them; repeated rows share their fate. Without labels of both kinds
    the grammar's fixed weights decide. Columns of any name pass by.
    """
    return without_toxic(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays.

    Null, empty and wordless texts are nobody's copies and stay, as do rows
    with a null id. Rows that repeat an id stay or go together: they are one
    document here. Columns of any name pass by.
    """
    groups = near_duplicates(docs.select("doc_id", "text"))
    spare = saved(groups.where("doc_id <> component_id").select("doc_id").distinct(), "spare")
    return docs.join(small_or_not(spare), "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised ones too, go.

    Null and empty texts and null ids hold none; an empty benchmark takes
    nothing; rows that repeat an id go together. Columns of any name pass by.
    """
    found = saved(leaks(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaking")
    return docs.join(small_or_not(found), "doc_id", "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal spans become their kind in brackets; ``n_chars``, where there is one, follows a text that changed.

    Null texts stay null, empty ones empty; no row goes, repeated ones are
    masked each. Columns of any name pass by inside a struct.
    """
    masked = find_spans(docs).select("row", mask(F.col("row.text"), F.col("spans")).alias("masked"))
    new = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("row.text") == F.col("masked"), F.col("row.n_chars")).otherwise(F.length("masked")).cast(docs.schema["n_chars"].dataType)
    return masked.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with merge-dropout of all that is left, a row each; null and empty texts have none."""
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicate", near_duplicate),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: Models and hashed sets: not SQL. tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of a folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
