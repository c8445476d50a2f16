"""Facts that a language model proposes: chunks, questions asked in bounded numbers, answers mended, values verified.

The client is a function from messages to the answer's text, so any service
fits; off by default, as nothing here calls one by itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import scalars as S
from tallyline.operators import extraction

CHUNK_CHARS = 7000
CONFIDENCE = 0.7
# Fixed value: what the model is told.
SYSTEM = (
    "Ты извлекаешь значения контролируемых параметров из текста строительной документации (ПД/РД/ИД). Верни ТОЛЬКО JSON вида "
    '{"facts": [{"param_code": "M-001", "value": "...", "unit": "...", "ref": "страница:строка"}]}. Правила: значение копируй из текста дословно, ничего не вычисляй и не придумывай; '
    "ref — метка строки из квадратных скобок, где найдено значение; если параметра в тексте нет — не включай его; один параметр — не более одного значения на строку."
)

Client = Callable[[list[dict]], str]


@dataclass(frozen=True)
class Limits:
    """Questions at once in a task, tries of a chunk, seconds before the second try (then twice as many), and failed tries of a task after which chunks are tried once."""

    at_once: int = 4
    tries: int = 3
    pause: float = 1.0
    budget: int = 100


def chunked(lines: DataFrame, size: int = CHUNK_CHARS) -> DataFrame:
    """``lines`` (id, page, line, text, bbox) with their chunk: lines as ``[page:line] text`` are added in order while their characters stay within ``size``.

    A longer line is a chunk of its own. Chunks count from 0 in each id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, chunk = object(), 0, 0
        for batch in batches:
            numbers = []
            for key, n in zip(batch.column(0).to_pylist(), batch.column(5).to_pylist()):
                if key != now:
                    now, held, chunk = key, 0, 0
                if held and held + n > size:
                    held, chunk = 0, chunk + 1
                held += n + 1
                numbers.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(numbers, pa.int32())], ["id", "page", "line", "text", "bbox", "chunk"])

    kind = lines.schema["id"].dataType.simpleString()
    shown = F.length(F.concat(F.lit("["), F.col("page").cast("string"), F.lit(":"), F.col("line").cast("string"), F.lit("] "), F.coalesce("text", F.lit(""))))
    some = lines.select("id", F.col("page").cast("int").alias("page"), F.col("line").cast("int").alias("line"), "text", (F.col("bbox") if "bbox" in lines.columns else F.lit(None)).cast("array<double>").alias("bbox"), shown.alias("n"))
    # a sort and a pass as in ``ordered_fold``, but texts stay in their columns: only numbers are looked at
    return some.repartition("id").sortWithinPartitions("id", "page", "line").mapInArrow(run, f"id {kind}, page int, line int, text string, bbox array<double>, chunk int")


def questions(chunks: DataFrame, catalogue: list[tuple[str, str, str]]) -> DataFrame:
    """(id, chunk, question) of chunked lines, for parameters (code, name, unit). A chunk's text is bounded by its size."""
    shown = F.concat(F.lit("["), F.col("page").cast("string"), F.lit(":"), F.col("line").cast("string"), F.lit("] "), F.coalesce("text", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("page", "line", shown.alias("t"))))
    head = "Параметры (код | название | единица):\n" + "\n".join(" | ".join(p) for p in catalogue) + "\n\nТекст документа:\n"
    return chunks.groupBy("id", "chunk").agg(F.concat(F.lit(head), F.array_join(F.transform(parts, lambda p: p["t"]), "\n")).alias("question"))


def ask(asked: DataFrame, client: Client, limits: Limits = Limits()) -> DataFrame:  # noqa: B008  frozen
    """(id, chunk, answer, error, tries) of each row of ``asked`` (id, chunk, question); a chunk that fails is a row with its error.

    Each task asks ``limits.at_once`` questions at a time. Where a task has
    failed too often it no longer tries a chunk again, so that a service that is
    down costs one call a chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = [limits.budget]

        def one(question: str) -> tuple[str | None, str | None, int]:
            tries = 0
            while True:
                tries += 1
                try:
                    return client([{"role": "system", "content": SYSTEM}, {"role": "user", "content": question}]), None, tries
                except Exception as e:  # noqa: BLE001  whatever a client raises
                    left[0] -= 1
                    if tries >= limits.tries or left[0] < 0:
                        return None, f"{type(e).__name__}: {e}"[:500], tries
                    time.sleep(limits.pause * 2 ** (tries - 1))

        with ThreadPoolExecutor(limits.at_once) as pool:
            for batch in batches:
                got = list(pool.map(one, batch.column(2).to_pylist()))
                answers, errors, tries = zip(*got) if got else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(answers, pa.string()), pa.array(errors, pa.string()), pa.array(tries, pa.int32())], ["id", "chunk", "answer", "error", "tries"])

    kind = asked.schema["id"].dataType.simpleString()
    return asked.select("id", "chunk", "question").mapInArrow(run, f"id {kind}, chunk int, answer string, error string, tries int")


def mended(answer: Column) -> Column:
    """The facts of an answer as an array of variants: fences, words around the object, commas before a bracket and a cut-off end are seen over; null if nothing helps."""
    body = S.strip_fences(answer)
    inner = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    plain = F.regexp_replace(inner, r",\s*([}\]])", "$1")
    cut = F.concat(F.regexp_replace(F.regexp_extract(body, r"(?s)^[^{]*(\{.*\})", 1), r",\s*([}\]])", "$1"), F.lit("]}"))
    facts = lambda text: F.try_variant_get(F.try_parse_json(text), "$.facts", "array<variant>")
    return F.coalesce(facts(body), facts(inner), facts(plain), facts(cut))


def proposed(answers: DataFrame) -> DataFrame:
    """(id, chunk, param_code, value, unit, page, line) of answers; entries without a code or value are left out, a reference that isn't one is null."""
    each = answers.where("answer is not null").select("id", "chunk", F.explode(mended(F.col("answer"))).alias("f"))
    field = lambda name: F.trim(F.coalesce(F.try_variant_get("f", f"$.{name}", "string"), F.lit("")))
    ref = F.regexp_extract(field("ref"), r"^(\d+):(\d+)$", 0)
    rows = each.select("id", "chunk", field("param_code").alias("param_code"), field("value").alias("value"), field("unit").alias("unit"), F.split_part(ref, F.lit(":"), F.lit(1)).try_cast("int").alias("page"), F.split_part(ref, F.lit(":"), F.lit(2)).try_cast("int").alias("line"))
    return rows.where("param_code <> '' and value <> ''").withColumns({"page": F.coalesce("page", F.lit(-1)), "line": F.coalesce("line", F.lit(-1))})


def candidates(answers: DataFrame, chunks: DataFrame, kinds: dict[str, str], units: dict[str, str], only: set[str] | None = None) -> DataFrame:
    """Verified proposals in the columns of ``extraction.candidates``, with the method ``llm``.

    ``kinds`` gives the data type of each known parameter (number, ordinal,
    string), ``units`` its unit. Values that no line of the chunk holds are
    dropped, numbers that aren't any too.
    """
    known = {c for c in kinds if not only or c in only}
    lookup = lambda d: F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for pair in d.items() for v in pair)), "param_code") if d else F.lit(None).cast("string"), F.lit(""))
    found = extraction.verify_proposed(proposed(answers), chunks, known).withColumns({"kind": lookup(kinds), "want": lookup(units)})
    number = S.to_matrix_unit(S.parse_number_any_space(F.col("value")), F.when(F.col("unit") == "", F.col("want")).otherwise(F.col("unit")), F.col("want"))
    norm = F.when(F.col("kind") == "number", S.fmt_num(number)).when(F.col("kind") == "ordinal", S.ordinal_canon(F.col("value"))).otherwise(S.squash_spaces(F.col("value")))
    shown = F.when(F.col("kind") == "number", F.coalesce(F.nullif("want", F.lit("")), F.nullif("unit", F.lit(""))))
    return found.withColumn("value_norm", norm).where("value_norm is not null").select(
        "id", "page", F.lit("llm").alias("method"), "line", "param_code", "kind", F.trim(F.concat_ws(" ", "value", "unit")).alias("value_raw"), "value_norm", shown.alias("unit"), F.col("text").alias("quote"), "bbox", F.lit(CONFIDENCE).alias("confidence"), "chunk",
    )


def all_candidates(lines: DataFrame, answers: DataFrame, chunks: DataFrame, kinds: dict[str, str], units: dict[str, str], only: set[str] | None = None) -> DataFrame:
    """What patterns find in lines, and after it what a model proposed; ``method`` tells them apart."""
    by_pattern = extraction.candidates(lines.withColumn("method", F.lit("vector_text")), units, only)
    return by_pattern.unionByName(candidates(answers, chunks, kinds, units, only).drop("chunk"))
