"""Token counts with a whole-token shortcut.

Offline, every vocabulary string is encoded alone; those that come out as one
token are proven whole. This is done once, on the driver; workers get the
proven strings and the encoder's model as they are. A pre-token that is one of
them counts 1 by a look-up; any other is merged by the library, and remembered
if it is short (a table of bounded bytes per worker). Documents are counted
where they are read: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm import pieces
from tallyline.llm.common import read_table, thrifty

#: Merged pre-tokens that a worker remembers: their longest, and about how many bytes all may take. The table starts anew beyond it.
REMEMBERED_CHARS, REMEMBERED_BYTES = 64, 48 << 20
#: Bytes of an entry besides its characters, at four bytes each.
_ENTRY = 160


class Proven(NamedTuple):
    """What workers need of a model: its name, the strings that are one token, and the encoder of pre-tokens."""

    path: str
    whole: tuple[str, ...]
    model: bytes


def prove(path: str) -> Proven:
    """Encode each vocabulary string alone."""
    model = pieces.load(path)
    return Proven(path, tuple(sorted(model.whole())), model.plain.serialized_model_proto())


class _Counts(dict):
    """Pre-token to number of tokens."""

    def __init__(self, proven: Proven):
        self.proven, self.encoder = proven, None
        self.reset()

    def reset(self) -> None:
        self.clear()
        self[""] = 0
        self.update(dict.fromkeys(self.proven.whole, 1))
        self.left = REMEMBERED_BYTES

    def __missing__(self, word: str) -> int:
        if self.encoder is None:
            import sentencepiece

            self.encoder = sentencepiece.SentencePieceProcessor(model_proto=self.proven.model)
        n = len(self.encoder.encode(word))
        if len(word) <= REMEMBERED_CHARS:
            self.left -= _ENTRY + 4 * len(word)
            if self.left < 0:
                self.reset()
            self[word] = n
        return n


_tables: dict[str, _Counts] = {}


def count_tokens(text: str | None, proven: Proven) -> int:
    """Tokens of one text; null counts as empty."""
    table = _tables.get(proven.path)
    if table is None:
        table = _tables[proven.path] = _Counts(proven)
    return sum(map(table.__getitem__, pieces.pretokens(text or "")))


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs`` (doc_id, text).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids
    stay as they are; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(prove(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count_tokens(t.as_py(), held.value) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return plain.mapInArrow(thrifty(run), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents under the 32k piece vocabulary."""
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
