"""SentencePiece encoding with seeded merge-dropout, and decoding.

Merging follows the model: of the adjacent symbol pairs of a pre-token whose
join is a piece, the best-scored and then leftmost is merged first. A candidate
merge is skipped when a keyed hash of (seed, document, place in the document,
place in the word, piece) falls under ``dropout``, so that each occurrence of a
word is cut on its own. Symbols outside the vocabulary, and the space mark where
a text holds it itself, become bytes; so decoding always gives the text back.

All occurrences of a chunk are merged together in numpy. A round takes the words
of one number of symbols as a matrix and does one merge of each; words that had
one symbol less to begin with join what is left for the next round. So there are
as many rounds as the longest word has symbols, and nothing is remembered
between words. Words of more than ``LONG`` symbols keep a heap as their agenda.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm import pieces
from tallyline.llm.common import read_table, thrifty
from tallyline.llm.pieces import MARK
from tallyline.llm.vectext import U, mix
from tallyline.llm.vectext import texts as plain_texts

#: Symbols of a word that rounds merge; longer words are merged by a heap. A symbol's place fits in ``_PLACE`` bits.
LONG, _PLACE = 64, 6
#: Bytes of text that are merged together: a worker's arrays take some hundred times as many.
CHUNK_BYTES = 1 << 18
#: Characters below this code have a dense table of their joins.
_COMMON = 0x250
_NONE = np.iinfo(np.int32).max
_SPREAD = 0x9E3779B97F4A7C15
_FILTER_BITS = 20
_WORD = (1 << 64) - 1


def _span(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of the runs of these sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _mixed(x: int) -> int:
    """``mix`` of one number."""
    x &= _WORD
    x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & _WORD
    x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 & _WORD
    return x ^ x >> 33


def _utf8_bytes(code: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of code points, and how many each has."""
    return code.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF).astype(np.int64)


class Codec:
    """Encoder and decoder of one model, dropout rate and seed."""

    def __init__(self, path: str, dropout: float = 0.1, seed: int = 0):
        if not 0 <= dropout <= 1:
            raise ValueError("dropout is a probability")
        self.model = model = pieces.load(path)
        self.limit = int(dropout * (1 << 32))
        self.seed = mix(np.array([seed & 0xFFFFFFFFFFFFFFFF], np.uint64))
        self.size = len(model.text)
        self.char = -1 - np.arange(0x110000, dtype=np.int32)  # a character outside the vocabulary is its own negative symbol
        for p, i in model.id.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[ord(" ")], self.char[ord(MARK)] = self.char[ord(MARK)], -1 - ord(MARK)  # a mark of the text itself is no space
        order = np.argsort(-model.score, kind="stable")
        self.by_rank = order.astype(np.int32)
        self.rank = np.empty(self.size, np.int32)
        self.rank[order] = np.arange(self.size)
        pairs = sorted((model.id[p[:c]] * self.size + model.id[p[c:]], i) for p, i in model.id.items() for c in range(1, len(p)) if p[:c] in model.id and p[c:] in model.id)
        self.pair = np.array([k for k, _ in pairs], np.int64)
        self.joined = np.array([i for _, i in pairs], np.int32)
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[self._slot(self.pair)] = True
        self.dense = np.full((_COMMON, _COMMON), -1, np.int32)
        for p, i in model.id.items():
            if len(p) == 2:
                a, b = (ord(" " if c == MARK else c) for c in p)
                if max(a, b) < _COMMON:
                    self.dense[a, b] = i
        surface = [t.replace(MARK, " ").encode() if k == 1 else bytes([int(t[3:5], 16)]) if k == 6 else b"" for t, k in zip(model.text, model.kind)]
        self.surface = surface
        self.surface_size = np.array(list(map(len, surface)), np.int64)
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size
        self.surface_bytes = np.frombuffer(b"".join(surface), np.uint8)
        self.byte = np.array([model.byte[b] for b in range(256)], np.int32)

    @staticmethod
    def _slot(pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * U(_SPREAD)) >> U(64 - _FILTER_BITS)).astype(np.int64)

    def _drawn(self, piece: np.ndarray, place: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Whether the join to each piece at a place of its word is skipped at the occurrence of that key."""
        return (mix(piece.astype(np.uint64) + (place.astype(np.uint64) << U(20)) + key) >> U(32)).astype(np.int64) < self.limit

    def _ranked(self, piece: np.ndarray, place: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Ranks of joins, or none where the keyed hash skips them."""
        rank = self.rank[piece]
        return np.where(self._drawn(piece, place, key), _NONE, rank) if self.limit else rank

    def _agenda(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, word: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Rank of each pair's join, or none: no such piece, or skipped by the keyed hash."""
        rank = np.full(len(left), _NONE, np.int32)
        pair = left.astype(np.int64) * self.size + right
        at = np.flatnonzero((left >= 0) & (right >= 0) & self.seen[self._slot(pair)])
        found = np.minimum(np.searchsorted(self.pair, pair[at]), len(self.pair) - 1)
        ok = self.pair[found] == pair[at]
        at = at[ok]
        rank[at] = self._ranked(self.joined[found[ok]], place[at], keys[word[at]])
        return rank

    def _first_agenda(self, code: np.ndarray, sym: np.ndarray, word: np.ndarray, place: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Rank of each character's join with the next one of its word."""
        rank = np.full(len(sym), _NONE, np.int32)
        if len(sym) < 2:
            return rank
        inner = word[1:] == word[:-1]
        low = code < _COMMON
        both = low[1:] & low[:-1]
        at = np.flatnonzero(inner & both)
        piece = self.dense[code[at], code[at + 1]]
        at, piece = at[piece >= 0], piece[piece >= 0]
        rank[at] = self._ranked(piece, place[at], keys[word[at]])
        at = np.flatnonzero(inner & ~both)
        if len(at):
            rank[at] = self._agenda(sym[at], sym[at + 1], place[at], word[at], keys)
        return rank

    def segment(self, code: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token ids, number of each word's tokens) of words given by code points, each at the occurrence of its key."""
        keys = np.asarray(keys, np.uint64)
        first = np.cumsum(lengths) - lengths
        sym, place = self.char[code], _span(lengths)
        word = np.repeat(np.arange(len(lengths)), lengths)
        rank = self._first_agenda(code, sym, word, place, keys)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # words, their symbols
        for w in np.flatnonzero(lengths > LONG):
            span = slice(first[w], first[w] + lengths[w])
            done.append((np.array([w]), self._merge_long(sym[span], rank[span], int(keys[w]))[:, None]))
        by_length = np.argsort(lengths, kind="stable")
        bounds = np.searchsorted(lengths[by_length], np.arange(LONG + 2))
        packed = (sym << _PLACE) + np.where(place < 1 << _PLACE, place, 0).astype(np.int32)  # a symbol and the place of its first character
        rows, symbols, ranks = np.zeros(0, np.int64), np.zeros((LONG, 0), np.int32), np.zeros((LONG - 1, 0), np.int32)
        for width in range(LONG, 0, -1):  # a column of the matrices is a word, so that numpy runs along many
            new = by_length[bounds[width] : bounds[width + 1]]
            if len(new):
                cells = first[new] + np.arange(width)[:, None]
                rows, symbols, ranks = np.concatenate([rows, new]), np.concatenate([symbols, packed[cells]], 1), np.concatenate([ranks, rank[cells[:-1]]], 1)
            if width == 1:
                done.append((rows, symbols >> _PLACE))
                break
            best = ranks.min(0)
            live = best != _NONE
            if not live.all():
                ended, live = np.flatnonzero(~live), np.flatnonzero(live)
                done.append((rows[ended], symbols[:, ended] >> _PLACE))
                rows, symbols, ranks, best = rows[live], symbols[:, live], ranks[:, live], best[live]
            symbols, ranks = self._merge(rows, symbols, ranks, best, keys)
        return self._assembled(len(lengths), done)

    def _merge(self, rows: np.ndarray, symbols: np.ndarray, ranks: np.ndarray, best: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One merge of each word: the leftmost pair of rank ``best`` becomes its piece."""
        width, n = symbols.shape
        met = np.logical_or.accumulate(ranks == best, 0)  # from the pair merged on
        at = width - 1 - met.sum(0, dtype=np.int64)
        some = np.arange(n)
        place = symbols[at, some] & LONG - 1
        joined = self.by_rank[best]
        merged = np.where(met, symbols[1:], symbols[:-1])
        ranks = np.where(met[:-1], ranks[1:], ranks[:-1])
        merged[at, some] = (joined << _PLACE) + place
        i = np.flatnonzero(at < width - 2)
        ranks[at[i], i] = self._agenda(joined[i], merged[at[i] + 1, i] >> _PLACE, place[i], rows[i], keys)
        i = np.flatnonzero(at > 0)
        left = merged[at[i] - 1, i]
        ranks[at[i] - 1, i] = self._agenda(left >> _PLACE, joined[i], left & LONG - 1, rows[i], keys)
        return merged, ranks

    def _merge_long(self, sym: np.ndarray, rank: np.ndarray, key: int) -> np.ndarray:
        """Symbols of one word, merged by a heap of (rank, place)."""
        n, table, by_rank = len(sym), self.joins, self.by_rank.tolist()
        ranks = self.rank.tolist()
        symbols, current = sym.tolist(), rank.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(current[i] << 40) + i for i in np.flatnonzero(rank != _NONE).tolist()]
        heapq.heapify(heap)
        def join(i: int, j: int) -> None:
            piece = table.get(symbols[i] * self.size + symbols[j]) if symbols[i] >= 0 and symbols[j] >= 0 else None
            current[i] = _NONE
            if piece is not None and not (self.limit and _mixed(piece + (i << 20) + key) >> 32 < self.limit):
                current[i] = ranks[piece]
                heapq.heappush(heap, (current[i] << 40) + i)

        while heap:
            entry = heapq.heappop(heap)
            best, i = entry >> 40, entry & (1 << 40) - 1
            if current[i] != best:
                continue  # of a pair that is no more
            j = after[i]
            symbols[i], symbols[j], current[j] = by_rank[best], None, _NONE
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                join(i, after[i])
            else:
                current[i] = _NONE
            if before[i] >= 0:
                join(before[i], i)
        return np.array([s for s in symbols if s is not None], np.int32)

    @property
    def joins(self) -> dict[int, int]:
        if not hasattr(self, "_joins"):
            self._joins = dict(zip(self.pair.tolist(), self.joined.tolist()))
        return self._joins

    def _assembled(self, words: int, done: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids in the order of words; symbols outside the vocabulary become bytes."""
        count = np.zeros(words, np.int64)
        for rows, symbols in done:
            count[rows] = len(symbols)
        start = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), np.int32)
        for rows, symbols in done:
            ids[start[rows] + np.arange(len(symbols))[:, None]] = symbols
        at = np.flatnonzero(ids < 0)
        if len(at):
            raw, sizes = _utf8_bytes(-1 - ids[at])
            repeats = np.ones(len(ids), np.int64)
            repeats[at] = sizes
            count = np.bincount(np.repeat(np.arange(words), count), repeats, words).astype(np.int64)
            unknown = np.repeat(ids < 0, repeats)
            ids = np.repeat(ids, repeats)
            ids[unknown] = self.byte[np.frombuffer(raw, np.uint8)]
        return ids, count

    def encode_chunk(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token ids, number of tokens of each text, whether they decode to it) of texts given by their bytes and bounds."""
        sizes = np.diff(starts)
        full = sizes > 0
        text = np.full(len(data) + int(full.sum()), 32, np.uint8)  # each text after the space that the model puts in front
        begin = starts[:-1] + np.cumsum(full) - full
        own = np.ones(len(text), bool)
        own[begin[full]] = False
        text[own] = data
        space, line = text == 32, text == 10
        cut = line.copy()
        cut[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        cut[begin[full]] = True
        word_start = np.flatnonzero(cut)
        doc = np.searchsorted(begin[full], word_start, "right") - 1
        doc = np.flatnonzero(full)[doc]
        words = np.bincount(doc, minlength=len(sizes))
        code = np.frombuffer(text.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.flatnonzero((text & 0xC0) != 0x80)
        ends = np.append(word_start[1:], len(text))
        lengths = np.searchsorted(letters, ends) - np.searchsorted(letters, word_start) if len(letters) < len(text) else ends - word_start
        key = mix(keys.astype(np.int64).view(np.uint64) + self.seed)
        occurrence = mix(_span(words).astype(np.uint64) + key[doc])
        ids, count = self.segment(code, lengths, occurrence)
        tokens = np.bincount(doc, count, len(sizes)).astype(np.int64)
        return ids, tokens, self._same(ids, tokens, text, np.append(begin, len(text)))

    def _same(self, ids: np.ndarray, tokens: np.ndarray, text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether the surfaces of each text's ids are the text after its space."""
        sizes = self.surface_size[ids]
        out = self.surface_bytes[np.repeat(self.surface_start[ids], sizes) + _span(sizes)]
        ends = np.cumsum(np.bincount(np.repeat(np.arange(len(tokens)), tokens), sizes, len(tokens)).astype(np.int64))
        same = ends == bounds[1:]
        if not same.all():
            return np.array([np.array_equal(out[a:b], text[c:d]) for a, b, c, d in zip(np.r_[0, ends[:-1]], ends, bounds[:-1], bounds[1:])])
        same[np.searchsorted(bounds, np.flatnonzero(out != text), "right") - 1] = False
        return same

    def encode_column(self, keys: np.ndarray, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(from row, to row, ids, tokens, same) of a text column, a chunk of whole rows at a time."""
        column = plain_texts(column)
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + CHUNK_BYTES, "right")) - 1)
            yield lo, hi, *self.encode_chunk(keys[lo:hi], raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
            lo = hi

    def encode(self, keys: list[int], texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text; ``keys`` (document ids) are part of what chooses the skipped merges."""
        out: list[np.ndarray] = []
        for _, _, ids, tokens, _ in self.encode_column(np.array(keys, np.int64), pa.array(texts, pa.large_string())):
            out += np.split(ids, np.cumsum(tokens)[:-1])
        return out

    def decode(self, ids) -> str:
        """The text of token ids."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str, dropout: float, seed: int) -> Codec:
    return Codec(path, dropout, seed)


def encode_documents(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 17) -> DataFrame:
    """(doc_id, ids, n_tokens, n_chars, lossless) of each row of ``docs`` (doc_id, text).

    ``lossless`` says that decoding ``ids`` gave the text back. Null and empty
    texts have no ids. A null id counts as 0 for the choice of skips; repeated
    rows of one id get the same ids. No shuffle: a row's ids depend on it alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path, dropout, seed)
        for batch in batches:
            keys = batch.column(0).fill_null(0).to_numpy()
            for lo, hi, ids, tokens, same in c.encode_column(keys, batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(tokens)].astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists, pa.array(tokens), batch.column(2).slice(lo, hi - lo), pa.array(same)], ["doc_id", "ids", "n_tokens", "n_chars", "lossless"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    return plain.mapInArrow(thrifty(run), "doc_id long, ids array<int>, n_tokens long, n_chars long, lossless boolean")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path, 0.0, 0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(thrifty(run), "doc_id long, text string")


def op1_piece_codec(spark, sf_dir: str) -> DataFrame:
    """All documents, dropout 0.1."""
    import public_tokenizers

    return encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
