from __future__ import annotations

import base64
import random
import time

import public_tokenizers
import pytest
import sentencepiece

from tallyline.llm import piece_codec as C
from tallyline.llm.pieces import pretokens
from tallyline.llm.token_counts import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a", "a  b", "\n", "\n\n x", "a \n b", "<s> </s> <unk> <0x0A>", "日本 🙂 é\x00 z", "  \n  ", "a\t\tb \r\n c", "x" * 3000, "trail ", "é" * 50, "▁", "a▁b ▁▁c"]


def test_counts_equal_the_library(spark, corpus):
    texts = ODD + [t for _, t in corpus]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=PATH).encode([t or "" for t in texts])]
    got = {r.doc_id: r for r in token_counts(df, PATH, limit=3).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert [got[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert all(r.over_limit == (r.n_tokens > 3) for r in got.values())


def test_memory_of_counts_is_bounded(monkeypatch):
    """Long words aren't kept, and short ones up to a number of bytes; counts stay right."""
    from tallyline.llm import token_counts as T

    proven = T.prove(PATH)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    monkeypatch.setattr(T, "REMEMBERED_BYTES", 20_000)
    table = T._tables[proven.path] = T._Counts(proven)
    rng = random.Random(3)
    try:
        for size in (5, 30, 63, 64, 65, 5000):
            text = " ".join(base64.b64encode(rng.randbytes(size)).decode() for _ in range(100))
            assert T.count_tokens(text, proven) == len(library.encode(text))
            assert len(table) - len(proven.whole) < 20_000 / T._ENTRY + 2 and max(map(len, table)) <= 65
    finally:
        del T._tables[proven.path]


def test_counts_of_nothing(spark, nothing):
    assert token_counts(nothing, PATH).count() == 0


def test_no_dropout_equals_the_library(corpus):
    texts = [t for t in ODD if t and "▁" not in t] + [t for _, t in corpus if t]
    got = C.Codec(PATH, 0.0, 1).encode(list(range(len(texts))), texts)
    assert [x.tolist() for x in got] == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(texts)


def test_dropout_is_lossless_seeded_and_varied(spark, docs, corpus):
    first = {r.doc_id: r for r in C.encode_documents(docs, PATH, 0.2, seed=1).collect()}
    again = {r.doc_id: r.ids for r in C.encode_documents(docs.repartition(3), PATH, 0.2, seed=1).collect()}
    other = {r.doc_id: r.ids for r in C.encode_documents(docs, PATH, 0.2, seed=2).collect()}
    assert all(r.lossless for r in first.values())
    assert {k: r.ids for k, r in first.items()} == again != other
    assert {r.doc_id: r.text for r in C.decode_documents(C.encode_documents(docs, PATH, 0.2, seed=1), PATH).collect()} == {i: t or "" for i, t in corpus}
    codec = C.Codec(PATH, 0.3, 5)
    assert len({tuple(x) for x in (codec.encode([k], ["international"])[0].tolist() for k in range(40))}) > 1
    odd = [t for t in ODD if t]
    assert [codec.decode(x.tolist()) for x in codec.encode(list(range(len(odd))), odd)] == odd


def by_hand(codec, key, text):
    """Token ids by a plain loop: the best-scored, then leftmost join that the keyed hash lets through, one at a time."""
    model, out = codec.model, []
    doc = C._mixed((key & C._WORD) + int(codec.seed[0]))
    for at, word in enumerate(w for w in pretokens(text.replace("▁", "\ud800")) if w):
        occurrence = C._mixed(at + doc)
        parts = [(c, i) for i, c in enumerate(word)]
        while True:
            open_ = []
            for n, ((a, place), (b, _)) in enumerate(zip(parts, parts[1:])):
                piece = model.id.get(a + b)
                if piece is not None and a in model.id and b in model.id and C._mixed(piece + (place << 20) + occurrence) >> 32 >= codec.limit:
                    open_.append((-model.score[piece], n))
            if not open_:
                break
            n = min(open_)[1]
            parts[n : n + 2] = [(parts[n][0] + parts[n + 1][0], parts[n][1])]
        for p, _ in parts:
            out += [model.id[p]] if p in model.id else [model.byte[x] for x in p.replace("\ud800", "▁").encode()]
    return out


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5])
def test_rounds_and_heap_equal_a_plain_loop(corpus, dropout, monkeypatch):
    texts = [t for t in ODD if t] + ["international " * 20, "x" * 200 + " é▁日本 interna", "antidisestablishmentarianism" * 9] + [t for _, t in corpus[::9] if t]
    codec = C.Codec(PATH, dropout, 5)
    keys = [7 * i - 3 for i in range(len(texts))]
    want = [by_hand(codec, k, t) for k, t in zip(keys, texts)]
    assert [x.tolist() for x in codec.encode(keys, texts)] == want
    monkeypatch.setattr(C, "CHUNK_BYTES", 50)
    assert [x.tolist() for x in codec.encode(keys, texts)] == want


def test_each_occurrence_is_cut_on_its_own():
    """A frequent word gets more than a handful of cuts."""
    codec = C.Codec(PATH, 0.2, 5)
    got = codec.encode([1], [" international" * 300])[0].tolist()
    assert len(set(" ".join(codec.model.text[i] for i in got).split("▁"))) > 20


def test_a_run_of_a_million_letters(spark):
    text = base64.b64encode(random.Random(1).randbytes(750_000)).decode()
    docs = spark.createDataFrame([(1, text), (2, "x" * 1_000_000)], "doc_id long, text string")
    began = time.monotonic()
    assert [r.lossless for r in C.encode_documents(docs, PATH).select("lossless").collect()] == [True, True]
    assert time.monotonic() - began < 60


def test_full_dropout_leaves_characters():
    got = C.Codec(PATH, 1.0, 0).encode([0], ["abc"])[0]
    assert len(got) == 4
