"""What the vocabulary of a SentencePiece BPE model proves about its texts.

Two facts let a text be cut into pre-tokens whose tokens are independent:

* no piece has a space mark after another character, so no merge crosses the
  place before a run of marks;
* no piece has a line feed, so it never merges.

``Pieces`` checks both on the vocabulary given and refuses a model without them.
"""

from __future__ import annotations

import re
from functools import cached_property, lru_cache

import numpy as np

MARK = "▁"
_CUT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class Pieces:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        if spec.trainer_spec.model_type != 2 or spec.normalizer_spec.name != "identity" or not spec.normalizer_spec.add_dummy_prefix or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("needs a BPE model that normalises nothing and puts a space mark in front")
        self.kind = np.array([p.type for p in spec.pieces])
        self.text = [p.piece for p in spec.pieces]
        self.id = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 1}
        self.score = np.array([p.score for p in spec.pieces])
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.id):
            raise ValueError("a piece crosses a space mark or a line feed: texts can't be cut there")
        if any(p.type in (4, 5) for p in spec.pieces):
            raise ValueError("user-defined and unused pieces are not handled")
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == 6}
        self.path = path

    @cached_property
    def plain(self):
        """The library's encoder of pre-tokens, which bring their own mark; loaded where it is used."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(self.path, "rb") as f:
            spec.ParseFromString(f.read())
        spec.normalizer_spec.add_dummy_prefix = False
        return sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())

    @lru_cache(maxsize=1)
    def whole(self) -> frozenset[str]:
        """The pieces that, as a text of their own, encode to themselves alone: checked one by one."""
        names = list(self.id)
        return frozenset(p for p, got in zip(names, self.plain.encode(names, num_threads=1)) if got == [self.id[p]])


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    """One per process and model file."""
    return Pieces(path)


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text with its leading mark; empty strings between them mean nothing."""
    if not text:
        return []
    if text[0] == " " or "  " in text or MARK in text:
        return _CUT.findall(MARK + text.replace(" ", MARK))
    return (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")
