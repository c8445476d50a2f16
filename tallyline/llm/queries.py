"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tallyline.llm.chat_format import OP4_SQL, op4_chat_format
from tallyline.llm.decontaminate import op3_template_decontamination
from tallyline.llm.embedding_dedup import op12_embedding_dedup
from tallyline.llm.exact_topk import OP6_SQL, op6_exact_topk
from tallyline.llm.jaccard_join import op10_ngram_jaccard_join
from tallyline.llm.lexical_rank import OP11_SQL, op11_lexical_rank
from tallyline.llm.main_text import op9_main_text
from tallyline.llm.piece_codec import op1_piece_codec
from tallyline.llm.token_counts import op2_token_counts
from tallyline.llm.pii import op7_pii_weak_supervision
from tallyline.llm.repeats import op13_word_runs
from tallyline.llm.toxicity import op8_toxicity_grammar
from tallyline.llm.url_rules import OP5_SQL, op5_url_rules

_QUERIES = [op1_piece_codec, op2_token_counts, op3_template_decontamination, op4_chat_format, op5_url_rules, op6_exact_topk, op7_pii_weak_supervision, op8_toxicity_grammar, op9_main_text, op10_ngram_jaccard_join, op11_lexical_rank, op12_embedding_dedup, op13_word_runs]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": OP4_SQL, "op5_url_rules": OP5_SQL, "op6_exact_topk": OP6_SQL, "op11_lexical_rank": OP11_SQL}
