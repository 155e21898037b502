"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from .bpe import op1_bpe
from .chat import op5_chat
from .embdedup import OP9_SQL, op9_embedding_dedup
from .jaccard import OP3_SQL, op3_jaccard
from .langid import op7_language_id, op7_page_language_id
from .linededup import OP10_SQL, op10_line_dedup
from .packing import op2_packing
from .suffixdedup import op6_suffix_dedup
from .topk import OP4_SQL, op4_topk
from .toxicity import op8_toxicity

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_packing": op2_packing,
    "op3_jaccard": op3_jaccard,
    "op4_topk": op4_topk,
    "op5_chat": op5_chat,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_language_id": op7_language_id,
    "op7_page_language_id": op7_page_language_id,
    "op8_toxicity": op8_toxicity,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL = {
    "op3_jaccard": OP3_SQL,
    "op4_topk": OP4_SQL,
    "op9_embedding_dedup": OP9_SQL,
    "op10_line_dedup": OP10_SQL,
}
