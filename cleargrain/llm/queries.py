"""The registered query of each operator, and SQL for the same rows where SQL can express it."""

from __future__ import annotations

from .bpe import op10_byte_bpe
from .chat import OP2_SQL, op2_chat_perspectives
from .covertree import OP3_SQL, op3_exact_top_k
from .digest import op9_document_fingerprints
from .language import op4_language_id
from .merkle import OP12_SQL, op12_merkle_manifest
from .minhash import OP7_SQL, op7_minhash_near_dedup
from .mixing import op6_source_mixing
from .quality import op5_quality_classifier
from .repair import op11_conversation_repair
from .secrets import op13_secret_scan
from .suffix_index import OP1_SQL, op1_suffix_array_dedup
from .toxicity import op8_toxicity

QUERIES = {
    q.__name__: q
    for q in (
        op1_suffix_array_dedup,
        op2_chat_perspectives,
        op3_exact_top_k,
        op4_language_id,
        op5_quality_classifier,
        op6_source_mixing,
        op7_minhash_near_dedup,
        op8_toxicity,
        op9_document_fingerprints,
        op10_byte_bpe,
        op11_conversation_repair,
        op12_merkle_manifest,
        op13_secret_scan,
    )
}
ORACLES = {
    "op1_suffix_array_dedup": OP1_SQL,
    "op2_chat_perspectives": OP2_SQL,
    "op3_exact_top_k": OP3_SQL,
    "op7_minhash_near_dedup": OP7_SQL,
    "op12_merkle_manifest": OP12_SQL,
}
