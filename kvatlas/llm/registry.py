"""The queries of the llm operators, and SQL for those that SQL can express."""

from __future__ import annotations

from kvatlas.llm.chat import op10_chat
from kvatlas.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from kvatlas.llm.fim import OP11_SQL, op11_infill
from kvatlas.llm.langid import op3_langid
from kvatlas.llm.media import op1_media
from kvatlas.llm.mixing import OP4_SQL, op4_mixing
from kvatlas.llm.ngram_jaccard import op6_ngram_jaccard
from kvatlas.llm.packing import op5_packing
from kvatlas.llm.pii import op7_pii
from kvatlas.llm.quality import op13_quality
from kvatlas.llm.tokens import op2_tokens
from kvatlas.llm.toxicity import op8_toxicity
from kvatlas.llm.trie import OP12_SQL, op12_trie

QUERIES = {
    "op1_media": op1_media,
    "op2_tokens": op2_tokens,
    "op3_langid": op3_langid,
    "op4_mixing": op4_mixing,
    "op5_packing": op5_packing,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_chat": op10_chat,
    "op11_infill": op11_infill,
    "op12_trie": op12_trie,
    "op13_quality": op13_quality,
}
ORACLE_SQL = {
    "op4_mixing": OP4_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_infill": OP11_SQL,
    "op12_trie": OP12_SQL,
}
