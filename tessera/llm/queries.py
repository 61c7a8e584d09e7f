"""Queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat import op1_chat_repair
from .hilbert import op6_hilbert_shards
from .jaccard import OP9_SQL, op9_jaccard_join
from .mixing import OP2_SQL, op2_mix_sources
from .outliers import op4_robust_outliers
from .packing import op3_pack_documents
from .phrases import OP11_SQL, op11_phrase_mining
from .pii import op7_find_pii
from .qda import op8_quality_classifier
from .sketches import OP12_SQL, op12_sketch_dedup
from .spelling import OP13_SQL, op13_spelling_variants
from .tokencount import op10_count_tokens
from .topk import OP5_SQL, op5_topk_search

QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_repair,
        op2_mix_sources,
        op3_pack_documents,
        op4_robust_outliers,
        op5_topk_search,
        op6_hilbert_shards,
        op7_find_pii,
        op8_quality_classifier,
        op9_jaccard_join,
        op10_count_tokens,
        op11_phrase_mining,
        op12_sketch_dedup,
        op13_spelling_variants,
    )
}
ORACLE_SQL = {"op2_mix_sources": OP2_SQL, "op5_topk_search": OP5_SQL, "op9_jaccard_join": OP9_SQL, "op11_phrase_mining": OP11_SQL, "op12_sketch_dedup": OP12_SQL, "op13_spelling_variants": OP13_SQL}
