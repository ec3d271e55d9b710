"""Operators for preparing training data."""

from __future__ import annotations

from .chat import op3_chat_formatting
from .decontam import op4_benchmark_decontamination
from .license_scan import op12_license_scan
from .line_dedup import OP5_SQL, op5_line_dedup
from .mixing import OP2_SQL, op2_source_mixing
from .ngram_join import op6_ngram_jaccard_join
from .pii import op8_pii
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .quality import op10_quality_classifier
from .structure_repair import OP11_SQL, op11_structure_repair
from .topk_search import OP7_SQL, op7_exact_topk_search
from .toxicity import op9_toxicity
from .url_filter import op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_source_mixing": op2_source_mixing,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_line_dedup": op5_line_dedup,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_exact_topk_search": op7_exact_topk_search,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_structure_repair": op11_structure_repair,
    "op12_license_scan": op12_license_scan,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES = {
    "op2_source_mixing": OP2_SQL,
    "op5_line_dedup": OP5_SQL,
    "op7_exact_topk_search": OP7_SQL,
    "op11_structure_repair": OP11_SQL,
    "op13_prefix_trie": OP13_SQL,
}
