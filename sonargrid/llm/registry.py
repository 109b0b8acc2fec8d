"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from .exact_dedup import OP4_SQL, op4_exact_dedup
from .html_extract import op10_html_extract
from .language_id import op6_language_id
from .media import op3_media_columns
from .mixing import OP1_SQL, op1_mix_sources
from .ngram_join import op5_ngram_jaccard
from .packing import op9_best_fit_packing
from .quotes import op2_quote_linking
from .suffix_dedup import op8_suffix_dedup
from .token_counts import op7_edit_token_counts

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_quote_linking": op2_quote_linking,
    "op3_media_columns": op3_media_columns,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_language_id": op6_language_id,
    "op7_edit_token_counts": op7_edit_token_counts,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_html_extract": op10_html_extract,
}

ORACLES = {
    "op1_mix_sources": OP1_SQL,
    "op4_exact_dedup": OP4_SQL,
}
