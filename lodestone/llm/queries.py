"""The queries of the training-data operators and, where SQL can say them, their SQL."""

from __future__ import annotations

from .class_lm import op4_lm_scores
from .decontaminate import op2_decontamination
from .fingerprints import op9_fingerprints
from .jaccard import op7_jaccard_join
from .language import op1_language_id
from .packing import op5_packing
from .phrases import op10_phrase_dedup
from .secrets import op8_secret_scan
from .substrings import op6_substring_dedup
from .sql import SQL
from .token_counts import op3_token_counts

QUERIES = {f.__name__: f for f in (op1_language_id, op2_decontamination, op3_token_counts, op4_lm_scores, op5_packing, op6_substring_dedup, op7_jaccard_join, op8_secret_scan, op9_fingerprints, op10_phrase_dedup)}

__all__ = ["QUERIES", "SQL"]
