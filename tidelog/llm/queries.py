"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from .exact_dedup import OP6_SQL, op6_exact_dedup
from .language import op8_language
from .mixing import OP7_SQL, op7_mixing
from .near_dedup import op5_near_dedup
from .packing import op3_packing
from .pii import op1_pii
from .quality import op9_quality
from .secrets import op10_secrets
from .token_counts import op4_token_counts
from .topk import OP2_SQL, op2_topk

QUERIES = {
    "op1_pii": op1_pii,
    "op2_topk": op2_topk,
    "op3_packing": op3_packing,
    "op4_token_counts": op4_token_counts,
    "op5_near_dedup": op5_near_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_mixing": op7_mixing,
    "op8_language": op8_language,
    "op9_quality": op9_quality,
    "op10_secrets": op10_secrets,
}
ORACLE_SQL = {
    "op2_topk": OP2_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op7_mixing": OP7_SQL,
}
