"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import OP5_SQL, op5_chat_formatting
from .decontaminate import OP10_SQL, op10_benchmark_decontamination
from .html_text import op7_html_extraction
from .line_dedup import OP1_SQL, op1_line_dedup
from .materialise import op8_token_shards
from .near_dedup import OP2_SQL, op2_minhash_near_dedup
from .neighbours import op3_nearest_neighbours
from .packing import op6_packing
from .secrets import op4_secret_scans
from .toxicity import op9_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_secret_scans": op4_secret_scans,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_packing": op6_packing,
    "op7_html_extraction": op7_html_extraction,
    "op8_token_shards": op8_token_shards,
    "op9_toxicity": op9_toxicity,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}

ORACLE_SQL = {
    "op1_line_dedup": OP1_SQL,
    "op2_minhash_near_dedup": OP2_SQL,
    "op5_chat_formatting": OP5_SQL,
    "op10_benchmark_decontamination": OP10_SQL,
}
