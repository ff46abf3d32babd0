"""Registered queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from .centroids import ORACLE_OP11, op11_centroids
from .decontaminate import ORACLE_OP1, op1_decontamination
from .embedding_dedup import op9_embedding_dedup
from .html_wrappers import op8_html_extraction
from .minhash import op6_near_duplicates
from .packing import op5_packing
from .quality import op7_quality
from .secrets import ORACLE_OP3, op3_secret_scans
from .syncmers import op12_fingerprints
from .token_counts import op4_token_counts
from .token_output import op2_token_output
from .toxicity import op10_toxicity
from .whitening import op13_whitening

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_token_output": op2_token_output,
    "op3_secret_scans": op3_secret_scans,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_quality": op7_quality,
    "op8_html_extraction": op8_html_extraction,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_centroids": op11_centroids,
    "op12_fingerprints": op12_fingerprints,
    "op13_whitening": op13_whitening,
}
#: Tokenizers, trained models and page wrappers are beyond SQL: those queries have brute-force tests.
ORACLE = {"op1_decontamination": ORACLE_OP1, "op3_secret_scans": ORACLE_OP3, "op11_centroids": ORACLE_OP11}
