"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op1_bpe_codec import op1_bpe_codec
from . import op4_exact_dedup as op4
from .op2_lm_scoring import op2_lm_scoring
from .op3_html_extraction import op3_html_extraction
from .op4_exact_dedup import op4_exact_dedup
from .op5_bestfit_packing import op5_bestfit_packing
from .op6_toxicity import op6_toxicity
from .op7_license_scan import op7_license_scan
from .op8_token_counts import op8_token_counts
from .op9_merkle_fingerprints import op9_merkle_fingerprints
from .op10_jaccard_join import op10_jaccard_join

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_html_extraction": op3_html_extraction,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_bestfit_packing": op5_bestfit_packing,
    "op6_toxicity": op6_toxicity,
    "op7_license_scan": op7_license_scan,
    "op8_token_counts": op8_token_counts,
    "op9_merkle_fingerprints": op9_merkle_fingerprints,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLES: dict[str, str] = {
    "op4_exact_dedup": op4.ORACLE,
}
