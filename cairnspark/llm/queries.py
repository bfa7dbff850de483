"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontamination, hard_negatives, hnsw, html_mincut, jaccard, langid, quality, secret_crf, sentencepieces, suffix_dedup, token_orc, warc_zip
from .sql import ORACLE_SQL  # noqa: F401  what SQL can express

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_min_cut": html_mincut.query,
    "op2_warc_zip": warc_zip.query,
    "op3_ppm_language_id": langid.query,
    "op4_heavy_light_jaccard": jaccard.query,
    "op5_bucket_pointer_dedup": suffix_dedup.query,
    "op6_sentencepiece_backtracking": sentencepieces.query,
    "op7_positional_decontamination": decontamination.query,
    "op8_crf_secret_scan": secret_crf.query,
    "op9_sharded_hnsw": hnsw.query,
    "op10_orc_token_output": token_orc.query,
    "op11_shared_cut_alignment": alignment.query,
    "op12_likelihood_ratio_quality": quality.query,
    "op13_four_russians_negatives": hard_negatives.query,
}
