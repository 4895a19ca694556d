"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import decontamination, exact_dedup, filter_audit, fingerprints, line_dedup, ngram_join, packing, personal_data, quality, secret_scan, sharding, substring_dedup, vector_codes
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_secret_scan": secret_scan.query,
    "op2_fingerprints": fingerprints.query,
    "op3_personal_data": personal_data.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_sharding": sharding.query,
    "op6_quality_classifier": quality.query,
    "op7_ngram_join": ngram_join.query,
    "op8_decontamination": decontamination.query,
    "op9_line_dedup": line_dedup.query,
    "op10_packing": packing.query,
    "op11_exact_dedup": exact_dedup.query,
    "op12_filter_audit": filter_audit.query,
    "op13_vector_codes": vector_codes.query,
}
