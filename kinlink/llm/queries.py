"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontamination, fingerprints, jaccard_join, language_model, licenses, packing, pii, quality, secrets
from .oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_lm_scoring": language_model.op3_lm_scoring,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_personal_data": pii.op5_personal_data,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_ngram_jaccard_join": jaccard_join.op7_ngram_jaccard_join,
    "op8_benchmark_decontamination": decontamination.op8_benchmark_decontamination,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_document_fingerprints": fingerprints.op10_document_fingerprints,
}
