"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from . import chat_format, decontaminate, fingerprints, jaccard_join, language_id, lm_scoring, mixing, quality, secret_scan, token_output
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_quality": quality.op1,
    "op2_fingerprints": fingerprints.op2,
    "op3_decontaminate": decontaminate.op3,
    "op4_mixing": mixing.op4,
    "op5_jaccard_join": jaccard_join.op5,
    "op6_secret_scan": secret_scan.op6,
    "op7_lm_scoring": lm_scoring.op7,
    "op8_token_output": token_output.op8,
    "op9_language_id": language_id.op9,
    "op10_chat_format": chat_format.op10,
}
