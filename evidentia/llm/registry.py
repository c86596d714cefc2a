"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontam, langid, linededup, packing, quality, secrets, simhash, substrings, toxicity

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_decontamination": decontam.query,
    "op3_best_fit_packing": packing.query,
    "op4_simhash": simhash.query,
    "op5_line_dedup": linededup.query,
    "op6_toxicity": toxicity.query,
    "op7_chat_format": chat.query,
    "op8_language_id": langid.query,
    "op9_secret_scan": secrets.query,
    "op10_suffix_dedup": substrings.query,
}
SQL = {"op5_line_dedup": linededup.SQL, "op7_chat_format": chat.SQL}
