"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ann, decontaminate, hilbert, html, language, minhash, packing, pii, quality, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_pack": packing.query,
    "op3_quality": quality.query,
    "op4_language": language.query,
    "op5_pii": pii.query,
    "op6_html": html.query,
    "op7_nearest": ann.query,
    "op8_near_duplicates": minhash.query,
    "op9_shard": hilbert.query,
    "op10_toxicity": toxicity.query,
}
SQL = {
    "op1_decontaminate": decontaminate.SQL,
    "op8_near_duplicates": minhash.SQL,
}
