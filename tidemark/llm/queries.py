"""The registered queries of this subpackage, and their SQL where SQL can state them."""

from tidemark.llm import (
    decontam, html, jaccard, linededup, packing, pieces, pii, quality, repair, runs, secrets, substrings, toxicity,
)
from tidemark.llm.common import read

QUERIES = {
    "op1_substring_dedup": substrings.query,
    "op2_pii": pii.query,
    "op3_jaccard_join": jaccard.query,
    "op4_html_text": html.query,
    "op5_toxicity": toxicity.query,
    "op6_quality_rules": lambda spark, folder: quality.digest(read(spark, folder, "documents")),
    "op7_line_dedup": linededup.query,
    "op8_secret_scans": secrets.query,
    "op9_decontamination": decontam.query,
    "op10_sentencepiece": pieces.query,
    "op11_conversation_repair": repair.query,
    "op12_periodic_runs": runs.query,
    "op13_best_fit_packing": packing.query,
}
ORACLES = {
    "op3_jaccard_join": jaccard.SQL,
    "op6_quality_rules": quality.SQL,
    "op9_decontamination": decontam.SQL,
    "op11_conversation_repair": repair.SQL,
}
