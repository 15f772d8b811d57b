"""The registered queries of the operators and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
from trailspark.llm import (
    bestfit, chat, classifier, collocations, decontaminate, licenses, linededup, merkle, pii, repair, rules, simhash, urltree,
)

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_pii_pseudonyms": pii.op3_pii_pseudonyms,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_quality_classifier": classifier.op6_quality_classifier,
    "op7_license_scans": licenses.op7_license_scans,
    "op8_best_fit_packing": bestfit.op8_best_fit_packing,
    "op9_document_fingerprints": merkle.op9_document_fingerprints,
    "op10_url_filters": urltree.op10_url_filters,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_phrase_collocations": collocations.op12_phrase_collocations,
    "op13_quality_rules": rules.op13_quality_rules,
    "pipeline": corpus_pipeline.run,
}
#: The others hold a permutation by key, a fitted model, graph components, alignments, 64-bit
#: hashes or a search that depends on its own results: tests/llm compares them with brute force.
ORACLES = {
    "op5_chat_formatting": chat.OP5_SQL, "op12_phrase_collocations": collocations.OP12_SQL,
    "op13_quality_rules": rules.OP13_SQL,
}
