"""The registered queries of the text operators and their oracle SQL."""

from __future__ import annotations

import corpus_pipeline
from lamella.llm.cotraining import op6_quality_cotraining
from lamella.llm.decontamination import op8_decontamination
from lamella.llm.hard_negatives import op13_hard_negatives
from lamella.llm.jaccard import op9_jaccard_join
from lamella.llm.languages import op4_language_mixture
from lamella.llm.licenses import op2_licenses
from lamella.llm.oracles import DECONTAMINATION, HARD_NEGATIVES, JACCARD, QUALITY_RULES
from lamella.llm.packing import op7_packing
from lamella.llm.periodic_runs import op12_periodic_runs
from lamella.llm.quality_rules import op5_quality_rules
from lamella.llm.credentials import op1_secrets
from lamella.llm.simhash import op11_simhash_components
from lamella.llm.token_counts import op10_token_counts
from lamella.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_licenses": op2_licenses,
    "op3_toxicity": op3_toxicity,
    "op4_language_mixture": op4_language_mixture,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_cotraining": op6_quality_cotraining,
    "op7_packing": op7_packing,
    "op8_decontamination": op8_decontamination,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_token_counts": op10_token_counts,
    "op11_simhash_components": op11_simhash_components,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}
#: The other operators learn a model, call a tokenizer or add findings of a program; tests
#: hold them against brute force, an exact round trip or held-out rows.
ORACLES: dict[str, str] = {
    "op5_quality_rules": QUALITY_RULES,
    "op8_decontamination": DECONTAMINATION,
    "op9_jaccard_join": JACCARD,
    "op13_hard_negatives": HARD_NEGATIVES,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
