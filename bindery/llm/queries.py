"""The registered queries of the corpus operators, and SQL where it can express one."""

from __future__ import annotations

from . import quality_rules, substring_dedup
from .decontaminate import op1_decontaminate
from .language_id import op9_language_id
from .packing import op8_packing
from .quality_model import op6_quality_model
from .quality_rules import op2_quality_rules
from .simhash import op4_simhash
from .substring_dedup import op7_substring_dedup
from .token_counts import op5_token_counts
from .token_store import op3_token_store
from .toxicity import op10_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_quality_rules,
        op3_token_store,
        op4_simhash,
        op5_token_counts,
        op6_quality_model,
        op7_substring_dedup,
        op8_packing,
        op9_language_id,
        op10_toxicity,
    )
}

#: The other methods work on token ids, hashes, alignments or trained models, which SQL can't
#: express; tests/llm holds them against brute force, round trips and held-out rows.
ORACLE_SQL: dict[str, str] = {"op2_quality_rules": quality_rules.oracle_sql(), "op7_substring_dedup": substring_dedup.oracle_sql()}
