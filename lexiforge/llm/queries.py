"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from lexiforge.llm.bpe_codec import op7_bpe_codec
from lexiforge.llm.fill_in_middle import op11_fill_in_middle
from lexiforge.llm.importance import op12_importance_resampling
from lexiforge.llm.media import op10_media_columns
from lexiforge.llm.mixing import op4_source_mixing
from lexiforge.llm.near_dedup import op3_near_dedup
from lexiforge.llm.oracle import oracle_sql  # noqa: F401  part of this module's face
from lexiforge.llm.packing import op13_best_fit_packing
from lexiforge.llm.pii import op5_personal_data
from lexiforge.llm.quality_rules import op2_quality_rules
from lexiforge.llm.resharding import op6_resharding
from lexiforge.llm.substring_dedup import op1_substring_dedup
from lexiforge.llm.token_counts import op9_token_counts
from lexiforge.llm.toxicity import op8_toxicity


def queries() -> dict:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_quality_rules": op2_quality_rules,
        "op3_near_dedup": op3_near_dedup,
        "op4_source_mixing": op4_source_mixing,
        "op5_personal_data": op5_personal_data,
        "op6_resharding": op6_resharding,
        "op7_bpe_codec": op7_bpe_codec,
        "op8_toxicity": op8_toxicity,
        "op9_token_counts": op9_token_counts,
        "op10_media_columns": op10_media_columns,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_best_fit_packing": op13_best_fit_packing,
    }
