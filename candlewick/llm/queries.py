"""Queries of the operators over the driver tables, and their SQL where SQL can express them."""

from __future__ import annotations

from candlewick.llm import hard_negatives
from candlewick.llm.adaptive_search import op11_nearest_neighbours
from candlewick.llm.conversation_repair import op13_conversation_repair
from candlewick.llm.decontamination import op1_decontamination
from candlewick.llm.hard_negatives import op12_hard_negatives
from candlewick.llm.html_extraction import op7_html_extraction
from candlewick.llm.jaccard_join import op9_jaccard_join
from candlewick.llm.language_id import op4_language_id
from candlewick.llm.lm_scoring import op8_lm_scoring
from candlewick.llm.packing import op2_packing
from candlewick.llm.quality_classifier import op3_quality_classifier
from candlewick.llm.quality_rules import op6_quality_rules
from candlewick.llm.suffix_dedup import op10_suffix_dedup
from candlewick.llm.token_files import op5_token_output

QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_packing,
        op3_quality_classifier,
        op4_language_id,
        op5_token_output,
        op6_quality_rules,
        op7_html_extraction,
        op8_lm_scoring,
        op9_jaccard_join,
        op10_suffix_dedup,
        op11_nearest_neighbours,
        op12_hard_negatives,
        op13_conversation_repair,
    )
}
ORACLES: dict[str, str] = {"op12_hard_negatives": hard_negatives.SQL}
