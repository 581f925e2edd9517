"""Registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from vecweave.llm.collisions import op11_collisions
from vecweave.llm.html_text import op9_html_text
from vecweave.llm.importance import IMPORTANCE_SQL, op12_importance
from vecweave.llm.language import op8_language_id
from vecweave.llm.line_dedup import LINE_DEDUP_SQL, op10_line_dedup
from vecweave.llm.mixing import MIXING_SQL, op7_mixing
from vecweave.llm.neighbours import op4_near_vectors
from vecweave.llm.packing import op6_packing
from vecweave.llm.quality import op1_quality_rules
from vecweave.llm.separators import op5_token_counts
from vecweave.llm.simhash import op2_simhash
from vecweave.llm.token_files import op3_token_files
from vecweave.llm.vector_codes import CODES_SQL, op13_vector_codes

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op3_token_files": op3_token_files,
    "op4_near_vectors": op4_near_vectors,
    "op5_token_counts": op5_token_counts,
    "op2_simhash": op2_simhash,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_language_id": op8_language_id,
    "op9_html_text": op9_html_text,
    "op10_line_dedup": op10_line_dedup,
    "op11_collisions": op11_collisions,
    "op12_importance": op12_importance,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES: dict[str, str] = {"op7_mixing": MIXING_SQL, "op10_line_dedup": LINE_DEDUP_SQL, "op12_importance": IMPORTANCE_SQL, "op13_vector_codes": CODES_SQL}
