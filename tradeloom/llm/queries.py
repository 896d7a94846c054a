"""Registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from tradeloom.llm.chat import OP7_SQL, op7_chat
from tradeloom.llm.decontaminate import OP8_SQL, op8_decontamination
from tradeloom.llm.divergence import OP11_SQL, op11_divergence
from tradeloom.llm.language import op3_language
from tradeloom.llm.main_text import op13_main_text
from tradeloom.llm.packing import op4_packing
from tradeloom.llm.quality import op2_quality
from tradeloom.llm.repeats import OP10_SQL, op10_substring
from tradeloom.llm.rules import OP5_SQL, op5_rules
from tradeloom.llm.simhash import op6_simhash
from tradeloom.llm.token_file import op9_token_file
from tradeloom.llm.toxicity import op1_toxicity
from tradeloom.llm.variants import OP12_SQL, op12_variants

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_language": op3_language,
    "op4_packing": op4_packing,
    "op5_rules": op5_rules,
    "op6_simhash": op6_simhash,
    "op7_chat": op7_chat,
    "op8_decontamination": op8_decontamination,
    "op9_token_file": op9_token_file,
    "op10_substring": op10_substring,
    "op11_divergence": op11_divergence,
    "op12_variants": op12_variants,
    "op13_main_text": op13_main_text,
}
ORACLE: dict[str, str] = {"op5_rules": OP5_SQL, "op7_chat": OP7_SQL, "op8_decontamination": OP8_SQL, "op10_substring": OP10_SQL, "op11_divergence": OP11_SQL, "op12_variants": OP12_SQL}
