"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from tidechart.llm.bpe import op11_bpe
from tidechart.llm.decontamination import op4_decontamination
from tidechart.llm.fill_in_middle import op13_fill_in_middle
from tidechart.llm.html_extraction import op2_html_extraction
from tidechart.llm.importance import op12_importance
from tidechart.llm.jaccard_join import op3_jaccard_join
from tidechart.llm.language_model import op5_lm_scores
from tidechart.llm.mixing import op6_mixing
from tidechart.llm.nearest import op8_nearest
from tidechart.llm.oracles import ORACLES as ORACLES
from tidechart.llm.secret_scans import op10_secret_scans
from tidechart.llm.sharding import op7_sharding
from tidechart.llm.substring_dedup import op1_substring_dedup
from tidechart.llm.toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_html_extraction, op3_jaccard_join, op4_decontamination, op5_lm_scores, op6_mixing, op7_sharding, op8_nearest, op9_toxicity, op10_secret_scans, op11_bpe, op12_importance, op13_fill_in_middle)}
