"""The queries of this package and their SQL."""

from __future__ import annotations

from cueframe.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from cueframe.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from cueframe.llm.html_text import op10_html_text
from cueframe.llm.jaccard_join import OP6_SQL, op6_jaccard_join
from cueframe.llm.license_scan import op7_license_scan
from cueframe.llm.packing import op9_best_fit_packing
from cueframe.llm.ppm import op3_ppm_scores
from cueframe.llm.resampling import OP13_SQL, op13_importance_resampling
from cueframe.llm.sentence_pieces import op12_sentence_pieces
from cueframe.llm.source_mix import OP1_SQL, op1_source_mix
from cueframe.llm.token_files import op5_token_files
from cueframe.llm.toxicity import op8_toxicity
from cueframe.llm.vector_dedup import OP2_SQL, op2_vector_dedup

QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_vector_dedup": op2_vector_dedup,
    "op3_ppm_scores": op3_ppm_scores,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_token_files": op5_token_files,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_license_scan": op7_license_scan,
    "op8_toxicity": op8_toxicity,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_html_text": op10_html_text,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_sentence_pieces": op12_sentence_pieces,
    "op13_importance_resampling": op13_importance_resampling,
}
SQL = {
    "op1_source_mix": OP1_SQL,
    "op2_vector_dedup": OP2_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op13_importance_resampling": OP13_SQL,
}
