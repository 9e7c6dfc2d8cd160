"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from .decontaminate import op9_pigeonhole_edit_matching
from .divergence import OP12_SQL, op12_source_divergence
from .jaccard import OP5_SQL, op5_chosen_path_join
from .lines import OP3_SQL, op3_line_chunks
from .packing import op2_best_fit_packing
from .passages import op10_paragraph_banding
from .quality import op8_co_training_quality
from .resample import OP11_SQL, op11_importance_resampling
from .suffixes import OP13_SQL, op13_suffix_merge_sort
from .topk import OP6_SQL, op6_exact_top_k
from .toxicity import op4_kneser_ney_toxicity
from .warc import OP1_SQL, op1_warc_boundary_chains
from .wavelet import op7_wavelet_matrix

QUERIES = {
    "op1_warc_boundary_chains": op1_warc_boundary_chains,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_line_chunks": op3_line_chunks,
    "op4_kneser_ney_toxicity": op4_kneser_ney_toxicity,
    "op5_chosen_path_join": op5_chosen_path_join,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_wavelet_matrix": op7_wavelet_matrix,
    "op8_co_training_quality": op8_co_training_quality,
    "op9_pigeonhole_edit_matching": op9_pigeonhole_edit_matching,
    "op10_paragraph_banding": op10_paragraph_banding,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_source_divergence": op12_source_divergence,
    "op13_suffix_merge_sort": op13_suffix_merge_sort,
}
ORACLES = {
    "op1_warc_boundary_chains": OP1_SQL,
    "op3_line_chunks": OP3_SQL,
    "op5_chosen_path_join": OP5_SQL,
    "op6_exact_top_k": OP6_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
    "op13_suffix_merge_sort": OP13_SQL,
}
