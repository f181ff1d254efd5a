"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from crucible.llm.ann import op9_pruned_graph
from crucible.llm.bpe import op10_two_tier_bpe
from crucible.llm.edit_counts import op2_edit_counts
from crucible.llm.exact_dedup import OP5_SQL, op5_content_sort_dedup
from crucible.llm.hmm import op3_hidden_markov
from crucible.llm.jaccard_join import OP11_SQL, op11_rare_first_jaccard
from crucible.llm.mixing import op1_splitting_tree_mix
from crucible.llm.sharding import op4_virtual_slots
from crucible.llm.simhash import op8_anchor_simhash
from crucible.llm.spelling import op12_spelling_variants
from crucible.llm.suffix_dedup import OP7_SQL, op7_difference_cover
from crucible.llm.toxicity import op6_classifier_chain

QUERIES = {
    "op1_splitting_tree_mix": op1_splitting_tree_mix,
    "op10_two_tier_bpe": op10_two_tier_bpe,
    "op2_edit_counts": op2_edit_counts,
    "op3_hidden_markov": op3_hidden_markov,
    "op4_virtual_slots": op4_virtual_slots,
    "op6_classifier_chain": op6_classifier_chain,
    "op7_difference_cover": op7_difference_cover,
    "op9_pruned_graph": op9_pruned_graph,
    "op8_anchor_simhash": op8_anchor_simhash,
    "op5_content_sort_dedup": op5_content_sort_dedup,
    "op11_rare_first_jaccard": op11_rare_first_jaccard,
    "op12_spelling_variants": op12_spelling_variants,
}

ORACLE_SQL = {
    "op5_content_sort_dedup": OP5_SQL,
    "op7_difference_cover": OP7_SQL,
    "op11_rare_first_jaccard": OP11_SQL,
}
