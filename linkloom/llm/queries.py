"""The queries of this subpackage, by name, and their SQL where it can express them."""

from __future__ import annotations

from .exact import OP12_SQL, op12_extendible_exact_dedup
from .language import op4_marginal_unigram_language
from .negatives import OP13_SQL, op13_four_russians_negatives
from .passages import op9_chained_passages
from .pieces import op7_sampled_pieces
from .pii import op3_weak_supervision_pii
from .prefix_trie import OP11_SQL, op11_zfast_prefix_trie
from .quality import op2_quality_discriminant
from .quality_rules import OP1_SQL, op1_adaptive_quality_rules
from .records import op5_token_records
from .simhash import op10_simhash_near_dedup
from .toxicity import op6_toxicity_chain
from .winnowing import OP8_SQL, op8_winnowing_decontamination

QUERIES = {f.__name__: f for f in (op1_adaptive_quality_rules, op2_quality_discriminant, op3_weak_supervision_pii, op4_marginal_unigram_language, op5_token_records, op6_toxicity_chain, op7_sampled_pieces, op8_winnowing_decontamination, op9_chained_passages, op10_simhash_near_dedup, op11_zfast_prefix_trie, op12_extendible_exact_dedup, op13_four_russians_negatives)}
ORACLES: dict[str, str] = {"op1_adaptive_quality_rules": OP1_SQL, "op8_winnowing_decontamination": OP8_SQL, "op11_zfast_prefix_trie": OP11_SQL, "op12_extendible_exact_dedup": OP12_SQL, "op13_four_russians_negatives": OP13_SQL}
