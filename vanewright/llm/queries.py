"""Queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from .ann import op2_adaptive_scan
from .licenses import op9_license_scan
from .lines import OP5_SQL, op5_line_site_spread
from .lm import op3_kneser_ney
from .mixing import OP7_SQL, op7_hierarchical_mix
from .neardup import op1_minhash_near_dedup
from .negatives import OP11_SQL, op11_norm_bucket_negatives
from .oracles import OP1_SQL, OP6_SQL
from .packing import op10_best_fit_packing
from .quality import op6_quality_divergence
from .secrets import op8_secret_scan
from .simhash import op12_simhash_multi_index
from .toxicity import op4_toxicity
from .trie import OP13_SQL, op13_prefix_trie

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_adaptive_scan": op2_adaptive_scan,
    "op3_kneser_ney": op3_kneser_ney,
    "op4_toxicity": op4_toxicity,
    "op5_line_site_spread": op5_line_site_spread,
    "op6_quality_divergence": op6_quality_divergence,
    "op7_hierarchical_mix": op7_hierarchical_mix,
    "op8_secret_scan": op8_secret_scan,
    "op9_license_scan": op9_license_scan,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_norm_bucket_negatives": op11_norm_bucket_negatives,
    "op12_simhash_multi_index": op12_simhash_multi_index,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": OP1_SQL,
    "op6_quality_divergence": OP6_SQL,
    "op5_line_site_spread": OP5_SQL,
    "op7_hierarchical_mix": OP7_SQL,
    "op11_norm_bucket_negatives": OP11_SQL,
    "op13_prefix_trie": OP13_SQL,
}
