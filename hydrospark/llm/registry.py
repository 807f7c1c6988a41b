"""The corpus queries by name, with their SQL equivalents."""

from __future__ import annotations

from hydrospark.llm.context_mixing import op12_context_mixing
from hydrospark.llm.decontamination import OP10_SQL, op10_decontamination
from hydrospark.llm.kdtree_clusters import OP11_SQL, op11_kdtree_clusters
from hydrospark.llm.language_id import op4_language_id
from hydrospark.llm.licenses import op3_license_scan
from hydrospark.llm.line_dedup import op7_line_dedup
from hydrospark.llm.packing import op2_best_fit_packing
from hydrospark.llm.quality_rules import op8_quality_rules
from hydrospark.llm.resampling import OP13_SQL, op13_importance_resampling
from hydrospark.llm.secrets import OP1_SQL, op1_secret_scan
from hydrospark.llm.sharding import OP5_SQL, op5_sharding
from hydrospark.llm.simhash_dedup import op9_simhash_dedup
from hydrospark.llm.token_files import op6_token_files

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_license_scan": op3_license_scan,
    "op4_language_id": op4_language_id,
    "op5_sharding": op5_sharding,
    "op6_token_files": op6_token_files,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_kdtree_clusters": op11_kdtree_clusters,
    "op12_context_mixing": op12_context_mixing,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLES = {"op1_secret_scan": OP1_SQL, "op5_sharding": OP5_SQL, "op10_decontamination": OP10_SQL, "op11_kdtree_clusters": OP11_SQL, "op13_importance_resampling": OP13_SQL}
