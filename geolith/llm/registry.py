"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from geolith.llm.exact import OP3_SQL, op3_exact_dedup
from geolith.llm.mixing import op1_mixing
from geolith.llm.near import op2_minhash_near_dedup
from geolith.llm.packing import op6_packing
from geolith.llm.pii import op5_pii_pseudonyms
from geolith.llm.quality import op8_quality
from geolith.llm.sharding import op9_sharding
from geolith.llm.tokens import op4_token_files
from geolith.llm.urls import OP10_SQL, op10_url_filters
from geolith.llm.vectors import op7_embedding_near_dedup

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_files": op4_token_files,
    "op5_pii_pseudonyms": op5_pii_pseudonyms,
    "op6_packing": op6_packing,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_quality": op8_quality,
    "op9_sharding": op9_sharding,
    "op10_url_filters": op10_url_filters,
}

ORACLES = {"op3_exact_dedup": OP3_SQL, "op10_url_filters": OP10_SQL}
