"""The queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from framelake.llm import oracles
from framelake.llm.automaton import op3_bpe_encoding_and_decoding
from framelake.llm.language import op9_language_id
from framelake.llm.lexical import op13_ranked_search
from framelake.llm.near_duplicates import op6_minhash_near_dedup
from framelake.llm.packing import op1_best_fit_packing
from framelake.llm.permutation_index import op5_approximate_nearest_neighbours
from framelake.llm.quality_model import op4_quality_classifier
from framelake.llm.quality_rules import op8_quality_rules
from framelake.llm.repeated_text import op7_suffix_array_dedup
from framelake.llm.secrets import op10_secret_scans
from framelake.llm.sharding import op2_sharding
from framelake.llm.toxicity import op12_toxicity
from framelake.llm.turns import op11_conversation_repair

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_sharding": op2_sharding,
    "op3_bpe_encoding_and_decoding": op3_bpe_encoding_and_decoding,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_approximate_nearest_neighbours": op5_approximate_nearest_neighbours,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_secret_scans": op10_secret_scans,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_toxicity": op12_toxicity,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE_SQL: dict[str, str] = {
    "op8_quality_rules": oracles.op8(),
    "op10_secret_scans": oracles.op10(),
    "op11_conversation_repair": oracles.op11(),
    "op13_ranked_search": oracles.op13(),
}
