"""The queries of this package, each over its whole table, and the SQL of those that SQL can express."""

from tarn.llm.jaccard import OP3_SQL, op3_ngram_jaccard_join
from tarn.llm.licenses import OP8_SQL, op8_license_scan
from tarn.llm.mixing import op10_source_mixing
from tarn.llm.packing import op7_best_fit_packing
from tarn.llm.pages import op2_main_text
from tarn.llm.personal import op13_personal_data
from tarn.llm.quality import OP6_SQL, op6_host_quality
from tarn.llm.substring import OP1_SQL, op1_substring_dedup
from tarn.llm.tokens import op5_token_ids
from tarn.llm.toxicity import op9_toxicity
from tarn.llm.tries import OP12_SQL, op12_prefix_trie
from tarn.llm.vector_codes import OP11_SQL, op11_vector_codes
from tarn.llm.winnowing import op4_winnowing

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_main_text": op2_main_text,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_winnowing": op4_winnowing,
    "op5_token_ids": op5_token_ids,
    "op6_host_quality": op6_host_quality,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_license_scan": op8_license_scan,
    "op9_toxicity": op9_toxicity,
    "op10_source_mixing": op10_source_mixing,
    "op11_vector_codes": op11_vector_codes,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_personal_data": op13_personal_data,
}

ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op3_ngram_jaccard_join": OP3_SQL, "op6_host_quality": OP6_SQL, "op8_license_scan": OP8_SQL, "op11_vector_codes": OP11_SQL, "op12_prefix_trie": OP12_SQL}
