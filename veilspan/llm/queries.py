"""The queries of this subpackage, by name, and their SQL."""

from veilspan.llm import embedding_dedup, extraction, language, mixing, packing, search, sharding, simhash, sql, token_counts, toxicity

QUERIES = {
    "op2_search": search.op2_search,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op10_extraction": extraction.op10_extraction,
    "op9_language": language.op9_language,
    "op1_toxicity": toxicity.op1_toxicity,
    "op3_simhash": simhash.op3_simhash,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_sharding": sharding.op6_sharding,
    "op7_packing": packing.op7_packing,
    "op8_mixing": mixing.op8_mixing,
}

ORACLE_SQL = {
    "op2_search": sql.OP2,
    "op6_sharding": sql.OP6,
    "op8_mixing": sql.OP8,
}
