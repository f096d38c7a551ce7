"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from tidemark.llm import align, bpe, codes, decontaminate, lines, neardup, quality, sharding, sketches, toxicity, vectors, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_warc": warc.op2_warc,
    "op3_embedding_near_dedup": vectors.op3_embedding_near_dedup,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_bpe_round_trip": bpe.op5_bpe_round_trip,
    "op6_token_counts": bpe.op6_token_counts,
    "op7_minhash_near_dedup": neardup.op7_minhash_near_dedup,
    "op8_quality": quality.op8_quality,
    "op9_line_dedup": lines.op9_line_dedup,
    "op9_line_dedup_long": lines.op9_line_dedup_long,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_fingerprints": sketches.op12_fingerprints,
    "op13_token_alignment": align.op13_token_alignment,
}

#: The others need hashes, tokenizers, archives or models that SQL doesn't have; tests/llm holds them against brute force.
ORACLES = {"op9_line_dedup": lines.ORACLE, "op9_line_dedup_long": lines.ORACLE_LONG}
