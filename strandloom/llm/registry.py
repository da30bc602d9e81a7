"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import queries_dedup, queries_importance, queries_infill, queries_language, queries_mixing, queries_scan, queries_sharding, queries_tokens, queries_vectors, queries_web

QUERIES = {
    "op1_hilbert_shards": queries_sharding.op1_hilbert_shards,
    "op2_stream_dedup": queries_dedup.op2_stream_dedup,
    "op3_simhash_components": queries_dedup.op3_simhash_components,
    "op4_license_scan": queries_scan.op4_license_scan,
    "op5_numpy_bpe": queries_tokens.op5_numpy_bpe,
    "op6_byte_bigru": queries_language.op6_byte_bigru,
    "op7_token_sstables": queries_tokens.op7_token_sstables,
    "op8_pivot_top_k": queries_vectors.op8_pivot_top_k,
    "op9_warc_captures": queries_web.op9_warc_captures,
    "op10_mix_sources": queries_mixing.op10_mix_sources,
    "op11_bigint_infill": queries_infill.op11_bigint_infill,
    "op12_learned_partitions": queries_vectors.op12_learned_partitions,
    "op13_radix_resample": queries_importance.op13_radix_resample,
}
SQL = {
    "op1_hilbert_shards": queries_sharding.OP1_SQL,
    "op2_stream_dedup": queries_dedup.OP2_SQL,
    "op8_pivot_top_k": queries_vectors.OP8_SQL,
    "op9_warc_captures": queries_web.OP9_SQL,
    "op10_mix_sources": queries_mixing.OP10_SQL,
    "op11_bigint_infill": queries_infill.OP11_SQL,
    "op13_radix_resample": queries_importance.OP13_SQL,
}
