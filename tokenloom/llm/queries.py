"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from tokenloom.llm import bpe, chat, exact_dedup, licenses, line_dedup, mixing, near_dedup, quality, sharding, wavelet

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_minhash_near_dedup": near_dedup.op3_minhash_near_dedup,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_source_mix": mixing.op5_source_mix,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_wavelet_ids": wavelet.op7_wavelet_ids,
    "op8_chat_format": chat.op8_chat_format,
    "op9_sharding": sharding.op9_sharding,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

SQL = {
    "op9_sharding": sharding.OP9_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}
