"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import ann, chat, fim, html, langid, licenses, merkle, mixing, packing, quality, sharding, simhash, token_ids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_rules": licenses.op1,
    "op2_tag_path_ratios": html.op2,
    "op3_kmeans_tree": ann.op3,
    "op4_bpe_segment_tree": token_ids.op4,
    "op5_residual_packing": packing.op5,
    "op6_chat_windows": chat.op6,
    "op7_line_quality": quality.op7,
    "op8_golay_simhash": simhash.op8,
    "op9_jump_hash_shards": sharding.op9,
    "op10_crf_language": langid.op10,
    "op11_systematic_mixing": mixing.op11,
    "op12_checkpoint_fim": fim.op12,
    "op13_merkle_blocks": merkle.op13,
}
ORACLE_SQL: dict[str, str] = {
    "op6_chat_windows": chat.ORACLE,
    "op11_systematic_mixing": mixing.ORACLE,
    "op12_checkpoint_fim": fim.ORACLE,
    "op13_merkle_blocks": merkle.ORACLE,
}
