"""Registered queries of the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, byte_bpe, cap_filters, code_compression, importance, ngram_join, packing, paragraph_dedup, sharding, suffix_dedup, topk, toxicity, warc_zstd
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

JOBS: dict[str, Query] = {
    "op1_paragraph_dedup": lambda s, d: paragraph_dedup.paragraph_report(table(s, d, "documents")),
    "op2_toxicity": lambda s, d: toxicity.toxic_documents(table(s, d, "documents"), table(s, d, "labels")),
    "op3_ngram_join": lambda s, d: ngram_join.similar_groups(table(s, d, "documents")).select(
        "doc_id", "n_shingles", "component_id"),
    "op4_topk": lambda s, d: topk.every_hundredth(table(s, d, "embeddings")),
    "op6_ann": lambda s, d: ann.every_fiftieth(table(s, d, "embeddings")),
    "op5_suffix_dedup": lambda s, d: suffix_dedup.dedup(table(s, d, "documents"), ["doc_id"], with_kept=False),
    "op7_warc": lambda s, d: warc_zstd.page_round_trip(table(s, d, "pages")),
    "op8_packing": lambda s, d: packing.pack_documents(
        table(s, d, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False),
    "op9_sharding": lambda s, d: sharding.shard_documents(table(s, d, "documents"), [1.0] * 40),
    "op10_byte_bpe": lambda s, d: byte_bpe.round_trip(
        table(s, d, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    "op11_code_compression": lambda s, d: code_compression.code_report(table(s, d, "embeddings")),
    "op12_cap_filters": lambda s, d: cap_filters.near_vectors(table(s, d, "embeddings")),
    "op13_importance": lambda s, d: importance.resample(table(s, d, "documents"), table(s, d, "benchmark")),
}

SQL: dict[str, str] = {"op4_topk": topk.SQL, "op11_code_compression": code_compression.SQL, "op12_cap_filters": cap_filters.SQL}
