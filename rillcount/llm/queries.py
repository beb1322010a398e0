"""Registered queries of this package and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rillcount.llm import (
    align, bpe, decontaminate, gam, licenses, packing, pii, rules, search, simhash, topk, urls, wavelet)
from rillcount.llm.common import read_table
from rillcount.session import scratch_path

BYTE_BPE, WORD_BPE, PIECE_BPE = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer(name: str) -> str:
    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(read_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read_table(spark, sf_dir, "documents")).drop("matches")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "wavelet")
    wavelet.write_shards(read_table(spark, sf_dir, "documents"), path, tokenizer(BYTE_BPE), end_id=0)
    return wavelet.read_documents(spark, path)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages")).drop("score")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = gam.train(docs, read_table(spark, sf_dir, "labels"))
    return gam.classify(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_examples(read_table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE)).drop("n_loss")


def op8_packing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction data: what the assistant says is learnt, at most half of a sequence."""
    turns = packing.conversations(read_table(spark, sf_dir, "conversations"))
    return packing.pack_examples(turns, tokenizer(BYTE_BPE), key="conv_id", limits=packing.Limits(loss=1024), by_part=True)


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read_table(spark, sf_dir, "documents"), tokenizer(WORD_BPE))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "lexical")
    search.build_index(read_table(spark, sf_dir, "documents"), path)
    return search.search(spark, path, read_table(spark, sf_dir, "benchmark"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "alignment")
    align.build_index(read_table(spark, sf_dir, "documents"), path, tokenizer(BYTE_BPE), tokenizer(PIECE_BPE))
    return align.document_scores(spark, path)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_rules, op2_pii, op3_license_scan, op4_simhash, op5_wavelet_tokens, op6_url_filter,
    op7_quality_classifier, op8_packing, op8_packing_conversations, op9_top_k, op10_bpe, op11_lexical_search, op12_decontaminate,
    op13_token_alignment, pipeline)}
