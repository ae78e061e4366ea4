"""Registered queries of the operators and their SQL (where SQL can express the result)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm import (bagminhash, covertree, decontam, gnat, lang_ppm, licenses, oracle, packing, quality_llr, recompress, secrets, slots,
                            token_prefix, url_aliases)
from panelspark.llm.scratch import table

TOKENIZER = "byte_bpe_50k.json"


def op1_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_ppm.fit(lang_ppm.training_rows(docs))
    held = F.coalesce(F.expr(lang_ppm.HELD_OUT), F.lit(False)).alias("held_out")
    return lang_ppm.identify(docs, model).select("doc_id", held, "lang_pred", "score", "bits_per_byte")


def op2_token_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_prefix.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.shard(table(spark, sf_dir, "documents"))


def op5_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_aliases.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_shingles")


def op10_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_llr.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=None)


def op11_gnat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gnat.mine(gnat.relabelled(table(spark, sf_dir, "embeddings")))


def op12_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = covertree.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


REGISTRY = {
    "op1_language_ppm": (op1_language_ppm, None),
    "op2_token_prefix": (op2_token_prefix, None),
    "op3_recompression": (op3_recompression, oracle.OP3),
    "op4_virtual_slots": (op4_virtual_slots, None),
    "op5_url_aliases": (op5_url_aliases, oracle.OP5),
    "op6_prefix_join": (op6_prefix_join, oracle.OP6),
    "op7_randomness": (op7_randomness, None),
    "op8_concat_cut": (op8_concat_cut, None),
    "op9_bagminhash": (op9_bagminhash, oracle.OP9),
    "op10_llr": (op10_llr, None),
    "op11_gnat": (op11_gnat, oracle.OP11),
    "op12_cover_tree": (op12_cover_tree, oracle.OP12),
    "op13_license_join": (op13_license_join, oracle.OP13),
}
