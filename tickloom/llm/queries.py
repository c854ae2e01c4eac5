"""The registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import chats, chunks, containment, licenses, line_rules, minhash, oracles, packing, tokens, toxicity, tries, url_rules, warc, whitening
from tickloom.registry.book import query
from tickloom.registry.views import table
from tickloom.session import scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query("op1_warc_transactions", oracles.WARC)
def warc_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return warc.page_archive(table(spark, folder, "pages"), scratch_path(spark, "archives"))


@query("op2_minhash_near_duplicates", oracles.NEAR_DUPLICATES)
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), size=3, percent=85)


@query("op3_snapshot_collapse", oracles.CHATS)
def snapshot_collapse(spark: SparkSession, folder: str) -> DataFrame:
    return chats.collapsed_chats(table(spark, folder, "conversations")).select("conv_id", "n_turns", "n_copies", "rendered")


@query("op4_line_frequency_rules", oracles.LINE_RULES)
def line_frequency_rules(spark: SparkSession, folder: str) -> DataFrame:
    return line_rules.quality_rules(table(spark, folder, "documents"))


@query("op5_benchmark_containment", oracles.CONTAINMENT)
def benchmark_containment(spark: SparkSession, folder: str) -> DataFrame:
    return containment.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op6_repeated_passages")
def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.repeated_passages(table(spark, folder, "documents"))


@query("op7_toxicity_chain")
def toxicity_chain(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(table(spark, folder, "documents"), TOKENIZER)


@query("op9_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), TOKENIZER)


@query("op10_license_scan")
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return licenses.license_scan(table(spark, folder, "documents")).select(*columns, "expressions", "permissive")


@query("op11_embedding_whitening")
def embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened_embeddings(table(spark, folder, "embeddings"))


#: The rules of the task.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query("op12_url_filter", oracles.URL_FILTER)
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judged_urls(table(spark, folder, "pages"), rules)


@query("op13_conversation_trie", oracles.CONVERSATION_TRIE)
def conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return tries.prefix_trie(*tries.rebuilt_conversations(table(spark, folder, "conversations")))
