"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_sql, decontaminate, idfiles, lm, neardup, prefix_trie, quality, repair, repeats, sentencepieces, token_counts,
    toolcalls, toxicity, vectors,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_token_counts")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"))


@query("op6_minhash_near_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), width=2)


@query("op7_sentencepiece")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepieces.encoding_digests(table(spark, folder, "documents"))


@query("op2_quality_classifier")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_benchmark_decontamination")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.benchmark_matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op4_toxicity")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_embedding_near_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(table(spark, folder, "embeddings"))


@query("op9_token_id_files")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return idfiles.read_ids(idfiles.write_ids(table(spark, folder, "documents")), digests=True)


@query("op10_lm_scoring")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_documents(table(spark, folder, "documents"))


# The given conversations hold no calls; tests/llm checks linking, order and schemas on small ones that do.
CONVERSATIONS = """
SELECT conv_id, CAST(coalesce(turn, 0) // 1000 AS BIGINT) AS part, CAST(0 AS BIGINT) AS piece,
       count(*) AS n_turns, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_faulty,
       '[' || string_agg('{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR)
                         || ',"role":' || CAST(to_json(coalesce(role, 'user')) AS VARCHAR) || '}', ','
                         ORDER BY turn NULLS FIRST, role, text) || ']' AS json
FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)
GROUP BY conv_id, coalesce(turn, 0) // 1000
"""


@query("op5_chat_formatting", CONVERSATIONS)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return toolcalls.format_conversations(table(spark, folder, "conversations"))


@query("op11_conversation_prefix_trie", conversation_sql.TRIE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"), rebuild=True)


@query("op12_conversation_repair", conversation_sql.REPAIR)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations")
    return repair.repair_conversations(repair.damage(given), ids=given)


@query("op13_suffix_array_dedup")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
