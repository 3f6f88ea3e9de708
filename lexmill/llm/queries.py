"""The training-data operators as registered queries over whole tables, with oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, fingerprints, hard_negatives, licenses, line_dedup, mixing, ngram_join, pii, prefix_trie, rnn_lm, secrets, token_output, toxicity
from lexmill.llm.common import discard
from lexmill.session import table


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.amounts(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_edits(table(spark, sf_dir, "documents"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rnn_lm.score(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label").cast("bigint")
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), anchor=vec_id % 50 == 0, label=F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv_id = F.col("conv_id")
    turns = prefix_trie.numbered(table(spark, sf_dir, "conversations"))
    head = F.crc32(conv_id.cast("string").cast("binary")) % 4
    rebuilt, convs = prefix_trie.spliced(turns, base=conv_id - conv_id % 20, head=head, most=3)
    out = prefix_trie.trie(rebuilt, convs)
    discard(turns, convs)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontamination": op2_decontamination,
    "op8_ngram_join": op8_ngram_join,
    "op3_secret_scan": op3_secret_scan,
    "op4_fingerprints": op4_fingerprints,
    "op5_pii": op5_pii,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_mixing": op7_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_token_output": op10_token_output,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_license_scan": op12_license_scan,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op7_mixing": mixing.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op12_license_scan": licenses.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
