"""One query per corpus operator over the whole test tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import (bytenet, decontaminate, interactions, langid, lines, phrases, pieces, pii, simhash, suffixes, tokens, urls,
                         vectors)
from tabloom.sources.tables import table


def op1_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf, "documents"), words=4, max_bits=4)
    return groups.select(F.col("id").alias("doc_id"), simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id", "kept")


def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = lines.drop_spread_lines(table(spark, sf, "documents"), report=True)
    return cut.select("doc_id", "text", "n_lines", "n_removed")


def op3_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf, "embeddings"))


def op4_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.find_matches(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return decontaminate.summary(found).drop("matches")


def op5_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    return urls.judge(pages, urls.labels_of_documents(pages, table(spark, sf, "labels"))).drop("matched_rules")


def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf, "documents"))


def op7_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.encode_table(table(spark, sf, "documents").select("doc_id", "text")).drop("text")


def op8_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.cut_repeats(table(spark, sf, "documents"), keep_bytes=False).drop("spans")


def op9_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digest(pii.find_spans(table(spark, sf, "documents")))


def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(table(spark, sf, "documents"))


def op11_filter_interaction_audit(spark: SparkSession, sf: str) -> DataFrame:
    return interactions.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op12_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return bytenet.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op13_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_simhash_near_dedup, op2_line_dedup, op3_embedding_near_dedup, op4_benchmark_decontamination, op5_url_filter,
        op6_token_files, op7_sentencepiece, op8_suffix_array_dedup, op9_pii, op10_language_id, op11_filter_interaction_audit,
        op12_quality_classifier, op13_phrase_collocations)
}

#: Near copies, graph search, tokens, learned models and byte offsets are beyond SQL; their tests compare with brute force.
ORACLES: dict[str, str] = {
    "op2_line_dedup": lines.SQL, "op4_benchmark_decontamination": decontaminate.SQL, "op5_url_filter": urls.SQL,
    "op11_filter_interaction_audit": interactions.SQL, "op13_phrase_collocations": phrases.SQL}
