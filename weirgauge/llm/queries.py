"""Registered queries of this package: each applies its operator, with production
parameters, to the whole of its table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgauge.llm import centroids, embedding_links, importance, licences, line_dedup, quality, substring_dedup
from weirgauge.llm.decontaminate import contaminated
from weirgauge.llm.html_text import page_texts
from weirgauge.llm.mixing import mix_sources
from weirgauge.llm.simhash import simhash_components
from weirgauge.llm.token_store import read_digests, write_store
from weirgauge.llm.toxicity import score_toxicity
from weirgauge.storage import settle, shared_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file() -> str:
    """The vocabulary of the token queries; WEIRGAUGE_TOKENIZER names another."""
    if named := os.environ.get("WEIRGAUGE_TOKENIZER"):
        return named
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    # The lines are read twice, to be counted and to be cut: they are made once.
    pages = settle(table(spark, folder, "pages").select(
        "page_id", "url", line_dedup.page_lines(F.col("html")).alias("lines")), "page-lines")
    cleaned = line_dedup.drop_site_lines(pages, line_dedup.host_of(F.col("url")), F.col("lines"))
    return cleaned.select("page_id", "url", "host", "n_lines", "n_dropped", F.array_join("kept_lines", "\n").alias("text"))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_components(table(spark, folder, "documents"))


def op3_token_store(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "token-store")
    write_store(table(spark, folder, "documents"), path, tokenizer_file())
    return read_digests(spark, path)


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge_quality(table(spark, folder, "documents"))


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_texts(table(spark, folder, "pages"))


def op7_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan_licences(table(spark, folder, "documents"))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeat_digests(table(spark, folder, "documents"))


def op9_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents")).drop("text_key")


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_embedding_links(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_links.link_vectors(table(spark, folder, "embeddings"))


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, folder, "embeddings")).drop("centroid")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_simhash": op2_simhash,
    "op3_token_store": op3_token_store,
    "op4_quality_rules": op4_quality_rules,
    "op5_decontaminate": op5_decontaminate,
    "op6_html_text": op6_html_text,
    "op7_licences": op7_licences,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_toxicity": op10_toxicity,
    "op11_importance": op11_importance,
    "op12_embedding_links": op12_embedding_links,
    "op13_centroids": op13_centroids,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.sql(),
    "op4_quality_rules": quality.sql(),
    "op7_licences": licences.sql(),
    "op8_substring_dedup": substring_dedup.sql(),
    "op11_importance": importance.sql(),
    "op12_embedding_links": embedding_links.sql(),
    "op13_centroids": centroids.sql(),
}
