"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import (decontaminate, licenses, lm_automaton, mixing, ngram_join, quality_mcd,
                           setm, sharding, site_quality, token_files, toxicity, warc, whitening)
from shelfcast.llm.common import held_out, table


def op1_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"),
                        F.array_join("sentence_ids", ",").alias("sentence_ids"),
                        F.array_join("licenses", ",").alias("licenses"))


def op2_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_automaton.train_and_score(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5, 1))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op4_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op5_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' source is their host, their language its path."""
    return site_quality.classify(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"),
        use=~held_out(F.col("doc_id"), 5, 1)).select(
            "doc_id", held_out(F.col("doc_id"), 5, 1).alias("held_out"), "evidence", "host_posterior",
            "path_posterior", "score", F.col("good").alias("kept"))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(warc.write_archive(table(spark, sf_dir, "pages")))


def op7_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_components(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"),
                                  table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    ids = F.col("items")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ids), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "matches")


def op9_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, ~held_out(F.col("doc_id"), 4, 2))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mcd.robust_verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "distance")


def op11_weighted_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))
    return white.withColumn("deviation", F.expr("try_cast(deviation as long)"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    files = token_files.write_files(table(spark, sf_dir, "documents"),
                                    public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_files(files)


def op13_setm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setm.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_license_rules, op2_backoff_automaton, op3_mix_sources, op4_best_fit_shards,
        op5_site_quality, op6_warc_archive, op7_prefix_tree_join, op8_suffix_array, op9_counterfactual_toxicity,
        op10_quality_mcd, op11_weighted_whitening, op12_token_files, op13_setm_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_rules": licenses.oracle(), "op3_mix_sources": mixing.oracle(),
            "op13_setm_collocations": setm.oracle()}
