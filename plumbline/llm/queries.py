"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, language_id, lm, mixing, quality, runs, search, simhash, substrings, token_counts, token_files, toxicity, warc
from plumbline.llm.common import read


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, manifest = token_files.write_token_files(read(spark, sf_dir, "documents"))
    return token_files.read_token_files(manifest)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = warc.write_bundles(read(spark, sf_dir, "pages"))
    r = warc.read_bundles(spark, index)
    return r.select(warc.page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_number("refers_to").alias("refers_to"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "flagged")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("item_id", "rank", F.col("doc_id").cast("long").alias("doc_id"), "score")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.detect(read(spark, sf_dir, "documents"), plant=True)


_ALL = (op1_token_counts, op2_simhash_near_dedup, op3_quality_rules, op4_token_files, op5_mix_sources, op6_warc, op7_decontaminate, op8_language_id, op9_lm_scores, op10_toxicity, op11_ranked_search, op12_substring_dedup, op13_periodic_runs)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op5_mix_sources": mixing.ORACLE, "op6_warc": warc.ORACLE, "op7_decontaminate": decontaminate.ORACLE, "op11_ranked_search": search.ORACLE}
