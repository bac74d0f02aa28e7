"""The queries of this subpackage over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common, html, language_model, licenses, mixing, neighbours, phrases, pieces, quality, runs, simhash, spelling, sql, substring, suffixes


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality.COUNTS, "base_failed", "kept", "quality", *[f"v_{r}" for r in quality.RULES])


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pieces.encode(docs, restored="decoded")
    size = F.coalesce(F.size("pieces"), F.lit(0)).cast("long")
    return found.select("doc_id", "pieces", size.alias("n_pieces"), "score", F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("restored"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(common.table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.repeated_word_spans(common.table(spark, sf_dir, "documents")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.repeated_byte_spans(common.table(spark, sf_dir, "documents")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(runs.with_repeats(common.table(spark, sf_dir, "documents"))))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(common.table(spark, sf_dir, "documents"), spelling.DAMAGED)


def op13_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.beside_next(common.table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_html_extraction": op2_html_extraction,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_source_mixing": op7_source_mixing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_phrase_fingerprints": op13_phrase_fingerprints,
}

ORACLE_SQL: dict[str, str] = {
    "op8_substring_dedup": sql.SUBSTRING_DEDUP,
    "op9_suffix_dedup": sql.SUFFIX_DEDUP,
    "op10_license_scan": sql.LICENSE_SCAN,
    "op11_periodic_runs": sql.PERIODIC_RUNS,
    "op12_spelling_variants": sql.SPELLING_VARIANTS,
}
