"""Registered queries of the corpus operators: each applies its operator, with production
parameters, to the whole of its tables and returns the columns its contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chorus.llm import decontam, divergence, html, jaccard, licenses, mixing, personal, phrases, quality, rules, shards, urlfilter, warc
from chorus.sources.tables import read_table


def op1_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of all sources takes from every document."""
    return mixing.mix_table(read_table(spark, sf_dir, "documents"))


def op2_html_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page, laid out in lines."""
    return html.extracted(read_table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the threshold table for every document."""
    return rules.judged(read_table(spark, sf_dir, "documents"))


def op4_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under a uniform shuffle with exact shard sizes."""
    return shards.manifest(read_table(spark, sf_dir, "documents"))


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record, read back and looked up in the capture index."""
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op6_bloom_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for the URL of every page."""
    return urlfilter.judged(read_table(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or the nearest directory's."""
    return licenses.scan(licenses.document_files(read_table(spark, sf_dir, "documents")))


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by boosted trees fitted on labelled ones."""
    return quality.judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in every document."""
    found = decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document under 5-word Jaccard similarity of 0.8 or more."""
    return jaccard.join(read_table(spark, sf_dir, "documents"))


def op11_boosted_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans and those that boosted trees add."""
    return personal.personal(read_table(spark, sf_dir, "documents"))


def op12_quotient_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First phrases of every lang by collocation score, counted in quotient filters."""
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its lang, and the terms it uses more than its lang."""
    return divergence.audit(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_entropy_balanced_mix, op2_html_rendering, op3_quality_rules, op4_hypergeometric_shards, op5_warc_index,
    op6_bloom_url_filter, op7_license_scan, op8_quality_trees,
    op9_benchmark_decontamination, op10_ngram_jaccard_join, op11_boosted_personal_data, op12_quotient_collocations, op13_source_divergence)}
