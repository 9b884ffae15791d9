"""Queries of this package, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from loomsearch.llm import decontam, fingerprint, line_dedup, ngram_join, packing, pii, quality, secret_scan, suffix_dedup, url_filter
from loomsearch.llm._shared import read_table


def op9_url_filter(spark, sf_dir):
    """The package's lists of unwanted domains, hosts and paths over all pages."""
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"), url_filter.listed_rules(spark))


def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_join(read_table(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    return decontam.contaminated_spans(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_personal_data(spark, sf_dir):
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


def op4_fingerprints(spark, sf_dir):
    return fingerprint.matches(read_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark, sf_dir):
    return quality.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_packing(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.dropped_lines(read_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark, sf_dir):
    return secret_scan.secrets(read_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeated_spans(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_decontamination": op2_decontamination,
    "op3_personal_data": op3_personal_data,
    "op4_fingerprints": op4_fingerprints,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_packing": op6_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_url_filter": op9_url_filter,
    "op10_suffix_dedup": op10_suffix_dedup,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE,
    "op2_decontamination": decontam.ORACLE,
    "op9_url_filter": url_filter.ORACLE,
    "op10_suffix_dedup": suffix_dedup.ORACLE,
}
