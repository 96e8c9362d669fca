"""Registered queries of the operators: (session, data folder) -> DataFrame, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (
    compression_bands, content_span, histogram_packing, importance_resampling, jaccard_groups, label_shards, license_classifier, multi_index, ordinal_quality,
    phrase_growth, pii_boosting, prefix_viterbi, secret_automaton, twins)

Plan = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compression_bands.measured(docs).select("doc_id", "bands.*")


def op8_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("spans")
    number = {r.kind: n for n, r in enumerate(secret_automaton.RULES)}
    order = F.create_map(*[F.lit(x) for kv in number.items() for x in kv])

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listing(array):
        sorted_spans = F.sort_array(F.transform(array, lambda s: F.struct(s["start"], order[s["kind"]].alias("rule"), s["end"], s["kind"])))
        return F.array_join(F.transform(sorted_spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter(spans, lambda s: s["kind"].isin([r.kind for r in secret_automaton.BASE]))
    return secret_automaton.scanned(docs).select(
        "doc_id", *[count(r.kind) for r in secret_automaton.BASE],
        F.sha2(listing(base).cast("binary"), 256).alias("base_sha256"), listing(spans).alias("spans"))


def op2_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_shards.sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_prefix_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return prefix_viterbi.checked(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op5_content_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return content_span.extracted(pages, content_span.trained(pages)).withColumn("n_chars", F.length("text").cast("long"))


def op6_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_groups.joined(docs, jaccard_groups.JaccardRule(words=3, percent=90))


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal_quality.trained(docs, ordinal_quality.graded(table(spark, sf_dir, "labels")))
    tail = F.col("rating.tail")
    return ordinal_quality.rated(docs, model).select(
        "doc_id", "rating.score", "rating.expected_grade", tail[0].alias("p_good"), tail[1].alias("p_good_and_clean"), ordinal_quality.kept(tail, model).alias("kept"))


def op9_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return histogram_packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), payload="crc32")


def op10_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_classifier.scanned(docs, license_classifier.trained(docs))


def op11_importance_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance_resampling.resampled(docs, table(spark, sf_dir, "benchmark"))


def op12_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_boosting.scanned(docs, pii_boosting.fit(docs)).select("doc_id", *pii_boosting.summary(F.col("pii")))


def op13_phrase_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_growth.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES: dict[str, Plan] = {f.__name__: f for f in (op1_compression_bands, op2_inverted_multi_index, op3_label_propagation, op4_prefix_viterbi, op5_content_span, op6_token_group_join, op7_ordinal_quality, op8_secret_automaton,
                                                  op9_histogram_packing, op10_license_classifier, op11_importance_radix, op12_pii_boosting,
                                                  op13_phrase_growth)}
SQL: dict[str, str] = twins.SQL
