"""The numbered queries: each applies an operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respgrid.llm import exact_dedup, html_extraction, license_scan, line_dedup, mixing, ngram_quality, packing, pitman_yor, simhash, spelling, token_counts, vector_codes, warc
from respgrid.llm.common import documents, stored


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op4_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_quality.judged(documents(spark, sf_dir))
    return found.select("doc_id", *ngram_quality.COLUMNS, "base_failed", "kept", F.round("log_perplexity", 6).alias("log_perplexity"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir)).drop("text_hash")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source")
    return mixing.mixed(docs).withColumn("target_share", F.round("target_share", 6))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(documents(spark, sf_dir), license_scan.registry(spark))
    return found.withColumn("notice_ids", F.array_join("notice_ids", ","))


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pitman_yor.score_texts(pitman_yor.one_fifth(docs))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return line_dedup.kept_digests(docs, line_dedup.keep_bitmaps(docs))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    _, index = warc.archived(pages)
    found = stored(warc.lookup(index, pages.select("url", "page_id")), "found-captures")
    return warc.read_records(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = vector_codes.with_label_error(stored(coded, "vector-codes"))
    digest = F.lit(books.digest() if books else None).cast("string")
    return found.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(documents(spark, sf_dir).select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_token_counts": op2_token_counts,
        "op3_html_extraction": op3_html_extraction,
        "op4_ngram_quality": op4_ngram_quality,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_mixing": op6_mixing,
        "op7_license_scan": op7_license_scan,
        "op8_pitman_yor": op8_pitman_yor,
        "op9_simhash": op9_simhash,
        "op10_line_dedup": op10_line_dedup,
        "op11_warc": op11_warc,
        "op12_vector_codes": op12_vector_codes,
        "op13_spelling": op13_spelling,
    }
