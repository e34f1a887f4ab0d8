"""The named queries of the text operators: thin digests of each operator's own output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm import alignment, decontaminate, language, merkle, packing, quality, setsketch, simhash, suffixes, superkmers, toxicity, urls, warc
from hourloom.llm.oracle import SQL  # noqa: F401


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_table(spark, folder, "documents"))


def _digest(found: DataFrame, size: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select("doc_id", size, removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(suffixes.remove_repeats(_table(spark, folder, "documents")), "n_bytes")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    found = packing.pack(_table(spark, folder, "documents"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_superkmers(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(superkmers.remove_later_copies(_table(spark, folder, "documents")), "n_words").drop("n_spans")


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.read_archive(warc.write_archive(_table(spark, folder, "pages")))
    return found.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The part of the URL filter that is no model: address, longest rule that fits and what it decides."""
    host, path = urls.address(F.col("url"))
    pages = _table(spark, folder, "pages").select("page_id", host.alias("host"), path.alias("path"))
    found = urls.matched_rule(F.col("host"), F.col("path"))
    return pages.select("page_id", "host", "path", found["rule"].alias("rule"), found["verdict"].alias("rule_verdict"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.quality_rules(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(_table(spark, folder, "documents")).drop("groups")


def op12_setsketch(spark: SparkSession, folder: str) -> DataFrame:
    return setsketch.near_copies(_table(spark, folder, "documents"))


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.audit(_table(spark, folder, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_suffixes": op3_suffixes,
    "op4_packing": op4_packing,
    "op5_superkmers": op5_superkmers,
    "op6_decontaminate": op6_decontaminate,
    "op7_warc": op7_warc,
    "op8_urls": op8_urls,
    "url_rules": url_rules,
    "op9_quality": op9_quality,
    "op10_language": op10_language,
    "op11_alignment": op11_alignment,
    "op12_setsketch": op12_setsketch,
    "op13_merkle": op13_merkle,
}
