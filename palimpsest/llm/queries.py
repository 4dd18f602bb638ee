"""The registered queries of this folder: each applies its operator, with production parameters, to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, line_dedup, near_dedup, oracles, packing, pii, quality_mil, quality_rules, substring_dedup, toxicity, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*cols) if cols else df


def vocabulary() -> dict[str, str]:
    """Paths of the public vocabulary and of the same one as ranks, and the pattern that splits text before merges."""
    import public_tokenizers

    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_read(spark, sf_dir, "documents", "doc_id", "text"), **vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules.quality(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = near_dedup.near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"), shingle=4)
    return done.select("doc_id", "n_shingles", "component_id", "kept")


def _of_kind(k: int) -> Callable:
    return lambda x: x["k"] == k


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.find_pii(_read(spark, sf_dir, "documents", "doc_id", "text"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(pii.BASIC)]
    secret = pii.KINDS.index("secret")
    done = done.withColumns({"secrets": F.filter("spans", _of_kind(secret)), "n_found": F.size("spans").cast("bigint")}).withColumn("spans", F.filter("spans", lambda x: x["k"] != secret))
    return done.select("doc_id", *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"), pii.joined("secrets").alias("secrets"), "n_found")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark", "item_id", "text"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "labels"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.quality(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: A fixed list of dated events: (list, kind, value, action, day of the year from 0).
URL_EVENTS = (
    ("block", "domain", "spam-farm.example.org", "add", 20),
    ("block", "domain", "spam-farm.example.org", "remove", 200),
    ("block", "domain", "spam-farm.example.org", "add", 260),
    ("block", "domain", "cheap-pills.example.net", "add", 0),
    ("block", "domain", "cheap-pills.example.com", "add", 45),
    ("allow", "host", "blog.cheap-pills.example.net", "add", 100),
    ("allow", "host", "blog.cheap-pills.example.net", "remove", 160),
    ("block", "domain", "casino-win.example.net", "add", 30),
    ("block", "domain", "ads-track.example.com", "add", 10),
    ("block", "domain", "ads-track.example.com", "remove", 300),
    ("block", "domain", "adult-x.example.com", "add", 0),
    ("block", "domain", "free-bets.example.net", "add", 75),
    ("block", "domain", "example.org", "add", 340),
    ("allow", "domain", "ththed.example.org", "add", 341),
)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no fetch time: page p is taken as fetched on day p mod 366 of 2024. Besides the fixed list, each host whose
    MD5 digest begins with 0 to 3 is listed from a day that its length gives, for 90 days if the digest's second digit is
    below 8; so the list grows with the corpus."""
    pages = _read(spark, sf_dir, "pages", "page_id", "url").withColumn("fetched", F.expr("date_add(date'2024-01-01', cast(page_id % 366 as int))"))
    hosts = pages.select(url_filter.host(F.col("url")).alias("value")).where("value is not null").distinct().withColumn("digest", F.md5("value")).where("substring(digest, 1, 1) < '4'")
    hosts = hosts.withColumn("day", F.expr("date_add(date'2024-01-01', cast(length(value) * 7 % 300 as int))"))
    added = hosts.select(F.lit("block").alias("list"), F.lit("host").alias("kind"), "value", F.lit("add").alias("action"), F.col("day").alias("at"))
    removed = hosts.where("substring(digest, 2, 1) < '8'").select(F.lit("block").alias("list"), F.lit("host").alias("kind"), "value", F.lit("remove").alias("action"), F.date_add("day", 90).alias("at"))
    fixed = spark.createDataFrame(list(URL_EVENTS), "list string, kind string, value string, action string, day int").select("list", "kind", "value", "action", F.expr("date_add(date'2024-01-01', day)").alias("at"))
    return url_filter.judge(pages, fixed.unionByName(added).unionByName(removed)).select("page_id", "host", "blocked", "list", "kind", "value")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_near_dedup": op2_near_dedup,
        "op3_quality_rules": op3_quality_rules,
        "op4_pii": op4_pii,
        "op5_decontamination": op5_decontamination,
        "op6_toxicity": op6_toxicity,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_url_filter": op9_url_filter,
        "op10_line_dedup": op10_line_dedup,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_near_dedup": oracles.OP2,
        "op7_substring_dedup": oracles.OP7,
        "op9_url_filter": oracles.op9(URL_EVENTS),
        "op10_line_dedup": oracles.OP10,
    }
