"""The corpus pipeline: five stages, each a function of (spark, docs, sf_dir), written as Parquet and read again by the next.

Quality rules drop the documents that they reject; line deduplication rewrites texts, removing every line that a later
occurrence of a window covers; near-duplicate grouping keeps one
document of each group (the one with the smallest doc_id, repeated rows of it once); benchmark decontamination drops the
documents that hold a benchmark item; packing cuts the rest into sequences. Rows with a null doc_id pass like others, but
of a near-duplicate group only a row with the smallest non-null doc_id stays, or one row if all are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import core, decontaminate, line_dedup, near_dedup, packing, quality_rules
from palimpsest.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = line_dedup.dedup_lines(docs, counts=False)
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_duplicates(docs)
    best = groups.where("kept").groupBy("group").agg(F.min("key").alias("key")).select("key")
    # repeated rows have one key; they are merged where they are read, before any shuffle
    return core.unwrap(core.wrap(docs).dropDuplicates(["key"]).join(best, "key", "left_semi"), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, **vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Stages 1, 3 and 5 are not expressible in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        docs = core.cut(stage(spark, docs, sf_dir))
        core.drop_scratch(spark, *before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
