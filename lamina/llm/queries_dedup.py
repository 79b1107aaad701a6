"""Registered queries that compare documents with each other or with the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import decontaminate, fuzzy_lines, probminhash, repeats
from lamina.llm.common import table
from lamina.llm.registry import query


@query("op7_decontaminate")
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, verbatim or with other numbers, names and units."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many repeat an earlier one, and a checksum of what stays."""
    out = fuzzy_lines.drop_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op4_near_dedup")
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest id of its group of near and exact copies."""
    return probminhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


@query("op10_repeats")
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document once byte strings that occur earlier are removed."""
    out = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
