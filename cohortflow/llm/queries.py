"""Queries of the text operators: each derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontam import leaks
from .hard_negatives import hard_negatives, integer_vectors
from .html_text import main_texts
from .lattice import near_vectors
from .licenses import license_scan
from .packing import pack
from .periodic import periodic_runs, planted
from .pii import pii
from .quality import quality
from .sharding import shard_by_bytes
from .simhash import near_duplicates
from .toxicity import toxicity
from .url_rules import url_verdicts

Query = Callable[[SparkSession, str], DataFrame]


def op1_sharding(spark, sf_dir):
    return shard_by_bytes(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op2_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op3_main_text(spark, sf_dir):
    return main_texts(table(spark, sf_dir, "pages")).drop("n_lines", "n_shared")


def op4_url_rules(spark, sf_dir):
    return url_verdicts(table(spark, sf_dir, "pages")).drop("matched")


def op5_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("segments")


def op6_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op7_licenses(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


def op8_pii(spark, sf_dir):
    return pii(table(spark, sf_dir, "documents"))


def op9_decontamination(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True)


def op10_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark, sf_dir):
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_hard_negatives(spark, sf_dir):
    return hard_negatives(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("id") % 100 == 0)


def op13_periodic_runs(spark, sf_dir):
    found = periodic_runs(planted(table(spark, sf_dir, "documents")), text_col="text")
    top = "get(array_sort(transform(runs, r -> struct(-r.length AS l, r.start AS start, r.period AS period))), 0)"
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    x = found.withColumn("top", F.expr(top))
    return x.select("doc_id", F.expr("CAST(size(runs) AS BIGINT)").alias("n_runs"), F.col("top.start").alias("start"), F.expr("-top.l").alias("length"),
                    F.col("top.period").alias("period"), F.expr("1000 * -top.l DIV top.period").alias("exponent_milli"),
                    F.sha2(F.expr(lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def build_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_sharding, op2_quality, op3_main_text, op4_url_rules, op5_toxicity, op6_packing, op7_licenses, op8_pii,
        op9_decontamination, op10_simhash, op11_embedding_dedup, op12_hard_negatives, op13_periodic_runs)}
