"""Corpus pipeline: toxicity, near duplicates, decontamination, personal data, packing.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir), works
on every row its predecessor kept, and returns a DataFrame; ``run`` writes each
result as Parquet below ``spark.checkpoint.dir`` and reads it again for the
next stage. All stages but the last return the columns of documents.

The near-duplicate and the contamination stage give every row a key of its own
in a written table and judge rows by it, so rows that repeat an id are judged
each by its text, and so are rows without one. Only a group of near copies of
which no row has an id stays whole. An empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm import decontam, packing, pii, simhash, toxicity
from cohortflow.llm.common import free_name, stage, table

TOXIC_AT = 0.3


def _keyed(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with a key for every row, written down so that it cannot change in a retry, and the key's name."""
    key = free_name(docs, "_stage_row")
    return stage(docs.withColumn(key, F.monotonically_increasing_id()), name), key


def _without(keyed: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of ``keyed`` whose key is not in ``gone``, without the key."""
    return keyed.join(gone, key, "left_anti").drop(key)


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC_AT``; the model learns from the labelled rows of ``docs``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_below(docs, model, TOXIC_AT)


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id (then key) of every group of linked fingerprints; groups without any id stay."""
    keyed, key = _keyed(docs, "near-duplicate-rows")
    found = simhash.near_duplicates(keyed, id_col=key).select(F.col("doc_id").alias("row"), "component_id")
    rows = stage(keyed.select(F.col(key).alias("row"), F.col("doc_id").alias("id")).join(found, "row"), "near-duplicates")
    # written first: joined as a plain table, so that a large group's rows can be split
    first = stage(rows.groupBy("component_id").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "row"))).alias("first")), "near-duplicate-first")
    gone = rows.join(first, "component_id").where(F.col("row") != F.col("first.row")).select(F.col("row").alias(key))
    return _without(keyed, gone, key)


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    keyed, key = _keyed(docs, "contamination-rows")
    found = decontam.leaks(keyed, table(spark, sf_dir, "benchmark"), id_col=key)
    return _without(keyed, found.select(F.col("doc_id").alias(key)).distinct(), key)


def redact_personal_data(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
                            .otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else clean


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, token ids and all, with their places in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: No SQL: fingerprints, edit distances, the model and the tokenizer have none; tests/llm holds each stage against plain Python.
ORACLE_SQL = None


def pipeline_oracle() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
