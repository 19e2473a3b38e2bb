"""Helpers shared by the text operators: reading tables, staged intermediate tables."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

#: Separators of the word rule ``[^\x20\x09-\x0D]+`` as a Java character class.
SPACE = r"[ \t-\r]+"


def by_value(module: str) -> None:
    """Send the functions of a module to the executors with the job, which then need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage at a table that every executor can read again, so a lost
    executor never makes a half-finished job recompute differently.
    """
    path = shared_path(df.sparkSession, "llm-stage", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text) -> F.Column:
    """Words of a text, in order (null text: no words)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lower_ascii(text) -> F.Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with marks behind it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
