"""Connected components of a link table, by alternating stars.

Every round links each node's larger neighbours to its smallest one and then
each node's smaller neighbours likewise, until nothing changes; the number of
rounds grows with the logarithm of the component size. A hot node is one row
of a pre-aggregated minimum joined back to its links (a join that adaptive
execution can split). Each round ends in a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _stars(links: DataFrame) -> DataFrame:
    """One large and one small star step over links (u, v) with u > v."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .where("u <> v").distinct())
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node that can be reached, for every linked node but the root itself.

    ``links`` has columns u and v of one orderable type; loops and repeats are
    allowed; an empty table gives no rows.
    """
    e = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
              .where("u <> v").distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        e = stage(_stars(e), "stars")
    raise RuntimeError(f"links did not settle in {max_rounds} rounds")
