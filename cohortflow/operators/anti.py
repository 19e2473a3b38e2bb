"""``x NOT IN (subquery)`` with SQL NULL semantics, per group.

SQL's ``NOT IN`` differs from ``left_anti`` when NULLs appear:

* an empty subquery keeps every row, even a NULL ``x``;
* otherwise a NULL ``x`` is dropped, and a NULL in the subquery drops all rows.

Spark plans a literal ``NOT IN`` as a null-aware anti join whose build side
is always broadcast -- unsafe when the subquery is a large history. This
operator uses a shuffle ``left_anti`` join on the non-NULL keys plus a guard
per group (non-empty? contains NULL?). The guard has one row per group and salt;
the planner broadcasts it only when its measured size is small, and a join by
group and salt spreads a hot group over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in(left: DataFrame, right: DataFrame, key: str, by: Sequence[str] = (),
           right_key: str | None = None) -> DataFrame:
    """Rows of ``left`` where ``left[key] NOT IN (right[right_key])`` within each ``by`` group."""
    by = list(by)
    rk = right_key or key
    if not by:  # one global group: a constant key instead of a cross join
        left, right, by = left.withColumn("__g", F.lit(0)), right.withColumn("__g", F.lit(0)), ["__g"]
        return not_in(left, right, key, by, rk).drop("__g")
    r = right.select(*by, F.col(rk).alias("__k"))
    # distinct (combined map-side) so a hot key on the subquery side cannot skew the join
    present = r.where(F.col("__k").isNotNull()).select(*by, F.col("__k").alias(key)).distinct()
    kept = left.join(present, by + [key], "left_anti")
    # the guard is copied to every salt, the rows are dealt by group and salt: where the guard is too
    # large to be broadcast, no group's rows meet in one task (the copies are groups times shuffle partitions)
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    guard = r.groupBy(*by).agg(F.bool_or(F.col("__k").isNull()).alias("__has_null"), F.lit(True).alias("__nonempty")) \
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    j = kept.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).join(guard, by + ["__salt"], "left")
    empty = F.col("__nonempty").isNull()
    keep = empty | (~F.col("__has_null") & F.col(key).isNotNull())
    return j.where(keep).drop("__has_null", "__nonempty", "__salt")
