"""Report sinks.

The original writes one CSV with a header and no index. The report is tiny
(tens of rows per month), so the CSV sink writes a single file, anew on every
run; the scalable sink is Parquet partitioned by month, written by the
executors in parallel. It replaces the months that the report holds and leaves
the others (dynamic partition overwrite), so a monthly run appends its month and
a rerun replaces it; a month that has no row any more keeps its old rows. Both
refuse a report that is not of the declared schema. Paths live under the shared
folder named by ``spark.checkpoint.dir`` unless the caller passes one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from .schemas import REPORT, REPORT_KEYS


class ReportSchemaError(ValueError):
    """The frame is not a report: a column is missing, is one too many or has another type."""


def conforming(report: DataFrame) -> DataFrame:
    """``report`` in the declared column order. Other names or types are refused before anything is
    written; a row with a NULL key column, or a NULL count, fails the write (the check is part of its plan)."""
    want = {f.name: f.dataType for f in REPORT.fields}
    have = {f.name: f.dataType for f in report.schema.fields}
    if len(report.columns) != len(have):
        raise ReportSchemaError(f"repeated columns in {report.columns}")
    wrong = [f"{n}: {have.get(n, 'missing')} instead of {t}" for n, t in want.items() if have.get(n) != t]
    wrong += [f"{n}: not a report column" for n in have if n not in want]
    if wrong:
        raise ReportSchemaError("; ".join(wrong))

    def filled(name: str):
        what = "key" if name in REPORT_KEYS else "count"
        return F.coalesce(F.col(name), F.raise_error(F.lit(f"report row without {what} {name}")).cast(want[name])).alias(name)

    return report.select(*[filled(n) for n in want])


def write_csv(report: DataFrame, path: str) -> str:
    conforming(report).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_parquet(report: DataFrame, path: str) -> str:
    (conforming(report).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("Month").parquet(path))
    return path


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The report of all months below ``path`` with the declared columns and types."""
    return spark.read.schema(REPORT).parquet(path).select(*REPORT.fieldNames())


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).option("header", True).csv(path)


def roundtrip_csv(spark: SparkSession, report: DataFrame, name: str) -> DataFrame:
    """Write ``report`` as CSV to a new folder under the shared one and read it back typed."""
    path = shared_path(spark, "cohortflow-sinks", f"{name}-{uuid.uuid4().hex}.csv")
    write_csv(report, path)
    return read_csv(spark, path)


def append_months(spark: SparkSession, reports: list[DataFrame], path: str | None = None) -> DataFrame:
    """Write reports one after another into one Parquet folder, as monthly runs do, and read it back."""
    path = path or shared_path(spark, "cohortflow-sinks", f"months-{uuid.uuid4().hex}")
    for r in reports:
        write_parquet(r, path)
    return read_parquet(spark, path)
