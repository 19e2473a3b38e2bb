"""Report sinks: CSV (single file, header) and Parquet partitioned by Month."""

import pytest
from pyspark.sql import functions as F

from cohortflow.operators.report import report
from cohortflow.sources.catalog import frames_catalog
from cohortflow.sources.schemas import REPORT
from cohortflow.sources.sinks import ReportSchemaError, append_months, read_csv, read_parquet, roundtrip_csv, write_csv, write_parquet

from micro import PARAMS, tables


def test_sinks_round_trip(spark, tmp_path):
    rep = report(frames_catalog(spark, tables()), PARAMS.with_(n_months=2))
    want = sorted(map(tuple, rep.collect()))
    csv = write_csv(rep, str(tmp_path / "report.csv"))
    assert len([p for p in (tmp_path / "report.csv").iterdir() if p.name.endswith(".csv")]) == 1
    assert sorted(map(tuple, read_csv(spark, csv).collect())) == want
    pq = write_parquet(rep, str(tmp_path / "report.parquet"))
    back = spark.read.parquet(pq).select(*REPORT.fieldNames())
    assert sorted(map(tuple, back.collect())) == want
    assert (tmp_path / "report.parquet" / "Month=2023-03").is_dir()
    assert back.where(F.col("Month") == "2023-03").count() == sum(r[0] == "2023-03" for r in want)


def test_round_trips_do_not_disturb_each_other(spark):
    rep = report(frames_catalog(spark, tables()), PARAMS)
    one = roundtrip_csv(spark, rep, "report")
    two = roundtrip_csv(spark, rep.where(F.col("vertical") == "Pharmacy"), "report")
    want = sorted(map(tuple, rep.collect()))
    assert sorted(map(tuple, one.collect())) == want
    assert sorted(map(tuple, two.collect())) == [r for r in want if r[1] == "Pharmacy"]


def test_months_are_replaced_one_by_one(spark, tmp_path):
    """Writing a month keeps the others; writing it again replaces it."""
    rep = report(frames_catalog(spark, tables()), PARAMS.with_(n_months=3)).cache()
    months = sorted({r["Month"] for r in rep.collect()})
    path, want = str(tmp_path / "report"), sorted(map(tuple, rep.collect()))
    got = append_months(spark, [rep.where(F.col("Month") == m) for m in months], path)
    assert sorted(map(tuple, got.collect())) == want and got.schema == REPORT
    changed = rep.where(F.col("Month") == months[0]).withColumn("q_user_plus", F.lit(99).cast("long"))
    write_parquet(changed, path)
    got = sorted(map(tuple, read_parquet(spark, path).collect()))
    assert [r for r in got if r[0] != months[0]] == [r for r in want if r[0] != months[0]]
    assert {r[8] for r in got if r[0] == months[0]} == {99}
    write_parquet(rep.where("false"), path)                  # no month: nothing is replaced
    assert sorted(map(tuple, read_parquet(spark, path).collect())) == got


def test_other_schemas_are_refused(spark, tmp_path):
    rep = report(frames_catalog(spark, tables()), PARAMS)
    path = str(tmp_path / "report")
    for wrong in (rep.drop("q_user_plus"), rep.withColumn("q_user_plus", F.col("q_user_plus").cast("int")), rep.withColumn("more", F.lit(1)),
                  rep.withColumnRenamed("vertical", "Vertical"), rep.select("*", F.lit("x").alias("Month"))):
        for write in (write_parquet, write_csv):
            with pytest.raises(ReportSchemaError):
                write(wrong, path)
    assert not (tmp_path / "report").exists()
    for name in ("user_type", "q_user_plus"):
        with pytest.raises(Exception, match="without"):
            write_parquet(rep.withColumn(name, F.lit(None).cast(REPORT[name].dataType)), path)
    write_parquet(rep.select(*reversed(rep.columns)), path)  # the order of columns does not matter
    assert read_parquet(spark, path).count() == rep.count()
