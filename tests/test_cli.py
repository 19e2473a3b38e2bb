"""The command-line run equals the library call."""

import os

import pytest

from cohortflow.__main__ import main
from cohortflow.operators.report import report
from cohortflow.params import DRIVER_PARAMS as P
from cohortflow.sources.sinks import read_csv
from cohortflow.sources.staging import staged_catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_cli_writes_the_report(spark, tmp_path):
    cat = staged_catalog(spark, SF)
    out = str(tmp_path / "report.csv")
    main(["--catalog", cat.root, "--anchor", "1997-06", "--months", "5",
          "--history-start", "1995-06-01", "--as-of", "1996-04-10", "--out", out], spark=spark)
    got = sorted(map(tuple, read_csv(spark, out).collect()))
    assert got == sorted(map(tuple, report(cat, P).collect()))
    assert len(got) == 42
