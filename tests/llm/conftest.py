import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("driver test data not present")
    return SF


LONG = "Licensed under the Apache License, Version 2.0. " + " ".join(f"word{i % 977}x{i}" for i in range(30_000))

#: Texts every operator must take: null, empty, blanks, ties, repeats, marks, non-Latin, very long.
TEXTS = [None, "", "  \n\t ", "a", "a", "one two", "one two three", "one two three", "É à ß 日本語 \u00a0x \u2003y",
         "x" * 5000, LONG, "\x00 \x07 bell", "MIT License mit-license MIT  LICENSE", "General Public license apache",
         "mail a.b@c.de, x@y.zz@q.rr 1.2.3.4 999.1.1.1 +1 (017) 555-7713 4111 1111 1111 1111 4111111111111112",
         "token = \"0cf1bbc67ab39b2ddebadc809bed189ed8c6ac4d\" DE89 3704 0044 0532 0130 00 GB82WEST12345698765432",
         "1 2 3 4 " * 9000, "a@" * 4000, "9" * 30_000, "+1" + "(" * 20_000, "\n".join(["same line"] * 40),
         " ".join(["the cat sat"] * 60), "ˈ˞ word… “quoted” ﬁ İ K ſ", "<b>bold</b> &amp; 5 < 6 > 4"]


@pytest.fixture(scope="session")
def docs(spark):
    """The texts with repeated and null ids, and columns whose names clash with those operators use."""
    rows = [(None if i == 3 else 7 if i in (6, 7) else i, t, None if i % 3 else "en", "s", len(t) if t is not None else None,
             "x", 1, "y") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                       "t string, size int, shard string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
