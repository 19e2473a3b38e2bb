"""``NOT IN`` with SQL NULL semantics (probe {1, 2, NULL})."""

import pytest

from cohortflow.operators.anti import not_in


@pytest.mark.parametrize("right,expected", [
    ([1], 1),            # 2 survives; NULL probe is dropped
    ([1, None], 0),      # a NULL in the subquery drops everything
    ([], 3),             # empty subquery keeps every row, NULL included
])
def test_not_in_probe(spark, right, expected):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    r = spark.createDataFrame([(x,) for x in right], "k long")
    assert not_in(left, r, "k").count() == expected


def test_not_in_by_group(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 5)], "g string, k long")
    right = spark.createDataFrame([("a", 1), ("b", None), ("b", 7)], "g string, k long")
    got = sorted(tuple(r) for r in not_in(left, right, "k", by=["g"]).collect())
    assert got == [("a", 2), ("c", 5)]


def test_matches_spark_sql_not_in(spark):
    left = spark.createDataFrame([(i if i % 7 else None,) for i in range(50)], "k long")
    right = spark.createDataFrame([(i,) for i in range(0, 50, 3)], "k long")
    left.createOrReplaceTempView("l_probe")
    right.createOrReplaceTempView("r_probe")
    want = sorted(r[0] for r in spark.sql(
        "SELECT k FROM l_probe WHERE k NOT IN (SELECT k FROM r_probe)").collect())
    got = sorted(r[0] for r in not_in(left, right, "k").collect())
    assert got == want


def sql_not_in(x, values):
    """Three-valued ``x NOT IN values`` reduced to keep/drop (NULL drops)."""
    if not values:
        return True
    if x is None:
        return False
    if x in values:
        return False
    return None not in values


from hypothesis import given, settings, strategies as st  # noqa: E402

keys = st.lists(st.one_of(st.none(), st.integers(0, 6)), max_size=8)


@settings(max_examples=15, deadline=None)
@given(left=keys, right=keys, group_right=st.booleans())
def test_not_in_property(spark, left, right, group_right):
    """Per group: the same rows as SQL NOT IN; groups without subquery rows keep all."""
    lrows = [("g", k) for k in left] + [("h", k) for k in left]
    rrows = [("g", k) for k in right] + ([("h", k) for k in right[:1]] if group_right else [])
    ldf = spark.createDataFrame(lrows, "g string, k long")
    rdf = spark.createDataFrame(rrows, "g string, k long")
    got = sorted(not_in(ldf, rdf, "k", by=["g"]).collect(), key=lambda r: (r[0], str(r[1])))
    want = []
    for g in ("g", "h"):
        vals = [k for gg, k in rrows if gg == g]
        want += [(g, k) for gg, k in lrows if gg == g and sql_not_in(k, vals)]
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (r[0], str(r[1])))


def test_guard_is_salted_where_it_is_not_broadcast(spark):
    """With broadcasts off the rows are dealt by group and salt, never by the few groups; same result."""
    left = spark.range(3000).selectExpr("id % 2 AS g", "CASE WHEN id % 10 = 0 THEN NULL ELSE id END AS k")
    right = spark.createDataFrame([(0, 5), (0, 1002), (1, None), (1, 7)], "g long, k long")
    want = sorted(map(tuple, not_in(left, right, "k", by=["g"]).collect()))
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        df = not_in(left, right, "k", by=["g"])
        text = df._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, df.collect()))
    finally:
        spark.conf.set(key, old)
    assert got == want and {g for g, _ in got} == {0} and len(got) == 1500 - 300 - 1
    joins = [ln for ln in text.splitlines() if "SortMergeJoin" in ln and "LeftOuter" in ln]
    assert joins and all("__salt" in ln for ln in joins)
