"""Groups of too few or equal values: the operator keeps them with nulls, the queries leave them out as their SQL does."""

from evokeline.operators import stats
from evokeline.plans.library import QUERIES
from evokeline.plans.stats_queries import shaped

D = "/root/testdata/sf0.001"


def test_groups_without_a_statistic(spark):
    rows = [("two", 1.0), ("two", 2.0), ("same", 3.0), ("same", 3.0), ("same", 3.0), ("holes", 1.0), ("holes", 2.0), ("holes", None), ("three", 1.0), ("three", 2.0), ("three", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    assert {r["k"]: r["w"] is None for r in stats.shapiro_wilk(df, ["k"], "v").collect()} == {"two": True, "same": True, "holes": True, "three": False}
    assert [r["k"] for r in shaped(df, ["k"], "v").collect()] == ["three"]


def test_queries_leave_them_out(spark):
    found = QUERIES["shapiro_wilk"](spark, D).collect()
    assert found and all(r["n"] >= 3 and r["w"] is not None for r in found)
    assert {(r["grp"], r["t"]) for r in QUERIES["adaptive_test"](spark, D).collect()} == {(r["grp"], r["t"]) for r in found}
