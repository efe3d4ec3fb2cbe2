"""Groups of more values than the operators' Shapiro-Wilk limit: the queries give what their SQL gives."""

from statistics import NormalDist

import duckdb
import pandas as pd
import pytest

from evokeline.operators import stats
from evokeline.plans.library import QUERIES, SQL

SIZE = stats.MOST_VALUES + 400


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """One month's scores of three regions: symmetric with the fourth moment of normal values, normal, and skewed ones."""
    d = str(tmp_path_factory.mktemp("large"))
    normal = [NormalDist().inv_cdf((k + 0.5) / SIZE) for k in range(SIZE)]
    scores = {"three": [0.05 + 0.02 * (k % 6 == 0) - 0.02 * (k % 6 == 3) for k in range(SIZE)], "normal": [0.08 + 0.005 * v for v in normal], "skewed": [0.045 + 0.005 * 2.0**v for v in normal]}
    supplier = [(r * SIZE + k, r, x) for r, values in enumerate(scores.values()) for k, x in enumerate(values)]
    tables = {
        "lineitem": pd.DataFrame({"l_suppkey": [s for s, _, _ in supplier], "l_shipdate": pd.Timestamp("2020-01-15"), "l_discount": [x for _, _, x in supplier]}),
        "supplier": pd.DataFrame({"s_suppkey": [s for s, _, _ in supplier], "s_nationkey": [r for _, r, _ in supplier]}),
        "nation": pd.DataFrame({"n_nationkey": [0, 1, 2], "n_regionkey": [0, 1, 2]}),
        "region": pd.DataFrame({"r_regionkey": [0, 1, 2], "r_name": list(scores)}),
    }
    con = duckdb.connect()
    for name, df in tables.items():
        df.astype({c: "datetime64[us]" for c in df if c == "l_shipdate"}).to_parquet(f"{d}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    return d, con


def both(spark, large, name):
    """Rows by group, of the query and of its SQL."""
    d, con = large
    r = con.sql(SQL[name])
    return {x["grp"]: x.asDict() for x in QUERIES[name](spark, d).collect()}, {x["grp"]: x for x in (dict(zip(r.columns, v, strict=True)) for v in r.fetchall())}


def test_shapiro_wilk_of_large_groups(spark, large):
    ours, theirs = both(spark, large, "shapiro_wilk")
    assert set(ours) == set(theirs) == {"three", "normal", "skewed"}
    for g, r in theirs.items():
        assert ours[g]["n"] == r["n"] == SIZE
        assert abs(ours[g]["w"] - r["w"]) < 2e-6 and abs(ours[g]["p"] - r["p"]) < 2e-6
    df = spark.createDataFrame([("many", float(k % 97)) for k in range(SIZE)], "k string, v double")
    assert stats.shapiro_wilk(df, ["k"], "v").first()["w"] is None and 0 < stats.shapiro_wilk(df, ["k"], "v", None).first()["w"] < 1


def test_adaptive_test_of_large_groups(spark, large):
    ours, theirs = both(spark, large, "adaptive_test")
    assert {g: r["test"] for g, r in theirs.items()} == {"three": "wilcoxon", "normal": "ttest", "skewed": "wilcoxon"}
    for g, r in theirs.items():
        assert ours[g]["test"] == r["test"] and abs(ours[g]["stat"] - r["stat"]) < 2e-6 and abs(ours[g]["p"] - r["p"]) < 2e-6
