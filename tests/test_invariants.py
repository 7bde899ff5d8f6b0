"""Invariants on the driver tables (sf0.001)."""

from pyspark.sql import functions as F

from tabsight.operators import quantiles
from tabsight.operators.stats import build_catalog, quartiles
from tabsight.sources.tables import dirty_orders, load

SF = "/root/testdata/sf0.001"


def test_frequency_counts_add_up(spark):
    df = dirty_orders(spark, SF)
    cat, fk = build_catalog(spark, df, "d")
    n = df.count()
    sums = fk.where(F.col("value").isNotNull()).groupBy("name").agg(F.sum("cnt").alias("s"))
    for r in cat.join(sums, "name", "left").collect():
        assert (r["s"] or 0) == n - r["missing_count"], r["name"]
        assert r["n_rows"] == n


def test_scores_in_range(spark):
    import __spark_entry__ as E

    r = E.queries()["quality_report"](spark, SF).first()
    assert 0 <= r["quality_score"] <= 100 and 0 <= r["quality_score_builder"] <= 100


def test_approx_quantiles_close_to_exact(spark):
    li = load(spark, SF, "lineitem")
    cat, fk = build_catalog(spark, li, "lineitem")
    exact = {r["name"]: r for r in quartiles(fk, ["l_extendedprice", "l_quantity"]).collect()}
    approx = quantiles.approx_quantiles(li, ["l_extendedprice", "l_quantity"], [0.25, 0.5, 0.75], table="lineitem")
    for r in approx.collect():
        e = exact[r["name"]]
        ref = {0.25: e["p25"], 0.5: e["median"], 0.75: e["p75"]}[r["q"]]
        assert abs(r["quantile"] - ref) <= 0.02 * max(abs(ref), 1.0)
