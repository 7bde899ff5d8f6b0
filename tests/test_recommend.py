"""Recommender fixtures (builder types, rules V1-V6)."""

import datetime as dt

from pyspark.sql import functions as F

from tabsight.operators import recommend
from tabsight.operators.stats import catalog_of_tables


def _charts(spark, df):
    cat = catalog_of_tables(spark, {"t": df})
    r = recommend.recommend(recommend.rule_specs(cat)).orderBy("position").collect()
    return [(x["chart_type"], x["aggregation"]) for x in r]


def test_rec_cat(spark):
    df = spark.createDataFrame([("ABC"[i % 3], 10 * (1 + i % 6)) for i in range(60)], "category string, sales int")
    assert [c for c, _ in _charts(spark, df)] == ["bar", "pie", "histogram", "box"]


def test_rec_num_gets_table(spark):
    df = spark.createDataFrame([(5 * i,) for i in range(100)], "sales int")
    assert [c for c, _ in _charts(spark, df)] == ["histogram", "table"]


def test_rec_rel(spark):
    df = spark.createDataFrame([(i, 2 * i, 3 * i) for i in range(100)], "x int, y int, z int")
    assert [c for c, _ in _charts(spark, df)] == ["histogram", "histogram", "scatter", "scatter", "scatter", "heatmap"]


def test_rec_time(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(base + dt.timedelta(days=i), i) for i in range(50)], "date timestamp_ntz, sales int")
    assert _charts(spark, df) == [("line", "sum"), ("histogram", None)]


def test_rec_highcard_is_text(spark):
    df = spark.createDataFrame([(f"C{i}", i) for i in range(100)], "category string, sales int")
    assert [c for c, _ in _charts(spark, df)] == ["histogram", "table"]


def test_guess_aggregation(spark):
    df = spark.createDataFrame([("conversion_rate", 0.5, 0.6), ("units", 0.0, 1.0), ("revenue", 3.0, 9.0),
                                ("total_qty", 0.0, 1.0)], "name string, lo double, hi double")
    out = [r[0] for r in df.select(recommend.guess_aggregation(F.col("name"), F.col("lo"), F.col("hi"))).collect()]
    assert out == ["avg", "avg", "sum", "sum"]


def test_dashboard_runs_every_spec(spark):
    from tabsight.plans.pipeline import dashboard

    df = spark.createDataFrame([("ABC"[i % 3], 10 * (1 + i % 6), i * 0.5) for i in range(60)], "category string, sales int, w double")
    specs, data = dashboard(spark, {"t": df})
    assert len(data) == specs.count() >= 4
    for k, d in data.items():
        assert d.count() > 0, k


def test_run_pipeline(spark):
    from tabsight.plans.pipeline import run_pipeline

    df = spark.createDataFrame([(1, "A"), (2, "B"), (3, "B"), (1000, None), (1, "A")], "value int, city string")
    out = run_pipeline(spark, df, "q5")
    assert out["quality"].first()["quality_score"] == 70.0
    assert out["profile"].count() == 2
