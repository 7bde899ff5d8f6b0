"""Exact quantiles by refinement, names that have to be quoted, null groups, infinities, empty tables."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.operators import charts, quality, stats
from tabsight.operators.quantiles import _key, approx_quantiles, column_quantiles, refined_quantiles, with_order_key


def doubles(n, seed=1):
    r = random.Random(seed)
    out = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 1 - 2**-53, 1 + 2**-52, 1.7976931348623157e308, -1e300]
    out += [s * f(2.0 ** e) for e in range(-1074, 1024, 7) for s in (1, -1) for f in (float, lambda v: float(np.nextafter(v, 0)))]
    while len(out) < n:
        v = struct.unpack("d", r.getrandbits(64).to_bytes(8, "big"))[0]
        if v == v and abs(v) < 1e300:
            out.append(v)
    return out


def test_order_key_is_the_place_among_all_doubles(spark):
    vals = [*doubles(3000), math.inf, -math.inf]
    df = with_order_key(spark.createDataFrame([(v,) for v in vals], "x double"), "x", "k")
    for r in df.collect():
        want = struct.unpack("q", struct.pack("d", abs(r["x"])))[0]
        assert r["k"] == (-want if r["x"] < 0 else want) == _key(r["x"])


@pytest.mark.parametrize("values", ["spread", "ties", "close"])
def test_groups_and_columns_equal_numpy(spark, values):
    r = random.Random(4)
    x = {"spread": [v for v in doubles(2000) if abs(v) < 1e299], "ties": [r.choice([1.5, 2.0, -3.0]) for _ in range(900)],
         "close": [1.0 + r.randrange(5000) * 2**-52 for _ in range(3000)]}[values]
    rows = [(v, None if i % 3 else "a.b", 1 + i % 2) for i, v in enumerate(x)] + [(None, "a.b", 1), (math.nan, None, 1)]
    df = spark.createDataFrame(rows, "`x.y` double, `g``1` string, c int")
    qs = [0, 0.1, 0.25, 0.5, 0.99, 1]
    got = {(r["g`1"], r["q"]): r["quantile"] for r in refined_quantiles(df, ["g`1"], qs, "x.y").collect()}
    weighted = {r["q"]: r["quantile"] for r in refined_quantiles(df, [], qs, "x.y", "c").collect()}
    alone = {r["q"]: r["quantile"] for r in column_quantiles(df, {"it": F.col("`x.y`"), "none": F.lit(None)}, qs).where("name = 'it'").collect()}
    twice = [v for i, v in enumerate(x) for _ in range(1 + i % 2)]
    for q in qs:
        for g in ("a.b", None):
            assert got[g, q] == pytest.approx(np.quantile([v for i, v in enumerate(x) if (i % 3 == 0) == (g is not None)], q), rel=1e-12, abs=0)
        assert weighted[q] == pytest.approx(np.quantile(twice, q), rel=1e-12, abs=0)
        assert alone[q] == pytest.approx(np.quantile(x, q), rel=1e-12, abs=0)


def test_plan_shuffles_counts_only(spark):
    df = spark.range(100_000).select((F.col("id") * 7 % 99_991).cast("double").alias("x"), (F.col("id") % 2).alias("g"))
    for q in (refined_quantiles(df, ["g"], [0.5]), column_quantiles(df, {"x": F.col("x")}, [0.5])):
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan.lower() and "CartesianProduct" not in plan
    assert {r["g"]: r["quantile"] for r in refined_quantiles(df, ["g"], [0.5]).collect()} == {
        g: float(np.median([i * 7 % 99_991 for i in range(g, 100_000, 2)])) for g in (0, 1)}


def test_empty_and_one_value(spark):
    none = spark.createDataFrame([], "g string, x double")
    assert refined_quantiles(none, ["g"], [0.5]).collect() == [] and column_quantiles(none, {"x": F.col("x")}, [0.5]).collect() == []
    one = spark.createDataFrame([("g", 3.0)], "g string, x double")
    assert refined_quantiles(one, ["g"], [0.1]).collect()[0]["quantile"] == 3.0


ODD = "`Sales.Amount` double, `a``b` string, x double, count string, q long, value string"


def test_statistics_of_odd_names(spark):
    rows = [(float(i), f"v{i % 3}", float(i % 7), None if i % 4 == 0 else f"c{i % 2}", i, "same") for i in range(40)]
    df = spark.createDataFrame(rows, ODD)
    cat, fk = stats.build_catalog(spark, df, "t")
    got = {r["name"]: (r["n_rows"], r["distinct_count"]) for r in cat.collect()}
    assert got == {"Sales.Amount": (40, 40), "a`b": (40, 3), "x": (40, 7), "count": (40, 2), "q": (40, 40), "value": (40, 1)}
    assert {r["name"] for r in stats.first_values(df, "Sales.Amount", 2).collect()} == set(df.columns)
    assert {r["name"] for r in approx_quantiles(df, ["Sales.Amount", "x"], [0.5]).collect()} == {"Sales.Amount", "x"}
    assert {r["name"] for r in stats.column_quartiles(df, "t", ["Sales.Amount", "q"]).collect()} == {"Sales.Amount", "q"}
    bounds = spark.createDataFrame([("t", "x", 0.0, 5.0)], "table string, name string, low double, high double")
    assert quality.outlier_rows(df, bounds, "t", "Sales.Amount").count() == sum(i % 7 > 5 for i in range(40))


@pytest.mark.parametrize("by", ["count", "a`b", "q", "value"])
def test_boxes_of_odd_groups(spark, by):
    rows = [(float(i * i), f"v{i % 3}", 0.0, None if i % 4 == 0 else f"c{i % 2}", i % 5, "same") for i in range(40)]
    df = spark.createDataFrame(rows, ODD)
    got = {r[0]: (r[1], r[4]) for r in charts.box_stats(df, "Sales.Amount", by).collect()}
    want = {}
    for r in rows:
        want.setdefault(r[{"count": 3, "a`b": 1, "q": 4, "value": 5}[by]], []).append(r[0])
    assert got == {(None if k is None else str(k)): (len(v), float(np.median(v))) for k, v in want.items()}


def test_null_groups_and_two_series(spark):
    df = spark.createDataFrame([(None, 5.0, "2024-01-02", "u"), (None, 7.0, "2024-01-03", "v"), ("a", 1.0, "2024-02-02", "u")],
                               "g string, y double, d string, h string")
    assert {r["category"]: r["value"] for r in charts.bar_chart(df, "g", "y", "median").collect()} == {None: 6.0, "a": 1.0}
    got = charts.line_chart(df, "d", "y", "median", "month", ["g", "h"])
    assert got.columns == ["period", "series", "series_2", "value"]
    assert {(r[1], r[2], r[3]) for r in got.collect()} == {(None, "u", 5.0), (None, "v", 7.0), ("a", "u", 1.0)}


def test_infinite_and_very_wide_values(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, 3.0, math.inf, -math.inf, math.nan, None]], "x double")
    got = charts.histogram(df, "x", 2).orderBy("bin").collect()
    assert [(r["bin_low"], r["bin_high"], r["count"]) for r in got] == [(1.0, 2.0, 1), (2.0, 3.0, 2)]
    box = charts.box_stats(df, "x").first()
    assert (box["count"], box["min"], box["median"], box["max"]) == (3, 1.0, 2.0, 3.0)
    wide = charts.histogram(spark.createDataFrame([(-1.7e308,), (0.0,), (1.7e308,)], "x double"), "x", 2).orderBy("bin").collect()
    assert [(r["bin_low"], r["bin_high"], r["count"]) for r in wide] == [(-1.7e308, 0.0, 1), (0.0, 1.7e308, 2)]


def test_catalog_of_an_empty_table(spark):
    cat, _ = stats.build_catalog(spark, spark.createDataFrame([], "a string, b double"), "t")
    assert {(r["name"], r["kind"], r["n_rows"], r["missing_count"], r["distinct_count"], r["is_empty"]) for r in cat.collect()} == {
        ("a", "string", 0, 0, 0, True), ("b", "numeric", 0, 0, 0, True)}
