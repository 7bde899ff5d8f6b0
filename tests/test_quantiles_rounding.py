import random

import numpy as np
from pyspark.sql import functions as F

from tabsight.functions.rounding import py_round
from tabsight.operators.quantiles import quantile_columns, weighted_quantiles


import pytest


def test_weighted_quantiles_match_numpy(spark):
    rnd = random.Random(7)
    groups = {f"g{k}": [rnd.choice([rnd.randint(0, 20), rnd.uniform(-5, 5)]) for _ in range(rnd.randint(1, 300))]
              for k in range(6)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, x double")
    freq = df.groupBy("g", "x").agg(F.count(F.lit(1)).alias("cnt"))
    q = quantile_columns(weighted_quantiles(freq, ["g"], [0.25, 0.5, 0.75]), ["g"],
                         {0.25: "a", 0.5: "b", 0.75: "c"})
    got = {r["g"]: (r["a"], r["b"], r["c"]) for r in q.collect()}
    for g, vs in groups.items():
        exp = np.quantile(np.array(vs), [0.25, 0.5, 0.75])
        assert np.allclose(got[g], exp, rtol=0, atol=1e-12), g


def test_py_round_matches_python(spark):
    vals = [756589.96125, 0.0499185, 2.675, 0.03125, -0.03125, 1.5, 2.5, -2.5, 68.75, 0.12345]
    rnd = random.Random(3)
    vals += [rnd.uniform(-1e4, 1e4) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for r in df.select("x", py_round(F.col("x"), 4).alias("r4"), py_round(F.col("x"), 1).alias("r1")).collect():
        assert r["r4"] == round(r["x"], 4) and r["r1"] == round(r["x"], 1)


def test_kpi_values_medians_in_one_pass(spark):
    from tabsight.operators.kpi import kpi_values

    rnd = random.Random(11)
    rows = [(float(rnd.randint(0, 50)), rnd.uniform(-10, 10) if i % 7 else None, f"c{i % 3}") for i in range(997)]
    df = spark.createDataFrame(rows, "a double, b double, c string")
    flat = spark.createDataFrame(
        [("t", 1, "Median A", "a", "median"), ("t", 2, "Total A", "a", "sum"), ("t", 3, "Median B", "b", "median"),
         ("t", 4, "Rows", "c", "count")],
        "table string, position int, metric_name string, column string, aggregation string")
    got = {r["position"]: r["value"] for r in kpi_values(flat, {"t": df}).collect()}
    a = np.array([r[0] for r in rows])
    b = np.array([r[1] for r in rows if r[1] is not None])
    assert got[1] == pytest.approx(float(np.median(a)), abs=1e-12)
    assert got[2] == pytest.approx(float(a.sum()), abs=1e-6)
    assert got[3] == pytest.approx(float(np.median(b)), abs=1e-12)
    assert got[4] == 997


def test_quantiles_hot_group_across_ranges(spark):
    # one group holds a third of all rows (and one value a third of that group); the
    # range-partitioned path must split it over several ranges and stay exact
    rnd = random.Random(5)
    groups = {"hot": [7.0] * 1000 + [rnd.uniform(0, 100) for _ in range(2000)]}
    for k in range(6):
        groups[f"g{k}"] = [rnd.uniform(-50, 50) for _ in range(1000)]
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, x double").repartition(8)
    freq = df.groupBy("g", "x").agg(F.count(F.lit(1)).alias("cnt"))
    q = quantile_columns(weighted_quantiles(freq, ["g"], [0.1, 0.5, 0.9]), ["g"],
                         {0.1: "a", 0.5: "b", 0.9: "c"})
    got = {r["g"]: (r["a"], r["b"], r["c"]) for r in q.collect()}
    for g, vs in groups.items():
        assert np.allclose(got[g], np.quantile(np.array(vs), [0.1, 0.5, 0.9]), rtol=0, atol=1e-9), g
