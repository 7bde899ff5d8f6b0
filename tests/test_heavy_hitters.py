import random
from collections import Counter

from pyspark.sql import functions as F

from tabsight.operators.heavy import heavy_hitters


def top(values, k):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))[:k]


def test_exact_with_and_without_a_proof(spark):
    r = random.Random(2)
    n = 20_000
    skew = [f"hot{r.randrange(5)}" if r.random() < 0.5 else f"v{r.randrange(10 ** 6)}" for _ in range(n)]
    flat = [f"u{i}" for i in range(n)]
    few = [None if r.random() < 0.2 else r.choice("abc") for _ in range(n)]
    df = spark.createDataFrame(list(zip(skew, flat, few, [None] * n, strict=True)), "`a.b` string, flat string, value string, name string").repartition(7)
    got, from_a0 = heavy_hitters(df, ["a.b", "flat", "value", "name"], 5, tracked=256)
    rows = {}
    for x in got.orderBy("name", "rank").collect():
        rows.setdefault(x["name"], []).append((x["value"], x["count"]))
    assert rows == {"a.b": top(skew, 5), "flat": top(flat, 5), "value": top(few, 5)}
    assert from_a0 == ["flat"]   # all values of "flat" are as frequent: no summary can tell


def test_a_tie_that_is_not_tracked_is_not_missed(spark):
    values = ["x"] * 50 + [f"t{i}" for i in range(500) for _ in range(10)]
    df = spark.createDataFrame([(v,) for v in values], "v string").orderBy(F.rand(3))
    got, _ = heavy_hitters(df, ["v"], 3, tracked=16)
    assert [(r["value"], r["count"]) for r in got.orderBy("rank").collect()] == top(values, 3)


def test_empty_table(spark):
    got, rest = heavy_hitters(spark.createDataFrame([], "v string, w double"), ["v", "w"], 3)
    assert got.collect() == [] and rest == []
