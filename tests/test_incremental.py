import math
import random
import statistics

import pytest

from pyspark.sql import functions as F

from tabsight.operators.incremental import LOG_CELLS, add_part, merged_catalog, part_state
from tabsight.operators.stats import build_catalog
from tabsight.session import scratch_path

SCHEMA = "id long, `a.b` double, name string, flag string, day string, day2 date, same double, `none` string"
EXACT = ["ordinal", "dtype_raw", "kind", "n_rows", "missing_count", "non_null", "min_len", "max_len", "num_parsed", "dt_parsed",
         "num_min", "num_max", "dt_min", "dt_max", "avg_len", "is_empty", "semantic_type", "semantic_type_builder"]


def rows(n, seed):
    r = random.Random(seed)
    return [(r.randrange(10 ** 9), None if r.random() < 0.1 else r.choice([r.gauss(5, 2), float("nan")]), r.choice(["x", "yy", "zzz", None]),
             r.choice(["yes", "no"]), r.choice(["2024-01-05", "2023-02-01", "soon"]), None, 0.1, None) for _ in range(n)]


def by_name(df):
    return {r["name"]: r.asDict() for r in df.collect()}


def test_merge_of_parts_is_the_catalog_of_the_union(spark):
    path, parts = scratch_path(spark, "states"), {f"p{i}": rows(n, i) for i, n in enumerate([3000, 1, 0])}
    for p, data in parts.items():
        add_part(spark.createDataFrame(data, SCHEMA).repartition(3), path, "t", p)
    add_part(spark.createDataFrame(parts["p1"], SCHEMA), path, "t", "p1")   # a repeated load counts once
    union = [r for data in parts.values() for r in data]
    want, _ = build_catalog(spark, spark.createDataFrame(union, SCHEMA), "t")
    got, want = by_name(merged_catalog(spark, path, "t")), by_name(want)
    assert list(sorted(got)) == list(sorted(want))
    for c, w in want.items():
        assert {k: got[c][k] for k in EXACT} == {k: w[k] for k in EXACT}, c
        assert got[c]["n_parts"] == 3
        assert abs(got[c]["distinct_count"] - w["distinct_count"]) <= 4 * 1.04 / math.sqrt(2 ** LOG_CELLS) * w["distinct_count"]
        if w["distinct_count"] <= 50:
            assert got[c]["distinct_count"] == w["distinct_count"]
    x = sorted(r[1] for r in union if r[1] is not None and not math.isnan(r[1]))
    g = got["a.b"]
    assert g["num_count"] == len(x)
    assert g["num_mean"] == pytest.approx(statistics.fmean(x)) and g["num_std"] == pytest.approx(statistics.stdev(x))
    for q, a in ((0.25, "p25"), (0.5, "median"), (0.75, "p75")):
        assert abs(sum(v <= g[a] for v in x) / len(x) - q) < 0.01
    assert got["same"]["num_std"] == 0.0 and got["same"]["num_mean"] == 0.1


def test_only_the_increment_and_the_states_are_read(spark):
    base, path = scratch_path(spark, "base"), scratch_path(spark, "states")
    spark.range(100).select(F.col("id"), F.lit(1).alias("load")).write.parquet(f"{base}/load=1")
    spark.range(50).select(F.col("id"), F.lit(2).alias("load")).write.parquet(f"{base}/load=2")
    add_part(spark.read.parquet(f"{base}/load=1"), path, "t", "1")
    new = spark.read.parquet(f"{base}/load=2")
    assert all("load=2" in f for f in new.inputFiles())
    plan = part_state(new)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "load=1" not in plan
    add_part(new, path, "t", "2")
    merged = merged_catalog(spark, path, "t")
    assert all("staged-states" in f for f in merged.inputFiles())
    got = by_name(merged)["id"]
    assert (got["n_rows"], got["num_max"], got["distinct_count"]) == (150, 99.0, 100)


def test_new_columns_changed_kinds_and_names(spark):
    path = scratch_path(spark, "states")
    add_part(spark.createDataFrame([(1,), (2,)], "a int"), path, "t", "1")
    add_part(spark.createDataFrame([("u", 3)], "b string, a int"), path, "t", "2")
    got = by_name(merged_catalog(spark, path, "t"))
    assert [got[c][k] for c in "ab" for k in ("n_rows", "missing_count", "ordinal")] == [3, 0, 1, 3, 2, 0]
    with pytest.raises(ValueError, match="a: numeric, now string"):
        add_part(spark.createDataFrame([("x",)], "a string"), path, "t", "3")
    assert by_name(merged_catalog(spark, path, "t"))["a"]["n_rows"] == 3
    with pytest.raises(ValueError, match="plain name"):
        add_part(spark.createDataFrame([(1,)], "a int"), path, "t", "x/y")
    with pytest.raises(ValueError, match="no part"):
        merged_catalog(spark, path, "unknown")
