from tabsight.operators.stats import basic_stats
from tabsight.session import scratch_path
from tabsight.sources.sinks import write_extract_observed

SCHEMA = "`a.b` double, flag string, value string, rows int, part string"


def test_counts_are_those_of_the_rows_written(spark):
    data = [(float("nan") if i % 3 == 0 else None if i % 3 == 1 else 0.5, "yes" if i % 2 else "no", None, i, "pq"[i % 2]) for i in range(101)]
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    path = scratch_path(spark, "extract")
    seen = write_extract_observed(df, path, ["part"], "t")
    assert sorted(map(tuple, seen.collect()), key=str) == sorted(map(tuple, basic_stats(df, "t").collect()), key=str)
    by = {r["name"]: r for r in seen.collect()}
    assert (by["a.b"]["missing_count"], by["value"]["is_empty"], by["flag"]["builder_bool"], by["rows"]["n_rows"]) == (68, True, True, 101)
    back = spark.read.parquet(path)
    assert back.count() == 101 and sum(r[0] != r[0] for r in back.select("`a.b`").where("`a.b` is not null").collect()) == 34


def test_empty_extract(spark):
    df = spark.createDataFrame([], SCHEMA)
    seen = write_extract_observed(df, scratch_path(spark, "extract"))
    assert [(r["n_rows"], r["missing_count"], r["is_empty"]) for r in seen.collect()] == [(0, 0, True)] * 5
