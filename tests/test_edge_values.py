import math

import pytest
from pyspark.sql import functions as F

from tabsight.functions.casts import to_datetime
from tabsight.functions.rounding import py_round
from tabsight.operators import charts, kpi, quality, stats
from tabsight.operators.profile import profile_notes, profile_report
from tabsight.session import checkpoint_dir, drop_staged, scratch_path, stage, staging
from tabsight.sources import readers, sinks


def test_csv_dialect_round_trip(spark, tmp_path):
    rows = [("1", "line1\nline2"), ("2", 'say "hi", ok'), ("3", "  lead "), ("4", "\r\n x"), ("5", None), ("6", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    back = readers.read_csv(spark, sinks.write_csv(df, str(tmp_path / "t.csv")))
    assert sorted(map(tuple, back.collect())) == [*rows[:-1], ("6", None)]   # the empty text is a null token


def test_csv_with_too_many_fields_raises(spark, tmp_path):
    p = tmp_path / "long.csv"
    p.write_text('a,b\n1,"x, y"\n3,x,EXTRA\n')
    with pytest.raises(readers.DataLoadError):
        readers.read_csv(spark, str(p))
    p.write_text("a,b\n1,x\n2\n")
    assert [tuple(r) for r in readers.read_csv(spark, str(p)).collect()] == [("1", "x"), ("2", None)]


def test_rounding_passes_large_and_odd_numbers(spark):
    vals = [1.7e18, 1.7e15, -3e300, float("inf"), float("-inf"), 0.5, 2.675]
    got = spark.createDataFrame([(v,) for v in vals], "x double").select(py_round(F.col("x"), 4).alias("r")).collect()
    assert [r["r"] for r in got] == [round(v, 4) if math.isfinite(v) else v for v in vals]
    assert math.isnan(spark.range(1).select(py_round(F.lit(float("nan")), 2).alias("r")).first()["r"])


def test_sums_of_tiny_huge_infinite_and_float_values(spark):
    df = spark.createDataFrame([(1e-9, 1e33, 1.0, 0.1), (3e-9, 2e33, float("inf"), 0.2)], "t double, h double, i double, f float")
    r = df.agg(*[charts.exact_sum(F.col(c).cast("double")).alias(c) for c in df.columns]).first()
    assert r["t"] == pytest.approx(4e-9, rel=1e-12) and r["h"] == 3e33 and r["i"] == float("inf")
    assert r["f"] == df.agg(F.sum(F.col("f").cast("double"))).first()[0]
    cat, fk = stats.build_catalog(spark, df, "t")
    means = {r["name"]: r["mean"] for r in stats.moments_from_frequencies(fk).collect()}
    assert means["t"] == pytest.approx(2e-9, rel=1e-12) and means["i"] is None
    money = spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "x double")
    assert money.agg(charts.exact_sum(F.col("x")).alias("s")).first()["s"] == 0.6


def test_long_values_are_reported_as_they_are(spark):
    a, b = "x" * 300, "y" * 300
    df = spark.createDataFrame([(a,), (a,), (b,)], "c string")
    cat, fk = stats.build_catalog(spark, df, "t")
    assert [(r["value"], r["count"]) for r in stats.topk_values(fk, 5).orderBy("rank").collect()] == [(a, 2), (b, 1)]


def test_duplicates_of_nested_columns(spark):
    df = spark.sql("""SELECT * FROM VALUES (array(1, 2), array(3), map('a', 1)), (array(1), array(2, 3), map('a', 1)),
      (array(1, NULL), array(0), map('a', 1)), (array(NULL, 1), array(0), map('a', 1)),
      (array(1, 2), array(3), map('a', 1)), (NULL, NULL, NULL), (NULL, NULL, NULL) AS t(x, y, m)""")
    for fingerprint in (True, False):
        assert stats.duplicate_rows(df, fingerprint=fingerprint).first()["duplicate_row_count"] == 2


def test_timestamp_spellings(spark):
    texts = {"2024-01-05 10:00:00.123": "2024-01-05 10:00:00.123", "2024-01-05T10:00:00Z": "2024-01-05 10:00:00", "2024-01-05T10:00:00+02:00": "2024-01-05 08:00:00",
             "2024/01/05": "2024-01-05 00:00:00", "Jan 5, 2024": "2024-01-05 00:00:00", "5 January 2024": "2024-01-05 00:00:00", "2024-01-05": "2024-01-05 00:00:00",
             "01/05/2024": "2024-01-05 00:00:00", "hello 2024": None, "12": None, "may 2024 be": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", to_datetime(F.col("t")).cast("string").alias("d")).collect()}
    assert got == texts


def test_numeric_columns_with_date_names_stay(spark):
    df = spark.createDataFrame([(2015, "05/01/2024")], "order_year int, order_date string")
    r = readers.autoparse_dates(df, ["year", "date"]).first()
    assert r["order_year"] == 2015 and r["order_date"].month == 1


def test_builder_score_needs_its_outliers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    cat, fk = stats.build_catalog(spark, df, "t")
    issues = quality.type_issues(df, cat, "t", "x")
    assert quality.quality_summary(cat, stats.duplicate_rows(df, "t"), issues).first()["quality_score_builder"] is None


def test_notes_skip_empty_columns(spark):
    df = spark.sql("SELECT id, array(id) AS a, CAST(NULL AS STRING) AS e FROM range(3)")
    cat, fk = stats.build_catalog(spark, df, "t")
    prof, _ = profile_report(df, cat, fk, "t")
    assert [(r["name"], r["note"].split(":")[0]) for r in profile_notes(prof).collect()] == [("a", "unknown")]


def test_calculated_field(spark):
    df = spark.createDataFrame([("x", 1.0, 2.0), ("x", 3.0, 2.0), ("y", 1.0, 0.0)], "k string, a double, b double")
    got = {r["k"]: r["v"] for r in kpi.calculated_field(df, "v", "SUM([a]) / SUM([b])", ["k"]).collect()}
    assert got == {"x": 1.0, "y": None}
    with pytest.raises(ValueError):
        kpi.calculated_field(df, "v", "a + b", ["k"])


def test_staged_tables_go(spark):
    import os

    kept = stage(spark.range(3), "kept")
    with staging(spark):
        inner = stage(spark.range(5), "inner")
        assert inner.count() == 5
    assert not os.path.exists(inner.staged_path) and kept.count() == 3
    drop_staged(kept)
    assert not os.path.exists(kept.staged_path)
    assert scratch_path(spark, "x").startswith(checkpoint_dir(spark))
