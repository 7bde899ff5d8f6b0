"""Fixtures of the reference tests, re-expressed on Spark (see FIXTURES.md)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabsight.operators import profile, quality
from tabsight.operators.stats import build_catalog, duplicate_rows


def _types(cat):
    rows = cat.orderBy("ordinal").collect()
    return [r["semantic_type"] for r in rows], [r["semantic_type_builder"] for r in rows]


def test_five_types(spark):
    rows = [(i, "a" if i <= 30 else "b", (dt.date(2024, 1, 1) + dt.timedelta(days=i - 1)).isoformat(), i % 2,
             f"row_{i}_" + "x" * 80) for i in range(1, 61)]
    df = spark.createDataFrame(rows, "num int, cat string, dt string, boolish int, text string")
    cat, _ = build_catalog(spark, df, "t")
    pipe, builder = _types(cat)
    assert pipe == ["numeric", "categorical", "datetime", "boolean", "text"]
    assert builder == ["numeric", "categorical", "datetime", "numeric", "text"]


@pytest.fixture
def quality5(spark):
    return spark.createDataFrame([(1, "A"), (2, "B"), (3, "B"), (1000, None), (1, "A")], "value int, city string")


def test_quality5_scores(spark, quality5):
    cat, fk = build_catalog(spark, quality5, "q5")
    dups = duplicate_rows(quality5, "q5")
    issues = quality.type_issues(quality5, cat, "q5", "value")
    ob = quality.iqr_outliers(fk, cat, "builder")
    s = quality.quality_summary(cat, dups, issues, ob).first()
    assert s["total_missing"] == 1 and s["missing_ratio_overall"] == 0.1
    assert s["duplicate_row_count"] == 1 and s["duplicate_row_ratio"] == 0.2
    assert s["quality_score"] == 70.0
    assert s["quality_score_builder"] == 86.0
    o = quality.iqr_outliers(fk, cat, "pipeline").where(F.col("name") == "value").first()
    assert (o["outlier_count"], o["low"], o["high"]) == (1, -2.0, 6.0)
    q = quality.quick_quality(quality5, "q5").first()
    assert q["score"] == 75.0 and q["missing_pct"] == 10.0 and q["dupe_pct"] == 20.0


def test_quick_quality_clean_and_dirty(spark):
    clean = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, "w")], "A int, B string")
    assert quality.quick_quality(clean).first()["score"] == 100.0
    dirty = spark.createDataFrame([(1.0, "x"), (1.0, "x"), (None, "y"), (3.0, "z")], "A double, B string")
    q = quality.quick_quality(dirty).first()
    assert (q["missing"], q["missing_pct"], q["dupes"], q["dupe_pct"], q["score"]) == (1, 12.5, 1, 25.0, 68.8)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "a double")
    cat, _ = build_catalog(spark, df, "t")
    assert cat.first()["missing_count"] == 2


def test_profile4(spark):
    df = spark.createDataFrame([(10, "x"), (20, "x"), (30, "y"), (40, "y")], "num int, cat string")
    cat, fk = build_catalog(spark, df, "p4")
    prof, top = profile.profile_report(df, cat, fk, "p4")
    p = {r["name"]: r for r in prof.collect()}
    n = p["num"]
    assert n["mean"] == 25.0 and abs(n["std"] - 12.909944487358056) < 1e-12
    assert (n["p25"], n["median"], n["p75"]) == (17.5, 25.0, 32.5)
    assert p["cat"]["top"] == "x" and p["cat"]["freq"] == 2 and p["cat"]["unique"] == 2


def test_score_golden_9699(spark):
    """Metadata-only golden: 9,800 x 18, 11 missing cells, one constant column -> 96.99."""
    rows = [("train", i, f"c{i}", 9800, 11 if i == 11 else 0, 1 if i == 8 else 100, False, "categorical")
            for i in range(18)]
    cat = spark.createDataFrame(rows, "table string, ordinal int, name string, n_rows long, missing_count long, "
                                      "distinct_count long, is_empty boolean, semantic_type_builder string")
    dups = spark.createDataFrame([("train", 9800, 0)], "table string, n_rows long, duplicate_row_count long")
    issues = spark.createDataFrame([], "table string, name string")
    s = quality.quality_summary(cat, dups, issues).first()
    assert s["missing_ratio_overall"] == 0.0001
    assert s["quality_score"] == 96.99


def test_validation(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "a string, b string")
    assert quality.validate_min_requirements(df).first()["status"] == "all_rows_empty"


def test_duplicates_fingerprint_matches_exact(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, 1, "x"), (1, None, None), (None, None, None), (None, None, None), (2, 3, "y")]
    df = spark.createDataFrame(rows, "a int, b int, c string")
    exact = duplicate_rows(df, fingerprint=False).first()["duplicate_row_count"]
    fp = duplicate_rows(df, fingerprint=True).first()["duplicate_row_count"]
    assert exact == fp == 2


def test_sketch_catalog_agrees_on_types(spark):
    from tabsight.operators.stats import sketch_catalog

    rows = [(i, "a" if i <= 30 else "b", (dt.date(2024, 1, 1) + dt.timedelta(days=i - 1)).isoformat(), i % 2,
             f"row_{i}_" + "x" * 80) for i in range(1, 61)]
    df = spark.createDataFrame(rows, "num int, cat string, dt string, boolish int, text string")
    exact, _ = build_catalog(spark, df, "t")
    sk = sketch_catalog(spark, df, "t")
    assert _types(sk) == _types(exact)
    e = {r["name"]: r["distinct_count"] for r in exact.collect()}
    a = {r["name"]: r["distinct_count"] for r in sk.collect()}
    assert all(abs(a[k] - e[k]) <= max(1, 0.05 * e[k]) for k in e)
