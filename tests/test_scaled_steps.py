"""Steps that must not grow faster than their input: what is read by one task, scanned twice or parsed again."""

import glob
import itertools

import pytest
from pyspark.sql import functions as F

from tabsight.functions import casts
from tabsight.operators import quality
from tabsight.operators.freq import value_frequencies
from tabsight.operators.stats import build_catalog
from tabsight.plans import keys_quality
from tabsight.sources import sinks


def test_csv_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    rows = [(i, f'a "{i}"\nb,{i}' if i % 3 else "", "en") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    talk = [(f"c{i}", i, f"x\n\n{i}", "user") for i in range(50)]
    spark.createDataFrame(talk, "conv_id string, turn int, text string, role string").write.parquet(f"{tmp_path}/conversations.parquet")
    parts, write = [], sinks.write_csv
    monkeypatch.setattr(sinks, "write_csv", lambda df, path: (write(df, path), parts.extend(glob.glob(f"{path.removeprefix('file:')}/part-*")))[0])
    was = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 28))   # a file a task
    try:
        got = keys_quality.q_csv_split(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", was)
    assert len(parts) > 6
    want = [(str(i), t or None, g) for i, t, g in rows] + [(f"{c}/{n}", t, r) for c, n, t, r in talk]
    assert sorted((a, b or "", c) for a, b, c in got) == sorted((a, b or "", c) for a, b, c in want)


def _tried_all(s, dayfirst):
    """``to_datetime`` as it was: every format in turn."""
    first = lambda fs: F.coalesce(*[F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz") for f in fs])
    zoned = F.convert_timezone(F.current_timezone(), F.lit("UTC"), s.try_cast("timestamp").cast("timestamp_ntz"))
    return (F.when(s.rlike(r"^\d{1,4}[-/]\d"), F.coalesce(
        first(casts.ISO_FORMATS + (casts.DAY_FIRST_FORMATS if dayfirst else casts.MONTH_FIRST_FORMATS)),
        F.when(s.rlike(casts.FRACTION_PATTERN), s.try_cast("timestamp_ntz")), F.when(s.rlike(casts.ZONE_PATTERN), zoned),
        F.when(s.rlike(casts.YEAR_SLASH_PATTERN), first(casts.YEAR_SLASH_FORMATS))))
        .when(s.rlike(casts.MONTH_NAME_PATTERN), first(casts.MONTH_NAME_FORMATS)))


@pytest.mark.parametrize("dayfirst", [True, False])
def test_dates_by_pattern_equal_all_formats_in_turn(spark, dayfirst):
    days = ["2024-01-05", "2024-1-5", "24-01-05", "2024-13-01", "5/1/2024", "05/01/2024", "0012/5/2020", "1/2/+12020", "1/2/12020", "1/-2/2020", "01/002/2024",
            "2024/1/5", "2024/01/05", "2024/5", "31/12/2023", "12/31/2023", "1/2/24", "2024-01/05", "1/2-2024", "5-Jan-2024", "5 Jan 2024", "05 January 2024",
            "Jan 5, 2024", "January 5, 2024", "Jan 5 2024", "may 5, 2024", "Foo 5, 2024", "5 Mai 2024", "30/02/2024", "", "12:00", "9999-12-31"]
    times = ["", " 10:00", " 10:00:00", "T10:00:00", "t10:00:00", " 9:05", " 9:05:07", " 24:00:00", " 10:00:00.123", "T10:00:00Z", " 10:00+02:00", " 1:2:3:4",
             " ", "\n", " 010:00", "T10:00", " 10", "x"]
    df = spark.createDataFrame([(d + t,) for d, t in itertools.product(days, times)], "t string")
    got = df.select("t", casts.to_datetime(F.col("t"), dayfirst).alias("now"), _tried_all(F.trim("t"), dayfirst).alias("was"))
    assert got.where("not now <=> was").collect() == []
    assert got.where("now is not null").count() > 60


def _formats_tried(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("gettimestamp(")


def test_type_issues_of_both_variants_share_one_pass(spark):
    df = spark.createDataFrame([(i, "x" if i % 40 == 0 else str(i), "no date" if i % 20 == 0 else f"{i % 28 + 1:02d}/03/2024") for i in range(80)],
                               "id int, amount string, order_date string")
    cat, _ = build_catalog(spark, df, "t", dayfirst=True)
    failed = quality.failed_cells(df, cat, "t", "id", dayfirst=True)
    assert sorted((r["name"], r["count"]) for r in failed.groupBy("name").count().collect()) == [("amount", 2), ("order_date", 4)]
    seen = {}
    for v in ("pipeline", "builder"):
        out = quality.type_issues(df, cat, "t", "id", v, dayfirst=True, failed=failed)
        assert _formats_tried(out) == 0   # the rows are not parsed again
        assert sorted(out.collect()) == sorted(quality.type_issues(df, cat, "t", "id", v, dayfirst=True).collect())
        seen |= {r["name"]: r["examples"] for r in out.collect()}
    assert seen["amount"] == "x|x" and seen["order_date"].startswith("no date|no date")


def test_quartiles_read_numbers_once_for_both_variants(spark):
    df = spark.createDataFrame([(float(i), str(i * 7 % 50), i % 2, "k") for i in range(60)] + [(9000.0, "n/a", 1, None)], "a double, b string, c int, d string")
    cat, fk = build_catalog(spark, df, "t")
    values = quality.numeric_values(fk, cat)
    assert dict(values.dtypes)["x"] == "double" and hasattr(values, "staged_path")
    quarters = quality.value_quartiles(values)
    for v in ("pipeline", "builder"):
        shared = quality.iqr_outliers(fk, cat, v, quartiles=quarters, values=values)
        assert "value" not in {a.split("#")[0] for a in shared._jdf.queryExecution().optimizedPlan().toString().replace("[", " ").replace(",", " ").split()}
        assert sorted(shared.collect()) == sorted(quality.iqr_outliers(fk, cat, v).collect())


def test_numbers_are_counted_as_numbers(spark):
    df = spark.sql("""SELECT * FROM VALUES (1L, 1.5D, float(0.1), timestamp'2024-01-05 10:00:00', 'x', date'2024-01-05', 1.10BD),
      (1L, -0.0D, float('NaN'), null, null, null, 1.10BD), (9007199254740993L, 0.0D, float(0.1), timestamp'2024-01-05 10:00:00.5', 'x', null, null),
      (null, double('NaN'), null, null, '', null, 2.00BD) t(l, d, f, ts, s, day, m)""")
    freq = value_frequencies(df)
    got = sorted((r["name"], r["value"] or "", r["value"] is None, r["len"], r["cnt"]) for r in freq.collect())
    cells = {"l": "cast(l as string)", "d": "cast(if(isnan(d), null, d + 0.0D) as string)", "f": "cast(if(isnan(f), null, f + 0.0D) as string)",
             "ts": "cast(ts as string)", "s": "s", "day": "cast(day as string)", "m": "cast(m as string)"}
    want = [(n, r[0] or "", r[0] is None, None if r[0] is None else len(r[0]), r[1])
            for n, e in cells.items() for r in df.selectExpr(f"{e} as v").groupBy("v").count().collect()]
    assert got == sorted(want)
    plan = freq._jdf.queryExecution().optimizedPlan().toString()
    assert "value#" in plan and any("Aggregate" in line and "cast(value#" in line for line in plan.splitlines())   # text is made behind the count
