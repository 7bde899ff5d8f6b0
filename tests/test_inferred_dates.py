"""One date format per column, and the binned scatter chart."""

import datetime as dt

from tabsight.operators.charts import scatter_binned
from tabsight.operators.dates import FRACTION, ZONE, format_report, infer_formats, inferred_datetimes

ROWS = [(3, "2024-01-05", "13/01/2024", "x"), (1, " ", None, "soon"), (2, "2024-01-04 ", "2/1/2024", "2024-01-02"), (None, "1/2/2024", "2024-01-01", "x"),
        (4, "05/06/2024", "2024-03-04", "")]


def test_the_first_value_in_order_decides(spark):
    df = spark.createDataFrame(ROWS, "pos int, `a.b` string, day string, odd string")
    assert infer_formats(df, ["a.b", "day", "odd"], ["pos"], dayfirst=True) == {"a.b": "yyyy-MM-dd", "day": "d/M/yyyy", "odd": None}
    assert infer_formats(df, ["day"], ["pos"]) == {"day": "M/d/yyyy"}
    out = {r["pos"]: r for r in inferred_datetimes(df, ["a.b", "day", "odd"], ["pos"], dayfirst=True).collect()}
    assert out[4]["a.b"] is None and out[2]["a.b"] == dt.datetime(2024, 1, 4) and out[3]["day"] == dt.datetime(2024, 1, 13) and out[4]["day"] is None
    assert out[2]["odd"] == dt.datetime(2024, 1, 2) and out[1]["odd"] is None   # no format: every value may use any


def test_report_and_odd_tables(spark):
    df = spark.createDataFrame(ROWS, "pos int, `a.b` string, day string, odd string")
    got = {r["name"]: r for r in format_report(df, ["a.b", "day", "odd"], ["pos"], dayfirst=True).collect()}
    assert (got["a.b"]["n_values"], got["a.b"]["n_parsed"], got["a.b"]["examples"]) == (4, 2, "1/2/2024|05/06/2024")
    assert got["day"]["examples"] == "2024-01-01|2024-03-04" and got["odd"]["n_parsed"] == 1
    empty = format_report(df.limit(0), ["day"], ["pos"]).collect()
    assert [(r["format"], r["n_values"], r["parse_ratio"], r["examples"]) for r in empty] == [(None, 0, None, "")]
    assert infer_formats(df, [], ["pos"]) == {} and inferred_datetimes(df, [], ["pos"]).columns == df.columns
    other = spark.createDataFrame([(1, "2024-01-02 03:04:05.5", "2024-01-02T03:04:05Z", "13/01/2024")], "pos int, f string, z string, d string")
    assert infer_formats(other, ["f", "z", "d"], ["pos"]) == {"f": FRACTION, "z": ZONE, "d": "d/M/yyyy"}


def test_scatter_cells_hold_every_finite_pair(spark):
    rows = [(float(i), float(i * i)) for i in range(100)] + [(None, 1.0), (float("inf"), 2.0), (3.0, float("nan")), (-1.7e308, 1.0), (1.7e308, 1.0)]
    df = spark.createDataFrame(rows, "`x.1` double, y double")
    cells = scatter_binned(df, "x.1", "y", bins=10).collect()
    assert sum(r["count"] for r in cells) == 102 and all(0 <= r["x_bin"] < 10 and 0 <= r["y_bin"] < 10 for r in cells)
    cells = scatter_binned(df.where("abs(`x.1`) < 1000"), "x.1", "y", bins=10).collect()
    assert all(r["x_edge"] - 1e-9 <= r["x_min"] <= r["x_max"] <= r["x_edge"] + 9.9 + 1e-9 for r in cells)
    assert scatter_binned(df.limit(0), "x.1", "y").count() == 0
    same = scatter_binned(spark.createDataFrame([(2.0, 5.0)] * 3, "x double, y double"), "x", "y").collect()
    assert [(r["x_bin"], r["y_bin"], r["count"], r["x_edge"], r["y_edge"]) for r in same] == [(0, 0, 3, 2.0, 5.0)]
