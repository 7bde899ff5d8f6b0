"""Metadata-only goldens (FIXTURES.md section 3): the stored catalog of the 9,800 x 18 retail table."""

from pyspark.sql import functions as F

from tabsight.operators import kpi, recommend, roles

RETAIL = [  # name, physical kind, distinct, missing, builder type
    ("Row ID", "numeric", 9800, 0, "numeric"), ("Order ID", "string", 4922, 0, "text"),
    ("Order Date", "string", 1230, 0, "text"), ("Ship Date", "string", 1326, 0, "text"),
    ("Ship Mode", "string", 4, 0, "categorical"), ("Customer ID", "string", 793, 0, "text"),
    ("Customer Name", "string", 793, 0, "text"), ("Segment", "string", 3, 0, "categorical"),
    ("Country", "string", 1, 0, "categorical"), ("City", "string", 529, 0, "text"),
    ("State", "string", 49, 0, "categorical"), ("Postal Code", "numeric", 626, 11, "numeric"),
    ("Region", "string", 4, 0, "categorical"), ("Product ID", "string", 1861, 0, "text"),
    ("Category", "string", 3, 0, "categorical"), ("Sub-Category", "string", 17, 0, "categorical"),
    ("Product Name", "string", 1849, 0, "text"), ("Sales", "numeric", 5757, 0, "numeric"),
]
RANGES = {"Row ID": (1.0, 9800.0), "Postal Code": (1040.0, 99301.0), "Sales": (0.444, 22638.48)}


def _catalog(spark):
    rows = [("train", i, n, k, 9800, d, m, RANGES.get(n, (None, None))[0], RANGES.get(n, (None, None))[1], b, b)
            for i, (n, k, d, m, b) in enumerate(RETAIL)]
    return spark.createDataFrame(rows, "table string, ordinal int, name string, kind string, n_rows long, distinct_count long, "
                                       "missing_count long, num_min double, num_max double, semantic_type_builder string, "
                                       "semantic_type string")


def test_roles_golden(spark):
    rl = roles.column_roles(_catalog(spark))
    got = {}
    for r in rl.collect():
        got.setdefault(r["role"], []).append((r["ordinal"], r["name"]))
    names = {k: [n for _, n in sorted(v)] for k, v in got.items()}
    assert names["identifier"] == ["Row ID", "Order ID"]
    assert names["temporal"] == ["Order Date", "Ship Date"]
    assert names["geographic"] == ["Country", "City", "State", "Postal Code", "Region"]
    assert names["measure"] == ["Sales"]
    assert "Customer ID" in names["dimension"] and "Country" in names["dimension"]


def test_kpi_golden(spark):
    cat = _catalog(spark)
    d = kpi.kpi_definitions(roles.column_roles(cat), cat)
    comp = [r["compare_by"] for r in d.where(F.col("bucket") == "comparative_metrics").orderBy("seq").collect()]
    assert comp == ["Ship Mode", "Customer ID", "Customer Name"]
    prim = [(r["kpi_name"], r["format"]) for r in d.where(F.col("bucket") == "primary_kpis").orderBy("seq").collect()]
    assert prim == [("Total Sales", "$#,##0"), ("Total Records", "#,##0")]
    trend = [r["kpi_name"] for r in d.where(F.col("bucket") == "trend_metrics").collect()]
    assert trend == ["Monthly Sales Trend"]


def test_recommendation_golden(spark):
    rec = recommend.recommend(recommend.rule_specs(_catalog(spark))).orderBy("position").collect()
    kinds = [r["chart_type"] for r in rec]
    assert kinds == ["bar", "bar", "histogram", "histogram", "scatter", "scatter", "scatter", "pie", "pie", "box"]
    assert "heatmap" not in kinds
    assert rec[0]["title"] == "Row ID by Ship Mode" and rec[-1]["title"] == "Row ID by Ship Mode"
    assert [(r["grid_row"], r["grid_col"]) for r in rec[:3]] == [(0, 0), (0, 1), (1, 0)]
