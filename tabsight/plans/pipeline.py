"""R3 and the dashboard path as user-facing compositions.

``run_pipeline``: load -> validate -> catalog -> quality -> profile.  The results are small
DataFrames over one staged A0; building them runs jobs (what a column is decides what is
computed for it).  Run it inside ``session.staging(spark)`` to remove the staged tables at the end.  ``dashboard``: roles -> KPIs -> specs ->
the data behind each spec.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import charts, kpi, profile, quality, recommend, roles
from ..operators.stats import build_catalog, column_quartiles, duplicate_rows
from ..sources.readers import read_table, validate


def run_pipeline(spark: SparkSession, path_or_df, name: str = "uploaded_dataset", order_col: str | None = None,
                 dayfirst: bool = False) -> dict[str, DataFrame]:
    """Schema, quality report and profile of one table (pipeline variant)."""
    df = read_table(spark, path_or_df) if isinstance(path_or_df, str) else path_or_df
    validate(df)
    order_col = order_col or df.columns[0]
    cat, fk = build_catalog(spark, df, name, dayfirst=dayfirst)
    dups = duplicate_rows(df, name)
    issues = quality.type_issues(df, cat, name, order_col, "pipeline", dayfirst)
    typed = [r["name"] for r in cat.where("semantic_type = 'numeric' or semantic_type_builder = 'numeric'").select("name").collect()]
    quarters = column_quartiles(df, name, typed)   # once for both fences and the profile
    outl = quality.iqr_outliers(fk, cat, "pipeline", quartiles=quarters)
    outl_b = quality.iqr_outliers(fk, cat, "builder", quartiles=quarters)
    summary = quality.quality_summary(cat, dups, issues, outl_b)
    prof, top = profile.profile_report(df, cat, fk, name, "pipeline", dayfirst, quarters)
    return {"catalog": cat, "quality": summary, "warnings": quality.quality_warnings(cat, summary, outl),
            "outliers": outl, "type_issues": issues, "profile": prof, "top_values": top}


def chart_data(df: DataFrame, spec: dict, grain: str = "month") -> DataFrame:
    """Run one chart spec (chart_type, x, y, aggregation, group_by) against its table."""
    t, x, y = spec["chart_type"], spec.get("x"), spec.get("y")
    agg = spec.get("aggregation") or "sum"
    group_by = spec.get("group_by") or []
    if t == "line":
        return charts.line_chart(df, x, y, agg, grain, [g for g in group_by if g != x])
    if t == "bar":
        return charts.bar_chart(df, x, y, agg)
    if t == "pie":
        return charts.pie_chart(df, x, y, agg)
    if t == "histogram":
        return charts.histogram(df, x)
    if t == "box":
        return charts.box_stats(df, y, x)
    if t == "scatter":
        return charts.scatter_points(df, x, y)
    if t == "heatmap":
        if x and y:
            return charts.heatmap(df, x, y, None, "count")
        from ..functions.casts import columns_of_kind
        return charts.correlation_matrix(df, columns_of_kind(df, "numeric"))
    if t == "table":
        return charts.table_chart(df, group_by or [x])
    raise ValueError(f"unknown chart type {t}")


def dashboard(spark: SparkSession, tables: dict[str, DataFrame]) -> tuple[DataFrame, dict]:
    """Specs for a catalog of tables and, for each spec, the DataFrame of its points.

    The spec list is metadata (at most ten rows per table); each chart is its own
    distributed query over the whole table.
    """
    from ..operators.stats import catalog_of_tables

    cat = catalog_of_tables(spark, tables)
    specs = recommend.recommend(recommend.rule_specs(cat))
    data = {}
    for r in specs.orderBy("table", "position").collect():
        data[(r["table"], r["position"])] = chart_data(tables[r["table"]], r.asDict())
    return specs, data


__all__ = ["run_pipeline", "chart_data", "dashboard", "roles", "kpi", "F"]
