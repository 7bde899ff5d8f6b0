"""KPI definitions from column roles, and their evaluation on the data.

Definitions are rules over the role rows (windows partitioned by table).
Evaluation runs every KPI of a table in one aggregate; comparative metrics
use GROUPING SETS so all compared dimensions share one scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import quote, name_has_any
from ..functions.constants import FORMULA_AGG_ORDER_ALT, MAX_KPI_MEASURES, MONEY_KEYWORDS
from .charts import exact_sum, line_chart, num
from .quantiles import column_quantiles
from .roles import role_position

KPI_SCHEMA = ("table string, bucket string, bucket_order int, seq int, kpi_name string, formula string, "
              "source_columns array<string>, format string, time_grain string, compare_by string")


def _b(bucket: str, order: int) -> list[Column]:
    return [F.lit(bucket).alias("bucket"), F.lit(order).alias("bucket_order")]


def kpi_definitions(roles: DataFrame, catalog: DataFrame) -> DataFrame:
    """K4: primary / secondary / trend / comparative KPI rows per table."""
    rp = role_position(roles)
    meas = rp.where((F.col("role") == "measure") & (F.col("position") <= MAX_KPI_MEASURES))
    m = F.col("name")
    money = name_has_any(F.lower(m), MONEY_KEYWORDS)
    none_s = F.lit(None).cast("string")
    primary = meas.select("table", *_b("primary_kpis", 0), F.col("position").alias("seq"),
                          F.concat(F.lit("Total "), m).alias("kpi_name"), F.concat(F.lit("SUM(["), m, F.lit("])")).alias("formula"),
                          F.array(m).alias("source_columns"), F.when(money, "$#,##0").otherwise("#,##0").alias("format"),
                          none_s.alias("time_grain"), none_s.alias("compare_by"))
    n_meas = meas.groupBy("table").agg(F.count(F.lit(1)).alias("_n"))
    first = catalog.where(F.col("ordinal") == 0).select("table", "name").join(n_meas, "table", "left")
    records = first.select("table", *_b("primary_kpis", 0), (F.coalesce("_n", F.lit(0)) + 1).cast("int").alias("seq"),
                           F.lit("Total Records").alias("kpi_name"), F.concat(F.lit("COUNT(["), m, F.lit("])")).alias("formula"),
                           F.array(m).alias("source_columns"), F.lit("#,##0").alias("format"), none_s.alias("time_grain"),
                           none_s.alias("compare_by"))
    secondary = meas.select("table", *_b("secondary_metrics", 1), F.col("position").alias("seq"),
                            F.concat(F.lit("Average "), m).alias("kpi_name"), F.concat(F.lit("AVG(["), m, F.lit("])")).alias("formula"),
                            F.array(m).alias("source_columns"), F.lit("#,##0.00").alias("format"), none_s.alias("time_grain"),
                            none_s.alias("compare_by"))
    temporal = rp.where((F.col("role") == "temporal") & (F.col("position") == 1)).select("table", F.col("name").alias("t"))
    trend = meas.where(F.col("position") <= 2).join(temporal, "table").select(
        "table", *_b("trend_metrics", 2), F.col("position").alias("seq"),
        F.concat(F.lit("Monthly "), m, F.lit(" Trend")).alias("kpi_name"), F.concat(F.lit("SUM(["), m, F.lit("])")).alias("formula"),
        F.array(F.col("t"), m).alias("source_columns"), none_s.alias("format"), F.lit("month").alias("time_grain"),
        none_s.alias("compare_by"))
    geo = rp.where(F.col("role") == "geographic").select("table", "name")
    dims = (rp.where(F.col("role") == "dimension").join(geo, ["table", "name"], "left_anti")
            .withColumn("dpos", F.row_number().over(Window.partitionBy("table").orderBy("ordinal")))
            .where(F.col("dpos") <= 3))
    main = meas.where(F.col("position") == 1).select("table", F.col("name").alias("main"))
    comp = dims.join(main, "table").select(
        "table", *_b("comparative_metrics", 3), F.col("dpos").cast("int").alias("seq"),
        F.concat(F.col("main"), F.lit(" by "), m).alias("kpi_name"), F.concat(F.lit("SUM(["), F.col("main"), F.lit("])")).alias("formula"),
        F.array(m, F.col("main")).alias("source_columns"), none_s.alias("format"), none_s.alias("time_grain"),
        m.alias("compare_by"))
    out = primary.unionByName(records).unionByName(secondary).unionByName(trend).unionByName(comp)
    return out.withColumn("seq", F.col("seq").cast("int"))


def parse_aggregation(formula: Column, order: list[str] = FORMULA_AGG_ORDER_ALT) -> Column:
    """K8 label: first aggregation keyword found in the upper-cased formula, default sum."""
    up = F.upper(F.coalesce(formula, F.lit("")))
    out = F.lit("sum")
    for kw in reversed(order):
        out = F.when(F.contains(up, F.lit(kw)), F.lit(kw.lower())).otherwise(out)
    return out


def kpi_flatten(defs: DataFrame, catalog: DataFrame) -> DataFrame:
    """K8: one list of (metric, column, aggregation); column = first source that exists.

    Comparative items carry their formula under another key in the reference, so
    their label falls back to ``sum`` and their column is the compared dimension.
    """
    ex = defs.select("table", "bucket_order", "seq", "kpi_name",
                     F.when(F.col("bucket") == "comparative_metrics", F.lit("")).otherwise(F.col("formula")).alias("formula"),
                     F.posexplode("source_columns").alias("src_pos", "column"))
    known = catalog.select("table", F.col("name").alias("column"))
    j = ex.join(known, ["table", "column"], "left_semi")
    w = Window.partitionBy("table", "bucket_order", "seq").orderBy("src_pos")
    first = j.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    w2 = Window.partitionBy("table").orderBy("bucket_order", "seq")
    return first.select("table", F.row_number().over(w2).alias("position"), F.col("kpi_name").alias("metric_name"),
                        "column", parse_aggregation(F.col("formula")).alias("aggregation"))


def calculated_field(df: DataFrame, name: str, formula: str, by: list[str]) -> DataFrame:
    """K9: a calculated field ``name`` such as ``SUM([a]) / SUM([b])`` for each value of ``by``.

    Columns stand in brackets; the aggregations are those of a KPI; one division may be its outermost
    operation and gives null where the divisor is zero.
    """
    def term(text: str) -> Column:
        m = re.fullmatch(r"\s*(SUM|AVG|COUNT|MIN|MAX)\(\[([^\]]+)\]\)\s*", text, re.I)
        if not m:
            raise ValueError(f"not an aggregation of one column: {text!r}")
        x, fn = num(df, m[2]), m[1].lower()
        return {"sum": exact_sum(x), "avg": F.try_divide(exact_sum(x), F.count(x)), "min": F.min(x), "max": F.max(x),
                "count": F.count(F.col(quote(m[2])))}[fn].cast("double")

    terms = [term(t) for t in formula.split("/")]
    if len(terms) > 2:
        raise ValueError("more than one division")
    value = terms[0] if len(terms) == 1 else F.try_divide(terms[0], terms[1])
    return df.groupBy(*by).agg(value.alias(name))


def kpi_values(flat: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """K5: evaluate every KPI of a table in one aggregate (median: exact, distributed)."""
    rows = flat.select("table", "position", "metric_name", "column", "aggregation").collect()  # bounded: few KPIs per table
    spark = flat.sparkSession
    out = None
    for t in sorted({r["table"] for r in rows}):
        df = tables[t]
        mine = [r for r in rows if r["table"] == t]
        aggs, entries = [], []
        for i, r in enumerate(mine):
            x = num(df, r["column"])
            a = r["aggregation"]
            if a == "median":
                continue
            e = {"sum": exact_sum(x), "avg": exact_sum(x) / F.count(x), "count": F.count(F.col(quote(r["column"]))),
                 "min": F.min(x), "max": F.max(x)}[a]
            aggs.append(e.cast("double").alias(f"k{i}"))
            entries.append(F.struct(F.lit(r["position"]).alias("position"), F.col(f"k{i}").alias("value")))
        part = None
        if aggs:
            part = df.agg(*aggs).select(F.inline(F.array(*entries))).select(F.lit(t).alias("table"), "position", "value")
        meds = [r for r in mine if r["aggregation"] == "median"]
        if meds:
            cells = {str(r["position"]): num(df, r["column"]) for r in meds}
            med = column_quantiles(df, cells, [0.5]).select(
                F.lit(t).alias("table"), F.col("name").cast("int").alias("position"), F.col("quantile").alias("value"))
            part = med if part is None else part.unionByName(med)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "table string, position int, metric_name string, column string, aggregation string, value double")
    return flat.join(out, ["table", "position"]).select("table", "position", "metric_name", "column", "aggregation", "value")


def trend_values(defs: DataFrame, tables: dict[str, DataFrame], grain: str = "month") -> DataFrame:
    """K6: each trend metric as a SUM per time bucket."""
    rows = defs.where(F.col("bucket") == "trend_metrics").select("table", "seq", "kpi_name", "source_columns").collect()
    out = None
    for r in rows:
        t, m = r["source_columns"][0], r["source_columns"][1]
        lc = line_chart(tables[r["table"]], t, m, "sum", grain).select(
            F.lit(r["table"]).alias("table"), F.lit(r["kpi_name"]).alias("metric_name"), "period", "value")
        out = lc if out is None else out.unionByName(lc)
    return out


def comparative_values(defs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """K7: SUM(main measure) by each compared dimension, one GROUPING SETS scan per table."""
    rows = defs.where(F.col("bucket") == "comparative_metrics").select("table", "source_columns").collect()
    per = {}
    for r in rows:
        per.setdefault(r["table"], []).append((r["source_columns"][0], r["source_columns"][1]))
    out = None
    for t, pairs in sorted(per.items()):
        df = tables[t]
        main = pairs[0][1]
        dims = [d for d, _ in pairs]
        base = df.select(num(df, main).alias("_y"), *[F.col(quote(d)).cast("string").alias(f"_d{i}") for i, d in enumerate(dims)])
        keys = [f"_d{i}" for i in range(len(dims))]
        g = base.groupingSets([[F.col(k)] for k in keys], *keys).agg(
            exact_sum(F.col("_y")).alias("value"), *[F.grouping(k).alias(f"_g{i}") for i, k in enumerate(keys)])
        which = F.lit(None).cast("string")
        cat = F.lit(None).cast("string")
        for i, d in enumerate(dims):
            which = F.when(F.col(f"_g{i}") == 0, F.lit(d)).otherwise(which)
            cat = F.when(F.col(f"_g{i}") == 0, F.col(f"_d{i}")).otherwise(cat)
        one = g.select(F.lit(t).alias("table"), F.lit(main).alias("measure"), which.alias("compare_by"),
                       cat.alias("category"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def chart_hints(roles: DataFrame) -> DataFrame:
    """Line / bar / scatter / histogram hints from role counts."""
    c = roles.groupBy("table").agg(*[F.sum((F.col("role") == r).cast("int")).alias(r) for r in
                                     ["temporal", "measure", "dimension"]])
    hints = F.array(
        F.when((F.col("temporal") > 0) & (F.col("measure") > 0), F.lit("line")),
        F.when((F.col("dimension") > 0) & (F.col("measure") > 0), F.lit("bar")),
        F.when(F.col("measure") >= 2, F.lit("scatter")),
        F.when(F.col("measure") > 0, F.lit("histogram")))
    return c.select("table", F.posexplode(F.filter(hints, lambda h: h.isNotNull())).alias("position", "chart_type"))


def dataset_overview(roles: DataFrame, catalog: DataFrame) -> DataFrame:
    """Shape, measure and temporal lists, grain text per table."""
    rp = role_position(roles)
    lists = rp.groupBy("table").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "measure", F.struct("ordinal", "name")))),
                                 lambda s: s["name"]), ",").alias("measures"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "temporal", F.struct("ordinal", "name")))),
                                 lambda s: s["name"]), ",").alias("temporal"))
    shape = catalog.groupBy("table").agg(F.max("n_rows").alias("row_count"), F.count(F.lit(1)).alias("column_count"))
    return shape.join(lists, "table").select(
        "table", "row_count", "column_count", "measures", "temporal",
        F.format_string("One row per record (%d total rows)", F.col("row_count")).alias("grain"))
