"""Chart recommendation rules over a catalog of tables.

Each rule is a DataFrame expression over the catalog (one row per column);
every window is partitioned by ``table`` so thousands of tables are one job.
Spec rows: table, rule_no, seq, chart_type, title, x, y, aggregation,
group_by (array), confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import name_has_any
from ..functions.constants import (
    AVG_HINTS, GROUPING_MAX_DISTINCT, GROUPING_MIN_DISTINCT, GROUPING_TARGET_DISTINCT, GROUPING_UNKNOWN_SCORE, HIGH_CARDINALITY_LIMIT,
    MAX_PIE_CATEGORIES, MAX_VISUALIZATIONS_DEFAULT, MAX_VISUALS, MIN_ROWS_FOR_SCATTER, SUM_HINTS, TREND_EXCLUDE_KEYWORDS,
    FORMULA_AGG_ORDER,
)

SPEC_COLS = ["table", "rule_no", "seq", "chart_type", "title", "x", "y", "aggregation", "group_by", "confidence"]


def _null_s():
    return F.lit(None).cast("string")


def _null_a():
    return F.lit(None).cast("array<string>")


def typed(catalog: DataFrame, type_col: str, t: str) -> DataFrame:
    """Columns of one semantic type with their position (1-based, by ordinal) per table."""
    w = Window.partitionBy("table").orderBy("ordinal")
    return (catalog.where(F.col(type_col) == t)
            .select("table", "ordinal", "name", "distinct_count", "num_min", "num_max")
            .withColumn("pos", F.row_number().over(w)))


def guess_aggregation(name: Column, vmin: Column, vmax: Column) -> Column:
    """V7: avg-hint name -> avg; sum-hint -> sum; values inside [0, 1] -> avg; else sum."""
    lc = F.lower(name)
    return (F.when(name_has_any(lc, AVG_HINTS), "avg").when(name_has_any(lc, SUM_HINTS), "sum")
            .when(vmin.isNotNull() & vmax.isNotNull() & (vmin >= 0) & (vmax <= 1), "avg").otherwise("sum"))


def distinct_lookup(catalog: DataFrame, profiles: DataFrame) -> DataFrame:
    """V9: the catalog with the distinct count of a column's profile where that has one, else its own."""
    p = profiles.select("table", "name", F.col("unique").alias("_profiled"))
    return (catalog.join(p, ["table", "name"], "left")
            .withColumn("distinct_count", F.coalesce("_profiled", "distinct_count")).drop("_profiled"))


def grouping_column(cats: DataFrame) -> DataFrame:
    """V8: categorical column with 2..12 distinct values closest to 5, first wins ties; an unknown count is as far as 10."""
    n = F.col("distinct_count")
    ok = cats.where(n.isNull() | n.between(GROUPING_MIN_DISTINCT, GROUPING_MAX_DISTINCT))
    far = F.coalesce(F.abs(n - GROUPING_TARGET_DISTINCT), F.lit(GROUPING_UNKNOWN_SCORE))
    w = Window.partitionBy("table").orderBy(far, "pos")
    return ok.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select("table", F.col("name").alias("group_col"))


def _spec(df: DataFrame, rule_no: int, seq: Column, chart: str, title: Column, x: Column, y: Column, agg: Column,
          group_by: Column, conf: float) -> DataFrame:
    return df.select("table", F.lit(rule_no).alias("rule_no"), seq.cast("int").alias("seq"), F.lit(chart).alias("chart_type"),
                     title.alias("title"), x.alias("x"), y.alias("y"), agg.alias("aggregation"), group_by.alias("group_by"),
                     F.lit(conf).alias("confidence"))


def rule_specs(catalog: DataFrame, type_col: str = "semantic_type_builder") -> DataFrame:
    """V1-V5 in rule order (before the top-k trim)."""
    num = typed(catalog, type_col, "numeric")
    cat = typed(catalog, type_col, "categorical")
    dt = typed(catalog, type_col, "datetime")
    txt = typed(catalog, type_col, "text")
    grp = grouping_column(cat)
    rows = catalog.groupBy("table").agg(F.max("n_rows").alias("n_rows"))
    n_num = num.groupBy("table").agg(F.count(F.lit(1)).alias("n_num"))
    agg_of = guess_aggregation(F.col("name"), F.col("num_min"), F.col("num_max"))

    # V1 time series: first datetime x first 3 numerics
    dt0 = dt.where(F.col("pos") == 1).select("table", F.col("name").alias("t"))
    v1 = (num.where(F.col("pos") <= 3).join(dt0, "table").join(grp, "table", "left"))
    v1 = _spec(v1, 1, F.col("pos"), "line", F.concat(F.col("name"), F.lit(" over time")), F.col("t"), F.col("name"),
               agg_of, F.when(F.col("group_col").isNotNull(), F.array("group_col")), 0.85)

    # V2 categorical: first 2 categoricals x first numeric; bar, plus pie for 2..7 values
    n0 = num.where(F.col("pos") == 1).select("table", F.col("name").alias("m"), agg_of.alias("agg"))
    c2 = cat.where((F.col("pos") <= 2) & (F.col("distinct_count") <= HIGH_CARDINALITY_LIMIT)).join(n0, "table")
    bar = _spec(c2, 2, F.col("pos") * 2, "bar", F.concat(F.col("m"), F.lit(" by "), F.col("name")), F.col("name"),
                F.col("m"), F.col("agg"), _null_a(), 0.80)
    pie = _spec(c2.where((F.col("distinct_count") >= 2) & (F.col("distinct_count") <= MAX_PIE_CATEGORIES)), 2,
                F.col("pos") * 2 + 1, "pie", F.concat(F.col("m"), F.lit(" share by "), F.col("name")), F.col("name"),
                F.col("m"), F.col("agg"), _null_a(), 0.65)

    # V3 distributions: histograms of the first 2 numerics, box of the first numeric by the grouping column
    hist = _spec(num.where(F.col("pos") <= 2), 3, F.col("pos"), "histogram", F.concat(F.lit("Distribution of "), F.col("name")),
                 F.col("name"), _null_s(), _null_s(), _null_a(), 0.70)
    box_src = num.where(F.col("pos") == 1).join(grp, "table")
    box = _spec(box_src, 3, F.lit(10), "box", F.concat(F.col("name"), F.lit(" by "), F.col("group_col")), F.col("group_col"),
                F.col("name"), _null_s(), F.array("group_col"), 0.65)

    # V4 relationships: first 3 column pairs (theta self-join on position), heatmap when >= 3 numerics
    elig = n_num.join(rows, "table").where((F.col("n_num") >= 2) & (F.col("n_rows") >= MIN_ROWS_FOR_SCATTER)).select("table")
    # the first three combinations only ever use the first four numeric columns
    a = num.where(F.col("pos") <= 3).select("table", F.col("pos").alias("pa"), F.col("name").alias("xa"))
    b = num.where(F.col("pos") <= 4).select("table", F.col("pos").alias("pb"), F.col("name").alias("yb"))
    pairs = a.join(b, "table").where(F.col("pa") < F.col("pb")).join(elig, "table", "left_semi")
    pairs = pairs.withColumn("k", F.row_number().over(Window.partitionBy("table").orderBy("pa", "pb"))).where(F.col("k") <= 3)
    scatter = _spec(pairs, 4, F.col("k"), "scatter", F.concat(F.col("yb"), F.lit(" vs "), F.col("xa")), F.col("xa"),
                    F.col("yb"), _null_s(), _null_a(), 0.68)
    heat_src = n_num.join(elig, "table", "left_semi").where(F.col("n_num") >= 3)
    heat = _spec(heat_src, 4, F.lit(10), "heatmap", F.lit("Correlation matrix"), _null_s(), _null_s(), _null_s(), _null_a(), 0.60)

    specs = v1.unionByName(bar).unionByName(pie).unionByName(hist).unionByName(box).unionByName(scatter).unionByName(heat)

    # V5 table fallback when fewer than two visuals
    counts = specs.groupBy("table").agg(F.count(F.lit(1)).alias("_n"))
    few = catalog.select("table").distinct().join(counts.where(F.col("_n") >= 2), "table", "left_anti")
    order = (cat.select("table", F.lit(0).alias("src"), "pos", "name")
             .unionByName(num.select("table", F.lit(1).alias("src"), "pos", "name"))
             .unionByName(dt.select("table", F.lit(2).alias("src"), "pos", "name"))
             .unionByName(txt.select("table", F.lit(3).alias("src"), "pos", "name")))
    tc = order.withColumn("k", F.row_number().over(Window.partitionBy("table").orderBy("src", "pos"))).where(F.col("k") <= 5)
    tcl = tc.join(few, "table", "left_semi").groupBy("table").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "name"))), lambda s: s["name"]).alias("cols"))
    table_spec = _spec(tcl, 5, F.lit(1), "table", F.lit("Data summary"), F.element_at("cols", 1), _null_s(), _null_s(),
                       F.col("cols"), 0.50)
    return specs.unionByName(table_spec)


def recommend(specs: DataFrame, max_visuals: int = MAX_VISUALS) -> DataFrame:
    """V6: keep rule order; only when a table has more than ``max_visuals`` specs, a stable
    sort by confidence keeps the top ones.  Adds position and 2-column grid cells."""
    w_rule = Window.partitionBy("table").orderBy("rule_no", "seq")
    s = specs.withColumn("_ord", F.row_number().over(w_rule))
    n = s.groupBy("table").agg(F.count(F.lit(1)).alias("_n"))
    s = s.join(n, "table")
    w_conf = Window.partitionBy("table").orderBy(F.desc("confidence"), "_ord")
    s = s.withColumn("_rank", F.row_number().over(w_conf))
    kept = s.where((F.col("_n") <= max_visuals) | (F.col("_rank") <= max_visuals))
    pos = F.when(F.col("_n") <= max_visuals, F.col("_ord")).otherwise(F.col("_rank")) - 1
    return kept.select(*SPEC_COLS, pos.alias("position")).select(
        *SPEC_COLS, "position", F.floor(F.col("position") / 2).alias("grid_row"), (F.col("position") % 2).alias("grid_col"))


def baseline_spec(catalog: DataFrame, type_col: str = "semantic_type") -> DataFrame:
    """At most line 0.80, histogram 0.75, scatter 0.70, bar 0.72, in this order."""
    num = typed(catalog, type_col, "numeric")
    cat = typed(catalog, type_col, "categorical")
    dt = typed(catalog, type_col, "datetime")
    n0 = num.where(F.col("pos") == 1).select("table", F.col("name").alias("n0"))
    n1 = num.where(F.col("pos") == 2).select("table", F.col("name").alias("n1"))
    d0 = dt.where(F.col("pos") == 1).select("table", F.col("name").alias("d0"))
    c0 = cat.where(F.col("pos") == 1).select("table", F.col("name").alias("c0"))
    line = _spec(n0.join(d0, "table"), 1, F.lit(1), "line", F.concat(F.col("n0"), F.lit(" over time")), F.col("d0"), F.col("n0"),
                 F.lit("sum"), _null_a(), 0.80)
    hist = _spec(n0, 1, F.lit(2), "histogram", F.concat(F.lit("Distribution of "), F.col("n0")), F.col("n0"), _null_s(), _null_s(), _null_a(), 0.75)
    sc = _spec(n0.join(n1, "table"), 1, F.lit(3), "scatter", F.concat(F.col("n0"), F.lit(" vs "), F.col("n1")), F.col("n0"),
               F.col("n1"), _null_s(), _null_a(), 0.70)
    bar = _spec(n0.join(c0, "table"), 1, F.lit(4), "bar", F.concat(F.col("n0"), F.lit(" by "), F.col("c0")), F.col("c0"),
                F.col("n0"), F.lit("sum"), _null_a(), 0.72)
    return line.unionByName(hist).unionByName(sc).unionByName(bar)


def _formula_agg(formula: Column) -> Column:
    up = F.upper(F.coalesce(formula, F.lit("")))
    out = F.lit("sum")
    for kw in reversed(FORMULA_AGG_ORDER):
        out = F.when(F.contains(up, F.lit(kw)), F.lit(kw.lower())).otherwise(out)
    return out


def kpi_overlay(base: DataFrame, kpi_defs: DataFrame, catalog: DataFrame, type_col: str = "semantic_type",
                max_visualizations: int = MAX_VISUALIZATIONS_DEFAULT) -> DataFrame:
    """Trend -> line 0.75, comparative -> bar 0.72, unused numeric primary KPI -> histogram 0.65;
    skip unknown columns and existing (x, y) pairs; keep the first ``max_visualizations`` in order."""
    known = catalog.select("table", F.col("name").alias("c"))
    pairs0 = base.select("table", "x", "y")
    src = F.col("source_columns")
    trends = (kpi_defs.where(F.col("bucket") == "trend_metrics").where(F.size(src) >= 2)
              .select("table", "seq", "kpi_name", "formula", F.element_at(src, 1).alias("x"), F.element_at(src, 2).alias("y")))
    comps = (kpi_defs.where(F.col("bucket") == "comparative_metrics").where(F.size(src) >= 2)
             .select("table", "seq", "kpi_name", "formula", F.element_at(src, 1).alias("x"), F.element_at(src, 2).alias("y")))

    def known_xy(df):
        return (df.join(known.withColumnRenamed("c", "x"), ["table", "x"], "left_semi")
                .join(known.withColumnRenamed("c", "y"), ["table", "y"], "left_semi"))

    def new_pairs(df, existing):
        return df.join(existing, [df["table"] == existing["table"], df["x"].eqNullSafe(existing["x"]),
                                  df["y"].eqNullSafe(existing["y"])], "left_anti")

    t_ok = new_pairs(known_xy(trends), pairs0)
    t_spec = _spec(t_ok, 2, F.col("seq"), "line", F.col("kpi_name"), F.col("x"), F.col("y"), _formula_agg(F.col("formula")),
                   _null_a(), 0.75)
    pairs1 = pairs0.unionByName(t_spec.select("table", "x", "y"))
    c_ok = new_pairs(known_xy(comps), pairs1)
    c_spec = _spec(c_ok, 3, F.col("seq"), "bar", F.col("kpi_name"), F.col("x"), F.col("y"), _formula_agg(F.col("formula")),
                   _null_a(), 0.72)
    pairs2 = pairs1.unionByName(c_spec.select("table", "x", "y"))
    numeric = catalog.where(F.col(type_col) == "numeric").select("table", F.col("name").alias("x"))
    prim = (kpi_defs.where(F.col("bucket") == "primary_kpis").where(F.size(src) >= 1)
            .select("table", "seq", F.element_at(src, 1).alias("x"))
            .join(known.withColumnRenamed("c", "x"), ["table", "x"], "left_semi")
            .join(pairs2.select("table", "x").where(F.col("x").isNotNull()), ["table", "x"], "left_anti")
            .join(numeric, ["table", "x"], "left_semi"))
    prim = prim.withColumn("_r", F.row_number().over(Window.partitionBy("table", "x").orderBy("seq"))).where(F.col("_r") == 1)
    h_spec = _spec(prim, 4, F.col("seq"), "histogram", F.concat(F.lit("Distribution of "), F.col("x")), F.col("x"), _null_s(),
                   _null_s(), _null_a(), 0.65)
    allv = base.unionByName(t_spec).unionByName(c_spec).unionByName(h_spec)
    w = Window.partitionBy("table").orderBy("rule_no", "seq")
    return (allv.withColumn("position", F.row_number().over(w) - 1)
            .where(F.col("position") < max_visualizations))


def trend_injection(spec: DataFrame, fallback_dates: DataFrame, catalog: DataFrame, type_col: str = "semantic_type") -> DataFrame:
    """Tables without a line chart but with a fallback date column get SUM-over-date
    lines for the first two numeric columns without id/code/zip/postal in the name,
    put first (prepending reverses their order)."""
    has_line = spec.where(F.col("chart_type") == "line").select("table").distinct()
    d0 = (fallback_dates.where(F.col("is_date")).withColumn("_r", F.row_number().over(
        Window.partitionBy("table").orderBy("ordinal"))).where(F.col("_r") == 1).select("table", F.col("name").alias("d")))
    num = catalog.where((F.col(type_col) == "numeric") & ~name_has_any(F.lower(F.col("name")), TREND_EXCLUDE_KEYWORDS))
    num = num.withColumn("k", F.row_number().over(Window.partitionBy("table").orderBy("ordinal"))).where(F.col("k") <= 2)
    inj = num.join(d0, "table").join(has_line, "table", "left_anti")
    return inj.select("table", (F.lit(3) - F.col("k")).alias("seq"), F.lit("line").alias("chart_type"),
                      F.concat(F.col("name"), F.lit(" over time")).alias("title"), F.col("d").alias("x"),
                      F.col("name").alias("y"), F.lit("sum").alias("aggregation"))
