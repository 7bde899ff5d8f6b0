"""Registered queries: roles, KPIs, chart recommendations, spec checks, chart data (K*, V*, W*, C*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import DATE_KEYWORDS, GEO_KEYWORDS, ID_KEYWORDS, AVG_HINTS, SUM_HINTS
from ..operators import charts, formula, kpi, recommend, roles, spec_checks
from . import oracle as O
from .common import multi_catalog, r6, table

Q = {}


def reg(key, sql=None):
    def deco(fn):
        Q[key] = (fn, sql)
        return fn
    return deco


ROLE_TABLES = ["orders", "lineitem", "customer", "part", "events"]
CAT_ROLES = O.catalog_sql(ROLE_TABLES)


def _has(col: str, kws: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{k}')" for k in kws) + ")"


CL = "replace(lower(name), ' ', '_')"
ROLES_SQL = f"""(WITH c AS {CAT_ROLES}, r AS (
  SELECT "table", ordinal, name, kind, distinct_count,
    CASE WHEN {_has(CL, ID_KEYWORDS)} AND distinct_count / CAST(GREATEST(n_rows, 1) AS DOUBLE) > 0.5 THEN 'identifier'
         WHEN kind = 'datetime' OR {_has(CL, DATE_KEYWORDS)} THEN 'temporal'
         WHEN {_has(CL, GEO_KEYWORDS)} THEN 'geographic'
         WHEN kind IN ('numeric', 'boolean') AND distinct_count <= 20 THEN 'dimension'
         WHEN kind IN ('numeric', 'boolean') THEN 'measure' ELSE 'dimension' END AS r1 FROM c)
  SELECT "table", ordinal, name, kind, distinct_count, r1 AS role FROM r
  UNION ALL SELECT "table", ordinal, name, kind, distinct_count, 'dimension' FROM r WHERE r1 = 'geographic')"""
RP_SQL = f"""(SELECT *, row_number() OVER (PARTITION BY "table", role ORDER BY ordinal) AS position FROM {ROLES_SQL} r0)"""


def _ctx(spark, sf):
    tabs = {t: table(spark, sf, t) for t in ROLE_TABLES}
    cat = multi_catalog(spark, sf, ROLE_TABLES)
    rl = roles.column_roles(cat)
    return tabs, cat, rl


@reg("column_roles", f"""SELECT "table", ordinal, name, role FROM {ROLES_SQL} x""")
def q_column_roles(spark, sf):
    """K1: identifier / temporal / geographic(+dimension) / dimension / measure."""
    _, _, rl = _ctx(spark, sf)
    return rl.select("table", "ordinal", "name", "role")


def _coverage_sql() -> str:
    parts = []
    for t in ROLE_TABLES:
        for c, k in O.SCHEMAS[t]:
            if k == "datetime" or any(kw in c.lower().replace(" ", "_") for kw in DATE_KEYWORDS):
                y = f"year({O.value_dt_sql(c, k)})" if k != "numeric" else f"CAST({c} AS INTEGER)"
                parts.append(f"""SELECT '{t}' AS "table", '{c}' AS name, MIN({y}) || '-' || MAX({y}) AS estimated_range FROM {t}""")
    return f"""WITH f AS (SELECT "table", name FROM {RP_SQL} p WHERE role = 'temporal' AND position = 1)
  SELECT t."table", f.name IS NOT NULL AS has_time_dimension, f.name AS time_column, y.estimated_range
  FROM (SELECT DISTINCT "table" FROM {CAT_ROLES} c) t LEFT JOIN f ON f."table" = t."table"
  LEFT JOIN ({" UNION ALL ".join(parts)}) y ON y."table" = f."table" AND y.name = f.name"""


@reg("time_coverage", _coverage_sql())
def q_time_coverage(spark, sf):
    """K2: first temporal column and its year range."""
    tabs, _, rl = _ctx(spark, sf)
    return roles.time_coverage(rl, tabs)


@reg("key_entities", f"""WITH ids AS (SELECT "table", ordinal, name, distinct_count,
    trim(replace(replace(lower(name), '_id', ''), ' id', '')) AS base FROM {ROLES_SQL} r WHERE role = 'identifier'),
  j AS (SELECT ids.*, c.name AS name_column, row_number() OVER (PARTITION BY ids."table", ids.ordinal ORDER BY c.ordinal NULLS LAST) AS rk
    FROM ids LEFT JOIN {CAT_ROLES} c ON c."table" = ids."table" AND contains(lower(c.name), 'name') AND contains(lower(c.name), ids.base))
  SELECT "table", ordinal, array_to_string(list_transform(range(1, length(base) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(substr(base, i - 1, 1), '[A-Za-z]')
      THEN upper(substr(base, i, 1)) ELSE lower(substr(base, i, 1)) END), '') AS entity_name, name AS id_column, name_column,
    '~' || distinct_count || ' unique' AS estimated_cardinality FROM j WHERE rk = 1""")
def q_key_entities(spark, sf):
    """K3: entities behind identifier columns."""
    _, cat, rl = _ctx(spark, sf)
    return roles.key_entities(rl, cat)


def _kdefs(spark, sf):
    tabs, cat, rl = _ctx(spark, sf)
    return tabs, cat, rl, kpi.kpi_definitions(rl, cat)


KDEFS_SQL = f"""(WITH rp AS {RP_SQL},
  meas AS (SELECT * FROM rp WHERE role = 'measure' AND position <= 5),
  nm AS (SELECT "table", COUNT(*) AS n FROM meas GROUP BY 1),
  tmp AS (SELECT "table", name AS t FROM rp WHERE role = 'temporal' AND position = 1),
  geo AS (SELECT "table", name FROM rp WHERE role = 'geographic'),
  dims AS (SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY d."table" ORDER BY d.ordinal) AS dpos FROM rp d
           WHERE role = 'dimension' AND NOT EXISTS (SELECT 1 FROM geo g WHERE g."table" = d."table" AND g.name = d.name)) z WHERE dpos <= 3),
  main AS (SELECT "table", name AS main FROM meas WHERE position = 1),
  firstc AS (SELECT c."table", c.name, COALESCE(nm.n, 0) AS n FROM {CAT_ROLES} c LEFT JOIN nm ON nm."table" = c."table" WHERE c.ordinal = 0)
  SELECT "table", 'primary_kpis' AS bucket, 0 AS bucket_order, CAST(position AS INTEGER) AS seq, 'Total ' || name AS kpi_name,
    'SUM([' || name || '])' AS formula, name AS source_columns,
    CASE WHEN {_has('lower(name)', ['sale', 'revenue', 'price', 'profit', 'cost'])} THEN '$#,##0' ELSE '#,##0' END AS format,
    NULL AS time_grain, NULL AS compare_by FROM meas
  UNION ALL SELECT "table", 'primary_kpis', 0, CAST(n + 1 AS INTEGER), 'Total Records', 'COUNT([' || name || '])', name, '#,##0', NULL, NULL FROM firstc
  UNION ALL SELECT "table", 'secondary_metrics', 1, CAST(position AS INTEGER), 'Average ' || name, 'AVG([' || name || '])', name, '#,##0.00', NULL, NULL FROM meas
  UNION ALL SELECT m."table", 'trend_metrics', 2, CAST(position AS INTEGER), 'Monthly ' || name || ' Trend', 'SUM([' || name || '])', t || ',' || name,
    NULL, 'month', NULL FROM meas m JOIN tmp ON tmp."table" = m."table" WHERE position <= 2
  UNION ALL SELECT d."table", 'comparative_metrics', 3, CAST(dpos AS INTEGER), main || ' by ' || name, 'SUM([' || main || '])', name || ',' || main,
    NULL, NULL, name FROM dims d JOIN main ON main."table" = d."table")"""


@reg("kpi_definitions", f"SELECT * FROM {KDEFS_SQL} k")
def q_kpi_definitions(spark, sf):
    """K4: primary, secondary, trend and comparative KPI definitions."""
    _, _, _, d = _kdefs(spark, sf)
    return d.select("table", "bucket", "bucket_order", "seq", "kpi_name", "formula",
                    F.array_join("source_columns", ",").alias("source_columns"), "format", "time_grain", "compare_by")


FLAT_SQL = f"""(SELECT "table", CAST(row_number() OVER (PARTITION BY "table" ORDER BY bucket_order, seq) AS INTEGER) AS position, kpi_name AS metric_name,
    split_part(source_columns, ',', 1) AS "column",
    CASE WHEN bucket = 'comparative_metrics' THEN 'sum' WHEN contains(upper(formula), 'SUM') THEN 'sum' WHEN contains(upper(formula), 'AVG') THEN 'avg'
      WHEN contains(upper(formula), 'MIN') THEN 'min' WHEN contains(upper(formula), 'MAX') THEN 'max'
      WHEN contains(upper(formula), 'COUNT') THEN 'count' WHEN contains(upper(formula), 'MEDIAN') THEN 'median' ELSE 'sum' END AS aggregation
  FROM {KDEFS_SQL} k)"""


@reg("kpi_flatten", f"SELECT * FROM {FLAT_SQL} f")
def q_kpi_flatten(spark, sf):
    """K8: all buckets as one (metric, column, aggregation) list."""
    _, cat, _, d = _kdefs(spark, sf)
    return kpi.kpi_flatten(d, cat)


def _kv_sql():
    parts = []
    for t in ROLE_TABLES:
        for c, k in O.SCHEMAS[t]:
            v = O.value_num_sql(c, k)
            parts.append(f"""SELECT '{t}' AS "table", '{c}' AS "column", CAST(SUM(CAST({v} AS DECIMAL(38,6))) AS DOUBLE) AS s,
              CAST(SUM(CAST({v} AS DECIMAL(38,6))) AS DOUBLE) / COUNT({v}) AS a, CAST(COUNT({c}) AS DOUBLE) AS n,
              MIN({v}) AS mn, MAX({v}) AS mx FROM {t}""")
    vals = "\nUNION ALL\n".join(parts)
    return f"""SELECT f."table", f.position, f.metric_name, f."column", f.aggregation,
      CASE f.aggregation WHEN 'sum' THEN v.s WHEN 'avg' THEN v.a WHEN 'count' THEN v.n WHEN 'min' THEN v.mn WHEN 'max' THEN v.mx END AS value
      FROM {FLAT_SQL} f JOIN ({vals}) v ON v."table" = f."table" AND v."column" = f."column\""""


@reg("kpi_values", _kv_sql())
def q_kpi_values(spark, sf):
    """K5: every KPI evaluated; one aggregate per table."""
    tabs, cat, _, d = _kdefs(spark, sf)
    return kpi.kpi_values(kpi.kpi_flatten(d, cat), tabs)


def _trend_sql() -> str:
    parts = []
    for t in ROLE_TABLES:
        cols = O.SCHEMAS[t]
        temporal = [(c, k) for c, k in cols if k == "datetime" or any(kw in c.lower().replace(" ", "_") for kw in DATE_KEYWORDS)]
        for tc, tk in temporal:
            ts = O.value_dt_sql(tc, tk)
            for m, mk in cols:
                if mk != "numeric":
                    continue
                parts.append(f"""SELECT '{t}' AS "table", '{tc}' AS tcol, '{m}' AS measure, CAST(date_trunc('month', {ts}) AS TIMESTAMP) AS period,
                  CAST(SUM(CAST({m} AS DECIMAL(38,6))) AS DOUBLE) AS value FROM {t} WHERE {ts} IS NOT NULL GROUP BY 4""")
    allv = "\nUNION ALL\n".join(parts)
    return f"""WITH kd AS {KDEFS_SQL}
      SELECT k."table", k.kpi_name AS metric_name, v.period, v.value FROM kd k JOIN ({allv}) v ON v."table" = k."table"
        AND v.tcol = split_part(k.source_columns, ',', 1) AND v.measure = split_part(k.source_columns, ',', 2)
      WHERE k.bucket = 'trend_metrics'"""


@reg("kpi_trend_month", _trend_sql())
def q_kpi_trend(spark, sf):
    """K6: monthly SUM of the first two measures over the first temporal column."""
    tabs, _, _, d = _kdefs(spark, sf)
    return kpi.trend_values(d, tabs)


@reg("kpi_comparative", None)
def q_kpi_comparative(spark, sf):
    """K7: SUM(first measure) by the first three non-geographic dimensions, via GROUPING SETS."""
    tabs, _, _, d = _kdefs(spark, sf)
    return kpi.comparative_values(d, tabs)


@reg("kpi_ratio", """SELECT l_returnflag, CAST(SUM(CAST(l_extendedprice AS DECIMAL(38,6))) AS DOUBLE) / CAST(SUM(CAST(l_quantity AS DECIMAL(38,6))) AS DOUBLE) AS price_per_unit
  FROM lineitem GROUP BY l_returnflag""")
def q_kpi_ratio(spark, sf):
    """K9: a calculated ratio field SUM(a)/SUM(b), evaluated per dimension value."""
    return kpi.calculated_field(table(spark, sf, "lineitem"), "price_per_unit", "SUM([l_extendedprice]) / SUM([l_quantity])",
                                ["l_returnflag"])


#: calculated fields of lineitem by l_returnflag, and what they are in SQL
FORMULAS = {
    "price": ("SUM([l_extendedprice] * (1 - [l_discount])) / COUNTD([l_orderkey])", "SUM(l_extendedprice * (1 - l_discount)) / COUNT(DISTINCT l_orderkey)"),
    "discounted": ("SUM(IF [l_discount] > 0.05 THEN [l_extendedprice] ELSEIF [l_discount] > 0.03 THEN [l_extendedprice] / 2 ELSE 0 END) / SUM([l_extendedprice]) * 100",
                   "SUM(CASE WHEN l_discount > 0.05 THEN l_extendedprice WHEN l_discount > 0.03 THEN l_extendedprice / 2 ELSE 0 END) / SUM(l_extendedprice) * 100"),
    "span": ("(MAX([l_tax]) - MIN([l_tax])) * 2 + COUNT(IF LOWER([l_linestatus]) = 'o' THEN 1 END)",
             "(MAX(l_tax) - MIN(l_tax)) * 2 + COUNT(CASE WHEN lower(l_linestatus) = 'o' THEN 1 END)"),
    "nothing": ("SUM([l_quantity]) / (COUNT([l_tax]) - COUNT([l_orderkey]))", "SUM(l_quantity) / NULLIF(COUNT(l_tax) - COUNT(l_orderkey), 0)"),
    "chosen": ("IF AVG([l_quantity]) > 25.5 AND [l_returnflag] <> 'N' THEN MAX([l_linenumber]) ELSE -AVG([l_discount]) END",
               "CASE WHEN AVG(l_quantity) > 25.5 AND l_returnflag <> 'N' THEN MAX(l_linenumber) ELSE -AVG(l_discount) END"),
}


@reg("calculated_fields", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS field, 'real' AS type, 'measure' AS role, l_returnflag, round(CAST({sql} AS DOUBLE), 6) AS value FROM lineitem GROUP BY l_returnflag"
    for n, (_, sql) in FORMULAS.items()))
def q_calculated_fields(spark, sf):
    """K9: nested formulas of several aggregations, with the type and role of each."""
    out = None
    for n, (text, _) in FORMULAS.items():
        one = formula.calculated(table(spark, sf, "lineitem"), "value", text, ["l_returnflag"])
        kind, role = formula.type_and_role(one, "value")
        one = one.select(F.lit(n).alias("field"), F.lit(kind).alias("type"), F.lit(role).alias("role"), "l_returnflag", r6(F.col("value").cast("double")).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@reg("calculated_rows", """SELECT p_partkey, CASE WHEN contains(upper(p_type), 'BRASS') THEN round(p_retailprice / NULLIF(p_size - 1, 0), 6)
  WHEN length(p_name) % 2 = 0 THEN p_retailprice ELSE -1 END AS value FROM part""")
def q_calculated_rows(spark, sf):
    """K9: a calculated field of each row."""
    text = ("IF CONTAINS(UPPER([p_type]), 'BRASS') THEN ROUND([p_retailprice] / ([p_size] - 1), 6) "
            "ELSEIF LEN([p_name]) % 2 = 0 THEN [p_retailprice] ELSE -1 END")
    return formula.calculated(table(spark, sf, "part"), "value", text).select("p_partkey", "value")


CUSTOM_KPIS = [("Least price", "l_extendedprice", "min"), ("Greatest price", "l_extendedprice", "max"), ("Median price", "l_extendedprice", "median"),
               ("Median quantity", "l_quantity", "median"), ("Mean discount", "l_discount", "avg"), ("Lines", "l_returnflag", "count")]


@reg("kpi_custom_values", "\nUNION ALL\n".join(
    f"""SELECT 'lineitem' AS "table", {i} AS position, '{n}' AS metric_name, '{c}' AS "column", '{a}' AS aggregation, round(CAST({
    dict(min=f'MIN({c})', max=f'MAX({c})', median=f'quantile_cont({c}, 0.5)', avg=f'AVG({c})', count=f'COUNT({c})')[a]} AS DOUBLE), 6) AS value FROM lineitem"""
    for i, (n, c, a) in enumerate(CUSTOM_KPIS)))
def q_kpi_custom_values(spark, sf):
    """K5: the aggregations that the derived KPIs do not use: minimum, maximum, median, mean, count."""
    flat = spark.createDataFrame([("lineitem", i, *k) for i, k in enumerate(CUSTOM_KPIS)],
                                 "table string, position int, metric_name string, column string, aggregation string")
    return kpi.kpi_values(flat, {"lineitem": table(spark, sf, "lineitem")}).withColumn("value", r6("value"))


@reg("chart_hints", f"""WITH c AS (SELECT "table", SUM(CASE WHEN role = 'temporal' THEN 1 ELSE 0 END) AS t, SUM(CASE WHEN role = 'measure' THEN 1 ELSE 0 END) AS m,
    SUM(CASE WHEN role = 'dimension' THEN 1 ELSE 0 END) AS d FROM {ROLES_SQL} r GROUP BY 1),
  h AS (SELECT "table", 0 AS o, 'line' AS chart_type FROM c WHERE t > 0 AND m > 0 UNION ALL SELECT "table", 1, 'bar' FROM c WHERE d > 0 AND m > 0
    UNION ALL SELECT "table", 2, 'scatter' FROM c WHERE m >= 2 UNION ALL SELECT "table", 3, 'histogram' FROM c WHERE m > 0)
  SELECT "table", CAST(row_number() OVER (PARTITION BY "table" ORDER BY o) - 1 AS INTEGER) AS position, chart_type FROM h""")
def q_chart_hints(spark, sf):
    """Chart types suggested by the role counts."""
    _, _, rl = _ctx(spark, sf)
    return kpi.chart_hints(rl)


@reg("dataset_overview", f"""WITH rp AS {RP_SQL}, s AS (SELECT "table", MAX(n_rows) AS row_count, COUNT(*) AS column_count FROM {CAT_ROLES} c GROUP BY 1)
  SELECT s."table", row_count, column_count,
    COALESCE((SELECT string_agg(name, ',' ORDER BY ordinal) FROM rp WHERE rp."table" = s."table" AND role = 'measure'), '') AS measures,
    COALESCE((SELECT string_agg(name, ',' ORDER BY ordinal) FROM rp WHERE rp."table" = s."table" AND role = 'temporal'), '') AS temporal,
    'One row per record (' || row_count || ' total rows)' AS grain FROM s""")
def q_dataset_overview(spark, sf):
    """Shape, measures, temporal columns and grain per table."""
    _, cat, rl = _ctx(spark, sf)
    return kpi.dataset_overview(rl, cat)


# ---------------------------------------------------------------- V rules
REC_TABLES = ["orders", "lineitem", "customer", "part", "events", "labels", "documents", "dirty_orders", "benchmark", "pages"]
CAT_REC = O.catalog_sql(REC_TABLES)


def _rec_cat(spark, sf):
    return multi_catalog(spark, sf, REC_TABLES)


def _spec_out(df):
    return df.select("table", "rule_no", "seq", "chart_type", "title", "x", "y", "aggregation",
                     F.array_join("group_by", ",").alias("group_by"), "confidence")


@reg("guess_aggregation", f"""SELECT "table", name, CASE WHEN {_has('lower(name)', AVG_HINTS)} THEN 'avg' WHEN {_has('lower(name)', SUM_HINTS)} THEN 'sum'
    WHEN num_min IS NOT NULL AND num_max IS NOT NULL AND num_min >= 0 AND num_max <= 1 THEN 'avg' ELSE 'sum' END AS aggregation
  FROM {CAT_REC} c WHERE semantic_type_builder = 'numeric'""")
def q_guess_aggregation(spark, sf):
    """V7: aggregation of each numeric column from its name and [0, 1] range."""
    cat = _rec_cat(spark, sf)
    return cat.where(F.col("semantic_type_builder") == "numeric").select(
        "table", "name", recommend.guess_aggregation(F.col("name"), F.col("num_min"), F.col("num_max")).alias("aggregation"))


@reg("grouping_column", f"""SELECT "table", name AS group_col FROM (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY abs(distinct_count - 5), ordinal) AS r
  FROM {CAT_REC} c WHERE semantic_type_builder = 'categorical' AND distinct_count BETWEEN 2 AND 12) z WHERE r = 1""")
def q_grouping_column(spark, sf):
    """V8: best colour/grouping column per table."""
    cat = _rec_cat(spark, sf)
    return recommend.grouping_column(recommend.typed(cat, "semantic_type_builder", "categorical"))


def _specs(spark, sf):
    return recommend.rule_specs(_rec_cat(spark, sf))


for _rule, _no, _doc in [("rule_time_series", 1, "V1"), ("rule_categorical", 2, "V2"), ("rule_distributions", 3, "V3"),
                         ("rule_relationships", 4, "V4"), ("rule_table_fallback", 5, "V5")]:
    def _mk(no):
        def fn(spark, sf):
            return _spec_out(_specs(spark, sf).where(F.col("rule_no") == no))
        fn.__doc__ = f"{_doc}: chart specs of rule {no} over the catalog of tables."
        return fn
    Q[_rule] = (_mk(_no), None)


@reg("recommend_topk", None)
def q_recommend(spark, sf):
    """V6: assembled dashboard per table (rule order, top-10 by confidence when over 10), grid cells."""
    r = recommend.recommend(_specs(spark, sf))
    return r.select("table", "position", "grid_row", "grid_col", "chart_type", "title", "x", "y", "aggregation",
                    F.array_join("group_by", ",").alias("group_by"), "confidence")


def _baseline_sql():
    return f"""WITH c AS {CAT_REC},
  p AS (SELECT "table", name, semantic_type, row_number() OVER (PARTITION BY "table", semantic_type ORDER BY ordinal) AS pos FROM c),
  n0 AS (SELECT "table", name AS n0 FROM p WHERE semantic_type = 'numeric' AND pos = 1),
  n1 AS (SELECT "table", name AS n1 FROM p WHERE semantic_type = 'numeric' AND pos = 2),
  d0 AS (SELECT "table", name AS d0 FROM p WHERE semantic_type = 'datetime' AND pos = 1),
  c0 AS (SELECT "table", name AS c0 FROM p WHERE semantic_type = 'categorical' AND pos = 1)
  SELECT n0."table", 1 AS rule_no, 1 AS seq, 'line' AS chart_type, n0 || ' over time' AS title, d0 AS x, n0 AS y, 'sum' AS aggregation, CAST(NULL AS VARCHAR) AS group_by, CAST(0.8 AS DOUBLE) AS confidence FROM n0 JOIN d0 USING ("table")
  UNION ALL SELECT "table", 1, 2, 'histogram', 'Distribution of ' || n0, n0, NULL, NULL, NULL, CAST(0.75 AS DOUBLE) FROM n0
  UNION ALL SELECT n0."table", 1, 3, 'scatter', n0 || ' vs ' || n1, n0, n1, NULL, NULL, CAST(0.7 AS DOUBLE) FROM n0 JOIN n1 USING ("table")
  UNION ALL SELECT n0."table", 1, 4, 'bar', n0 || ' by ' || c0, c0, n0, 'sum', NULL, CAST(0.72 AS DOUBLE) FROM n0 JOIN c0 USING ("table")"""


@reg("baseline_spec", _baseline_sql())
def q_baseline(spark, sf):
    """The baseline spec (line, histogram, scatter, bar) from pipeline types."""
    return _spec_out(recommend.baseline_spec(_rec_cat(spark, sf)))


@reg("kpi_overlay", None)
def q_kpi_overlay(spark, sf):
    """Baseline + KPI-driven charts (trend lines, comparative bars, KPI histograms), capped at 8 in order."""
    tabs, cat, rl = _ctx(spark, sf)
    d = kpi.kpi_definitions(rl, cat)
    ov = recommend.kpi_overlay(recommend.baseline_spec(cat), d, cat)
    return ov.select("table", "position", "chart_type", "title", "x", "y", "aggregation", "confidence")


def _undated(spark, sf):
    """A table as uploaded from text: day-first dates, no native date column, and so no line in its spec."""
    from ..operators.stats import catalog_of_tables

    df = table(spark, sf, "dirty_orders").drop("o_orderdate")
    cat = catalog_of_tables(spark, {"undated_orders": df})
    fb = spec_checks.date_fallback(df, cat, "undated_orders", "o_orderkey")
    fb = fb.withColumn("table", F.lit("undated_orders")).join(cat.select("name", "ordinal"), "name")
    base = recommend.baseline_spec(cat)
    return base, recommend.trend_injection(base, fb, cat)


@reg("trend_injection", None)
def q_trend_injection(spark, sf):
    """SUM-over-date lines injected when the spec has no line but a text date column exists."""
    return _undated(spark, sf)[1]


GONE = ["o_totalprice", "l_quantity", "c_mktsegment"]


@reg("spec_dangling_columns", None)
def q_spec_dangling(spark, sf):
    """Charts made before a column went away (rows = problems)."""
    cat = _rec_cat(spark, sf)
    specs = recommend.recommend(recommend.rule_specs(cat))
    return spec_checks.dangling_columns(specs, cat.where(~F.col("name").isin(GONE)))


@reg("spec_merge", None)
def q_spec_merge(spark, sf):
    """Injected trend charts join the spec when their title is new."""
    base, inj = _undated(spark, sf)
    return spec_checks.merge_specs(base.select("table", "seq", "chart_type", "title", "x", "y", "aggregation"), inj)


@reg("spec_constraints", None)
def q_spec_constraints(spark, sf):
    """Charts as a careless editor might leave them: boosted confidences, cleared titles, a blank list item."""
    specs = recommend.recommend(recommend.rule_specs(_rec_cat(spark, sf)))
    edited = specs.select("table", F.when(F.col("chart_type") == "pie", F.lit("  ")).otherwise(F.col("title")).alias("title"),
                          (F.col("confidence") * 1.25).alias("confidence"),
                          F.when(F.col("chart_type") == "box", F.array(F.col("x"), F.lit(" "))).otherwise(F.col("group_by")).alias("group_by"))
    return spec_checks.constraint_violations(edited)


SETTINGS_SQL = "SELECT 'c' || n_nationkey AS \"table\", n_nationkey AS max_visualizations, n_nationkey * 5 - 10 AS threshold, 3 - n_nationkey AS score FROM nation"


@reg("settings_constraints", f"""WITH s AS ({SETTINGS_SQL})
  SELECT "table", 'max_visualizations not in 1..20' AS problem FROM s WHERE max_visualizations NOT BETWEEN 1 AND 20
  UNION ALL SELECT "table", 'threshold not in 0..100' FROM s WHERE threshold NOT BETWEEN 0 AND 100
  UNION ALL SELECT "table", 'score below 0' FROM s WHERE score < 0""")
def q_settings_constraints(spark, sf):
    """The ranges of the settings, over one set of settings per nation."""
    n = F.col("n_nationkey")
    return spec_checks.settings_violations(table(spark, sf, "nation").select(
        F.concat(F.lit("c"), n.cast("string")).alias("table"), n.alias("max_visualizations"), (n * 5 - 10).alias("threshold"), (3 - n).alias("score")))


@reg("distinct_lookup", f"""SELECT "table", name, distinct_count FROM {O.catalog_sql(["dirty_orders"])} c""")
def q_distinct_lookup(spark, sf):
    """V9: distinct counts from the profile first; the catalog here knows none of the columns that have a profile."""
    from ..operators.profile import profile_report
    from .common import catalog_for

    df, cat, fk = catalog_for(spark, sf, "dirty_orders")
    prof, _ = profile_report(df, cat, fk, "dirty_orders")
    known = F.col("semantic_type").isin("categorical", "boolean")
    bare = cat.withColumn("distinct_count", F.when(~known, F.col("distinct_count")))
    return recommend.distinct_lookup(bare, prof).select("table", "name", "distinct_count")


# ---------------------------------------------------------------- C1-C8 chart data
@reg("chart_line", """SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, o_orderpriority AS series,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(38,6))) AS DOUBLE) AS value FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2""")
def q_chart_line(spark, sf):
    """Monthly SUM(o_totalprice) per priority."""
    return charts.line_chart(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "sum", "month", ["o_orderpriority"])


@reg("chart_bar", """SELECT o_orderpriority AS category, CAST(SUM(CAST(o_totalprice AS DECIMAL(38,6))) AS DOUBLE) AS value FROM orders GROUP BY 1""")
def q_chart_bar(spark, sf):
    """SUM(o_totalprice) by priority."""
    return charts.bar_chart(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "sum")


@reg("chart_pie", """WITH b AS (SELECT o_orderstatus AS category, CAST(SUM(CAST(o_totalprice AS DECIMAL(38,6))) AS DOUBLE) AS value FROM orders GROUP BY 1)
  SELECT category, value, value / (SELECT SUM(value) FROM b) AS share FROM b""")
def q_chart_pie(spark, sf):
    """Share of total by order status."""
    return charts.pie_chart(table(spark, sf, "orders"), "o_orderstatus", "o_totalprice", "sum").select(
        "category", "value", "share")


@reg("chart_box", """WITH v AS (SELECT l_returnflag AS g, l_extendedprice AS x FROM lineitem WHERE l_extendedprice IS NOT NULL),
  q AS (SELECT g, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY g),
  f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS hf FROM q)
  SELECT v.g AS l_returnflag, COUNT(*) AS count, MIN(x) AS min, round(MIN(q1), 6) AS q1, round(MIN(med), 6) AS median, round(MIN(q3), 6) AS q3, MAX(x) AS max,
    round(MIN(lf), 6) AS low_fence, round(MIN(hf), 6) AS high_fence, MIN(x) FILTER (WHERE x >= lf AND x <= hf) AS whisker_low,
    MAX(x) FILTER (WHERE x >= lf AND x <= hf) AS whisker_high, COUNT(*) FILTER (WHERE x < lf OR x > hf) AS n_outliers
  FROM v JOIN f ON f.g = v.g GROUP BY v.g""")
def q_chart_box(spark, sf):
    """Box statistics of l_extendedprice per return flag."""
    b = charts.box_stats(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag")
    return b.select("l_returnflag", "count", "min", r6("q1").alias("q1"), r6("median").alias("median"), r6("q3").alias("q3"), "max",
                    r6("low_fence").alias("low_fence"), r6("high_fence").alias("high_fence"), "whisker_low", "whisker_high", "n_outliers")


@reg("chart_scatter", """SELECT CAST(l_quantity AS DOUBLE) AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL""")
def q_chart_scatter(spark, sf):
    """Every (l_quantity, l_extendedprice) point."""
    return charts.scatter_points(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


def _cell_sql(c: str, bins: int) -> str:
    return (f"CASE WHEN hi_{c} = lo_{c} THEN 0 ELSE CAST(LEAST(floor(({c} / 2 - lo_{c} / 2) / (hi_{c} / 2 - lo_{c} / 2) * {bins}), {bins - 1}) AS INTEGER) END")


@reg("chart_scatter_binned", f"""WITH p AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
  b AS (SELECT MIN(x) AS lo_x, MAX(x) AS hi_x, MIN(y) AS lo_y, MAX(y) AS hi_y FROM p),
  c AS (SELECT *, {_cell_sql("x", 50)} AS x_bin, {_cell_sql("y", 50)} AS y_bin FROM p, b)
  SELECT x_bin, y_bin, lo_x + x_bin * ((hi_x / 2 - lo_x / 2) / 50) * 2 AS x_edge, lo_y + y_bin * ((hi_y / 2 - lo_y / 2) / 50) * 2 AS y_edge, COUNT(*) AS count,
    MIN(x) AS x_min, MAX(x) AS x_max, MIN(y) AS y_min, MAX(y) AS y_max FROM c GROUP BY x_bin, y_bin, lo_x, hi_x, lo_y, hi_y""")
def q_chart_scatter_binned(spark, sf):
    """All (l_quantity, l_extendedprice) points, counted on a grid."""
    return charts.scatter_binned(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@reg("chart_heatmap", """SELECT l_returnflag AS "row", l_linestatus AS "column", CAST(SUM(CAST(l_quantity AS DECIMAL(38,6))) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2""")
def q_chart_heatmap(spark, sf):
    """SUM(l_quantity) on the return-flag x line-status grid."""
    return charts.heatmap(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", "sum")


@reg("chart_table", f"""SELECT c_mktsegment, c_nationkey FROM customer ORDER BY 1, 2 LIMIT {charts.TABLE_ROWS}""")
def q_chart_table(spark, sf):
    """The chosen columns, first rows in order (the number is the feature)."""
    return charts.table_chart(table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"])


# ---------------------------------------------------------------- SQL oracles of the rule keys
def _agg_sql(n: str) -> str:
    return (f"CASE WHEN {_has(f'lower({n}.name)', AVG_HINTS)} THEN 'avg' WHEN {_has(f'lower({n}.name)', SUM_HINTS)} THEN 'sum' "
            f"WHEN {n}.num_min IS NOT NULL AND {n}.num_max IS NOT NULL AND {n}.num_min >= 0 AND {n}.num_max <= 1 THEN 'avg' ELSE 'sum' END")


def _rules_sql(cat_sql: str) -> str:
    return f"""(WITH c AS {cat_sql},
  typed AS (SELECT "table", ordinal, name, distinct_count, num_min, num_max, semantic_type_builder AS st,
            row_number() OVER (PARTITION BY "table", semantic_type_builder ORDER BY ordinal) AS pos FROM c),
  num AS (SELECT * FROM typed WHERE st = 'numeric'), cat AS (SELECT * FROM typed WHERE st = 'categorical'),
  dt AS (SELECT * FROM typed WHERE st = 'datetime'), txt AS (SELECT * FROM typed WHERE st = 'text'),
  grp AS (SELECT "table", name AS group_col FROM (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY abs(distinct_count - 5), pos) AS r
          FROM cat WHERE distinct_count BETWEEN 2 AND 12) g WHERE r = 1),
  v1 AS (SELECT n."table", 1 AS rule_no, CAST(n.pos AS INTEGER) AS seq, 'line' AS chart_type, n.name || ' over time' AS title, d.name AS x,
         n.name AS y, {_agg_sql('n')} AS aggregation, g.group_col AS group_by, CAST(0.85 AS DOUBLE) AS confidence
         FROM num n JOIN dt d ON d."table" = n."table" AND d.pos = 1 LEFT JOIN grp g ON g."table" = n."table" WHERE n.pos <= 3),
  c2 AS (SELECT ca.*, m.name AS m, {_agg_sql('m')} AS agg FROM cat ca JOIN num m ON m."table" = ca."table" AND m.pos = 1
         WHERE ca.pos <= 2 AND ca.distinct_count <= 50),
  v2 AS (SELECT "table", 2, CAST(pos * 2 AS INTEGER), 'bar', m || ' by ' || name, name, m, agg, NULL, CAST(0.80 AS DOUBLE) FROM c2
         UNION ALL SELECT "table", 2, CAST(pos * 2 + 1 AS INTEGER), 'pie', m || ' share by ' || name, name, m, agg, NULL, CAST(0.65 AS DOUBLE)
         FROM c2 WHERE distinct_count BETWEEN 2 AND 7),
  v3 AS (SELECT "table", 3, CAST(pos AS INTEGER), 'histogram', 'Distribution of ' || name, name, NULL, NULL, NULL, CAST(0.70 AS DOUBLE) FROM num WHERE pos <= 2
         UNION ALL SELECT n."table", 3, 10, 'box', n.name || ' by ' || g.group_col, g.group_col, n.name, NULL, g.group_col, CAST(0.65 AS DOUBLE)
         FROM num n JOIN grp g ON g."table" = n."table" WHERE n.pos = 1),
  nn AS (SELECT "table", COUNT(*) AS n_num FROM num GROUP BY 1),
  elig AS (SELECT nn."table", n_num FROM nn JOIN (SELECT "table", MAX(n_rows) AS nr FROM c GROUP BY 1) r ON r."table" = nn."table" WHERE n_num >= 2 AND nr >= 30),
  pairs AS (SELECT a."table", a.name AS xa, b.name AS yb, row_number() OVER (PARTITION BY a."table" ORDER BY a.pos, b.pos) AS k
            FROM num a JOIN num b ON a."table" = b."table" AND a.pos < b.pos WHERE a."table" IN (SELECT "table" FROM elig)),
  v4 AS (SELECT "table", 4, CAST(k AS INTEGER), 'scatter', yb || ' vs ' || xa, xa, yb, NULL, NULL, CAST(0.68 AS DOUBLE) FROM pairs WHERE k <= 3
         UNION ALL SELECT "table", 4, 10, 'heatmap', 'Correlation matrix', NULL, NULL, NULL, NULL, CAST(0.60 AS DOUBLE) FROM elig WHERE n_num >= 3),
  specs AS (SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM v3 UNION ALL SELECT * FROM v4),
  few AS (SELECT DISTINCT "table" FROM c WHERE "table" NOT IN (SELECT "table" FROM specs GROUP BY 1 HAVING COUNT(*) >= 2)),
  ord AS (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY src, pos) AS k FROM (
          SELECT "table", 0 AS src, pos, name FROM cat UNION ALL SELECT "table", 1, pos, name FROM num
          UNION ALL SELECT "table", 2, pos, name FROM dt UNION ALL SELECT "table", 3, pos, name FROM txt) o),
  v5 AS (SELECT "table", 5, 1, 'table', 'Data summary', MAX(CASE WHEN k = 1 THEN name END), NULL, NULL, string_agg(name, ',' ORDER BY k),
         CAST(0.50 AS DOUBLE) FROM ord WHERE k <= 5 AND "table" IN (SELECT "table" FROM few) GROUP BY "table")
  SELECT * FROM specs UNION ALL SELECT * FROM v5)"""


RULES_SQL = _rules_sql(CAT_REC)
for _rule, _no in [("rule_time_series", 1), ("rule_categorical", 2), ("rule_distributions", 3), ("rule_relationships", 4),
                   ("rule_table_fallback", 5)]:
    Q[_rule] = (Q[_rule][0], f"SELECT * FROM {RULES_SQL} s WHERE rule_no = {_no}")

Q["recommend_topk"] = (Q["recommend_topk"][0], f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY rule_no, seq) AS o FROM {RULES_SQL} s0),
  n AS (SELECT "table", COUNT(*) AS n FROM s GROUP BY 1),
  r AS (SELECT s.*, n.n, row_number() OVER (PARTITION BY s."table" ORDER BY confidence DESC, o) AS rk FROM s JOIN n ON n."table" = s."table"),
  k AS (SELECT *, CAST(CASE WHEN n <= 10 THEN o ELSE rk END - 1 AS INTEGER) AS position FROM r WHERE n <= 10 OR rk <= 10)
  SELECT "table", position, CAST(floor(position / 2) AS BIGINT) AS grid_row, CAST(position % 2 AS INTEGER) AS grid_col, chart_type, title, x, y,
    aggregation, group_by, confidence FROM k""")

Q["spec_dangling_columns"] = (Q["spec_dangling_columns"][0], f"""WITH s AS (SELECT * FROM ({Q["recommend_topk"][1]}) s0),
  refs AS (SELECT "table", title, x AS "column" FROM s WHERE x IS NOT NULL UNION ALL SELECT "table", title, y FROM s WHERE y IS NOT NULL
           UNION ALL SELECT "table", title, unnest(string_split(group_by, ',')) FROM s WHERE group_by IS NOT NULL)
  SELECT "table", "column", title FROM refs r WHERE NOT EXISTS (SELECT 1 FROM {CAT_REC} c WHERE c."table" = r."table" AND c.name = r."column" AND c.name NOT IN ({O.lit_list(GONE)}))""")

Q["spec_constraints"] = (Q["spec_constraints"][0], f"""WITH e AS (SELECT "table", chart_type, CASE WHEN chart_type = 'pie' THEN '  ' ELSE title END AS title,
    confidence * CAST(1.25 AS DOUBLE) AS confidence FROM ({Q["recommend_topk"][1]}) s)
  SELECT "table", title, 'confidence not in 0..1' AS problem FROM e WHERE confidence > 1 OR confidence < 0
  UNION ALL SELECT "table", title, 'blank title' FROM e WHERE trim(title) = ''
  UNION ALL SELECT "table", title, 'blank list item' FROM e WHERE chart_type = 'box'""")


def _baseline_sql_for(cat_sql: str) -> str:
    return _baseline_sql().replace(f"WITH c AS {CAT_REC}", f"WITH c AS {cat_sql}", 1)


Q["kpi_overlay"] = (Q["kpi_overlay"][0], f"""WITH base AS ({_baseline_sql_for(CAT_ROLES)}), kd AS {KDEFS_SQL},
  known AS (SELECT "table", name FROM {CAT_ROLES} k0),
  tr AS (SELECT "table", seq, kpi_name, formula, split_part(source_columns, ',', 1) AS x, split_part(source_columns, ',', 2) AS y FROM kd WHERE bucket = 'trend_metrics'),
  t_ok AS (SELECT * FROM tr WHERE EXISTS (SELECT 1 FROM known k WHERE k."table" = tr."table" AND k.name = tr.x)
           AND EXISTS (SELECT 1 FROM known k WHERE k."table" = tr."table" AND k.name = tr.y)
           AND NOT EXISTS (SELECT 1 FROM base b WHERE b."table" = tr."table" AND b.x IS NOT DISTINCT FROM tr.x AND b.y IS NOT DISTINCT FROM tr.y)),
  t_spec AS (SELECT "table", 2 AS rule_no, seq, 'line' AS chart_type, kpi_name AS title, x, y,
             {"CASE " + " ".join(f"WHEN contains(upper(formula), '{k}') THEN '{k.lower()}'" for k in ['SUM', 'AVG', 'COUNT', 'MIN', 'MAX', 'MEDIAN']) + " ELSE 'sum' END"} AS aggregation,
             CAST(0.75 AS DOUBLE) AS confidence FROM t_ok),
  p1 AS (SELECT "table", x, y FROM base UNION ALL SELECT "table", x, y FROM t_spec),
  cp AS (SELECT "table", seq, kpi_name, formula, split_part(source_columns, ',', 1) AS x, split_part(source_columns, ',', 2) AS y FROM kd WHERE bucket = 'comparative_metrics'),
  c_ok AS (SELECT * FROM cp WHERE EXISTS (SELECT 1 FROM known k WHERE k."table" = cp."table" AND k.name = cp.x)
           AND EXISTS (SELECT 1 FROM known k WHERE k."table" = cp."table" AND k.name = cp.y)
           AND NOT EXISTS (SELECT 1 FROM p1 b WHERE b."table" = cp."table" AND b.x IS NOT DISTINCT FROM cp.x AND b.y IS NOT DISTINCT FROM cp.y)),
  c_spec AS (SELECT "table", 3 AS rule_no, seq, 'bar' AS chart_type, kpi_name AS title, x, y,
             {"CASE " + " ".join(f"WHEN contains(upper(formula), '{k}') THEN '{k.lower()}'" for k in ['SUM', 'AVG', 'COUNT', 'MIN', 'MAX', 'MEDIAN']) + " ELSE 'sum' END"} AS aggregation,
             CAST(0.72 AS DOUBLE) AS confidence FROM c_ok),
  p2 AS (SELECT "table", x FROM p1 WHERE x IS NOT NULL UNION ALL SELECT "table", x FROM c_spec),
  pr AS (SELECT "table", seq, split_part(source_columns, ',', 1) AS x FROM kd WHERE bucket = 'primary_kpis'),
  p_ok AS (SELECT "table", MIN(seq) AS seq, x FROM pr WHERE EXISTS (SELECT 1 FROM known k WHERE k."table" = pr."table" AND k.name = pr.x)
           AND NOT EXISTS (SELECT 1 FROM p2 WHERE p2."table" = pr."table" AND p2.x = pr.x)
           AND EXISTS (SELECT 1 FROM {CAT_ROLES} cc WHERE cc."table" = pr."table" AND cc.name = pr.x AND cc.semantic_type = 'numeric') GROUP BY "table", x),
  h_spec AS (SELECT "table", 4 AS rule_no, seq, 'histogram' AS chart_type, 'Distribution of ' || x AS title, x, NULL AS y, NULL AS aggregation,
             CAST(0.65 AS DOUBLE) AS confidence FROM p_ok),
  allv AS (SELECT "table", rule_no, seq, chart_type, title, x, y, aggregation, confidence FROM base
           UNION ALL SELECT * FROM t_spec UNION ALL SELECT * FROM c_spec UNION ALL SELECT * FROM h_spec)
  SELECT "table", CAST(position AS INTEGER) AS position, chart_type, title, x, y, aggregation, confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY rule_no, seq) - 1 AS position FROM allv) z WHERE position < 8""")


def _comparative_sql() -> str:
    parts = []
    for t in ROLE_TABLES:
        cols = O.SCHEMAS[t]
        for m, mk in cols:
            if mk != "numeric":
                continue
            for d, _ in cols:
                parts.append(f"""SELECT '{t}' AS "table", '{m}' AS measure, '{d}' AS compare_by, CAST({d} AS VARCHAR) AS category,
                  CAST(SUM(CAST({m} AS DECIMAL(38,6))) AS DOUBLE) AS value FROM {t} GROUP BY {d}""")
    allc = "\nUNION ALL\n".join(parts)
    return f"""WITH kd AS {KDEFS_SQL}, pairs AS (SELECT "table", split_part(source_columns, ',', 2) AS measure, compare_by FROM kd
      WHERE bucket = 'comparative_metrics')
      SELECT v.* FROM ({allc}) v JOIN pairs p ON p."table" = v."table" AND p.measure = v.measure AND p.compare_by = v.compare_by"""


Q["kpi_comparative"] = (Q["kpi_comparative"][0], _comparative_sql())


def _trend_injection_sql() -> str:
    cat = O.catalog_sql(["undated_orders"])
    src = O.SOURCES["undated_orders"]
    from ..functions.constants import DATE_FALLBACK_KEYWORDS, TREND_EXCLUDE_KEYWORDS
    cands = [(i, c) for i, (c, _) in enumerate(O.SCHEMAS["undated_orders"])
             if any(kw in c.lower().replace("_", " ") for kw in DATE_FALLBACK_KEYWORDS)]
    fb = "\nUNION ALL\n".join(
        f"SELECT {i} AS ordinal, '{c}' AS name, COUNT({O.dt_sql('v', True)}) / CAST(COUNT(*) AS DOUBLE) AS ratio FROM "
        f"(SELECT CAST({c} AS VARCHAR) AS v FROM {src} d WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT 200) s" for i, c in cands)
    return f"""WITH c AS {cat}, fb AS ({fb}),
      d0 AS (SELECT name FROM fb WHERE ratio >= 0.8 ORDER BY ordinal LIMIT 1),
      num AS (SELECT name, row_number() OVER (ORDER BY ordinal) AS k FROM c WHERE semantic_type = 'numeric' AND NOT {_has('lower(name)', TREND_EXCLUDE_KEYWORDS)})
      SELECT 'undated_orders' AS "table", CAST(3 - k AS INTEGER) AS seq, 'line' AS chart_type, num.name || ' over time' AS title, d0.name AS x,
        num.name AS y, 'sum' AS aggregation FROM num, d0 WHERE k <= 2"""


TRENDINJ_SQL = _trend_injection_sql()
Q["trend_injection"] = (Q["trend_injection"][0], TRENDINJ_SQL)
Q["spec_merge"] = (Q["spec_merge"][0], f"""WITH base AS (SELECT "table", seq, chart_type, title, x, y, aggregation FROM ({_baseline_sql_for(O.catalog_sql(["undated_orders"]))}) b0),
  inj AS ({TRENDINJ_SQL})
  SELECT "table", CAST(seq - 10 AS INTEGER) AS seq, chart_type, title, x, y, aggregation FROM inj WHERE title NOT IN (SELECT title FROM base)
  UNION ALL SELECT "table", CAST(seq AS INTEGER), chart_type, title, x, y, aggregation FROM base""")

#: Subqueries that oracles share, from the outer to the inner ones.
SHARED = {"flat_": FLAT_SQL, "kpi_definitions_": KDEFS_SQL, "role_positions_": RP_SQL, "roles_": ROLES_SQL,
          "catalog_roles_": CAT_ROLES, "catalog_rules_": CAT_REC}
Q = {k: (fn, sql and O.named(sql, SHARED)) for k, (fn, sql) in Q.items()}
