"""Registered queries: casts, type issues, outliers, quality scores, profiles (P*, Q*, R*, S4, S8, T4)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import casts
from ..functions.constants import DATE_FALLBACK_KEYWORDS, DATE_KEYWORDS, NA_TOKENS
from ..operators import charts, quality, profile, stats
from ..operators.stats import duplicate_rows
from . import oracle as O
from ..functions.rounding import py_round_sql as PR, py_round
from .common import catalog_for, r6, table

Q = {}


def reg(key, sql=None):
    def deco(fn):
        Q[key] = (fn, sql)
        return fn
    return deco


DIRTY = O.SOURCES["dirty_orders"]
CAT = O.catalog_sql(["dirty_orders"])
DCOLS = O.SCHEMAS["dirty_orders"]
STRINGS = [c for c, k in DCOLS if k == "string"]


# ---------------------------------------------------------------- S4 / P3 / P4 / P5 / P1
@reg("null_tokens", f"""SELECT o_orderkey, {", ".join(f"CASE WHEN {c} IN ({O.lit_list(NA_TOKENS)}) THEN NULL ELSE {c} END AS {c}" for c in STRINGS)}
  FROM {DIRTY} d""")
def q_null_tokens(spark, sf):
    """Text cells equal to a null token (``n/a``, ``NULL``, ...) become NULL."""
    d = table(spark, sf, "dirty_orders").select("o_orderkey", *STRINGS)
    return casts.null_tokens(d, STRINGS)


@reg("numeric_coercion", f"""SELECT o_orderkey, price_text, {O.num_sql('price_text')} AS price_number,
  {O.num_sql('flag_text')} AS flag_number FROM {DIRTY} d""")
def q_numeric_coercion(spark, sf):
    """Text -> double, NULL when not a plain number (no ``1d``/``1f``/hex/thousands)."""
    d = table(spark, sf, "dirty_orders")
    return d.select("o_orderkey", "price_text", casts.to_number(F.col("price_text")).alias("price_number"),
                    casts.to_number(F.col("flag_text")).alias("flag_number"))


@reg("datetime_coercion", f"""SELECT o_orderkey, date_text, {O.dt_sql('date_text', True)} AS parsed_dayfirst,
  {O.dt_sql('date_text', False)} AS parsed_monthfirst FROM {DIRTY} d""")
def q_datetime_coercion(spark, sf):
    """Explicit format lists, day-first or month-first."""
    d = table(spark, sf, "dirty_orders")
    return d.select("o_orderkey", "date_text", casts.to_datetime(F.col("date_text"), True).alias("parsed_dayfirst"),
                    casts.to_datetime(F.col("date_text"), False).alias("parsed_monthfirst"))


@reg("bool_domain", f"""SELECT name, builder_bool_domain, pipeline_bool_domain FROM (
  {" UNION ALL ".join(f"SELECT '{c}' AS name, COALESCE(BOOL_AND(lower(trim({c})) IN ({O.lit_list(['true','t','yes','y','1','false','f','no','n','0'])})), false) AS builder_bool_domain, COALESCE(BOOL_AND({c} IN ('True','False','true','false')), false) AND COUNT(DISTINCT {c}) <= 2 AS pipeline_bool_domain FROM {DIRTY} d" for c in STRINGS)}) u""")
def q_bool_domain(spark, sf):
    """Are all normalised values inside the boolean domain?"""
    cat = stats.basic_stats(table(spark, sf, "dirty_orders").select(*STRINGS), "dirty_orders")
    return cat.select("name", F.col("builder_bool").alias("builder_bool_domain"), F.col("pipeline_bool").alias("pipeline_bool_domain"))


@reg("drop_all_null", f"""SELECT COUNT(*) AS row_count, COUNT(*) FILTER (WHERE {" OR ".join(f"{c} IS NOT NULL" for c, _ in DCOLS)}) AS non_empty_rows,
  {len(DCOLS)} AS column_count, CASE WHEN COUNT(*) < 1 THEN 'too_few_rows' WHEN COUNT(*) FILTER (WHERE {" OR ".join(f"{c} IS NOT NULL" for c, _ in DCOLS)}) = 0 THEN 'all_rows_empty' ELSE 'ok' END AS status FROM {DIRTY} d""")
def q_drop_all_null(spark, sf):
    """Minimum requirements (rows >= 1, columns <= 500, some non-empty row)."""
    return quality.validate_min_requirements(table(spark, sf, "dirty_orders"))


# ---------------------------------------------------------------- Q5 / Q6 type issues
def _type_issue_sql(variant: str, dayfirst: bool = False) -> str:
    CAT = O.catalog_sql(["dirty_orders"], dayfirst)
    st = "semantic_type" if variant == "pipeline" else "semantic_type_builder"
    parts = []
    for c, k in DCOLS:
        if k not in ("string", "numeric", "datetime"):
            continue
        fail_num = f"({c} IS NOT NULL AND {O.value_num_sql(c, k)} IS NULL)"
        fail_dt = f"({c} IS NOT NULL AND {O.value_dt_sql(c, k, dayfirst)} IS NULL)"
        for t, fail in (("numeric", fail_num), ("datetime", fail_dt)):
            if variant == "pipeline":
                issue = "'Non-numeric values in numeric column'" if t == "numeric" else "'Unparseable datetime values'"
                sev = "CASE WHEN f.count / CAST(cat.n_rows AS DOUBLE) > 0.1 THEN 'high' ELSE 'medium' END" if t == "numeric" else "'medium'"
            else:
                issue = "'numeric_coercion_failed'" if t == "numeric" else "'datetime_parse_failed'"
                sev = "'high'"
            parts.append(f"""SELECT 'dirty_orders' AS "table", cat.ordinal, '{c}' AS name, {issue} AS issue, f.count,
              (SELECT string_agg(v, '|' ORDER BY rn) FROM (SELECT CAST({c} AS VARCHAR) AS v, row_number() OVER (ORDER BY o_orderkey) AS rn
                 FROM {DIRTY} x WHERE {fail} ORDER BY o_orderkey LIMIT 5) e) AS examples, {sev} AS severity
              FROM (SELECT COUNT(*) AS count FROM {DIRTY} y WHERE {fail}) f, {CAT} cat
              WHERE cat.name = '{c}' AND cat.{st} = '{t}' AND f.count > 0""")
    return "\nUNION ALL\n".join(parts)


@reg("type_issues", _type_issue_sql("pipeline"))
def q_type_issues(spark, sf):
    df, cat, _ = catalog_for(spark, sf, "dirty_orders")
    return quality.type_issues(df, cat, "dirty_orders", "o_orderkey", "pipeline")


@reg("type_issues_dayfirst", "\nUNION ALL\n".join(f"SELECT '{v}' AS variant, * FROM ({_type_issue_sql(v, True)}) i" for v in ("pipeline", "builder")))
def q_type_issues_dayfirst(spark, sf):
    """Q5/Q6: day-first date text with values that are no dates, under both variants."""
    df, cat, _ = catalog_for(spark, sf, "dirty_orders", dayfirst=True)
    failed = quality.failed_cells(df, cat, "dirty_orders", "o_orderkey", dayfirst=True)
    out = [quality.type_issues(df, cat, "dirty_orders", "o_orderkey", v, dayfirst=True, failed=failed).select(F.lit(v).alias("variant"), "*")
           for v in ("pipeline", "builder")]
    return out[0].unionByName(out[1])


# ---------------------------------------------------------------- Q3 / Q4 / P10 outliers
def _outlier_sql(variant: str) -> str:
    st = "semantic_type" if variant == "pipeline" else "semantic_type_builder"
    parts = []
    for c, k in DCOLS:
        if k not in ("string", "numeric"):
            continue
        v = O.value_num_sql(c, k)
        b = O.np_quantiles_sql(f"SELECT {v} AS v FROM {DIRTY} d", {"q1": 0.25, "q3": 0.75})
        fences = "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"
        cnt = f"(SELECT COUNT(*) FROM (SELECT {v} AS v FROM {DIRTY} d) z WHERE v < b.low OR v > b.high)"
        if variant == "pipeline":
            sel = f"{cnt} AS outlier_count, {PR('b.low', 4)} AS low, {PR('b.high', 4)} AS high"
        else:
            ok = "(b.n >= 4 AND b.q3 - b.q1 <> 0)"
            sel = (f"CASE WHEN {ok} THEN {cnt} ELSE 0 END AS outlier_count, CASE WHEN {ok} THEN b.low END AS low, "
                   f"CASE WHEN {ok} THEN b.high END AS high")
        parts.append(f"""SELECT 'dirty_orders' AS "table", cat.ordinal, '{c}' AS name, {sel}
          FROM (SELECT *, {fences[0]} AS low, {fences[1]} AS high FROM ({b}) bb) b, {CAT} cat
          WHERE cat.name = '{c}' AND cat.{st} = 'numeric' AND b.n > 0""")
    return "\nUNION ALL\n".join(parts)


@reg("outliers_pipeline", _outlier_sql("pipeline"))
def q_outliers_pipeline(spark, sf):
    _, cat, fk = catalog_for(spark, sf, "dirty_orders")
    return quality.iqr_outliers(fk, cat, "pipeline")


@reg("outliers_builder", _outlier_sql("builder"))
def q_outliers_builder(spark, sf):
    _, cat, fk = catalog_for(spark, sf, "dirty_orders")
    return quality.iqr_outliers(fk, cat, "builder")


@reg("outlier_rows", f"""WITH b AS (SELECT quantile_cont(price_outlier, 0.25) AS q1, quantile_cont(price_outlier, 0.75) AS q3 FROM {DIRTY} d)
  SELECT o_orderkey AS key, 'price_outlier' AS name, price_outlier AS value FROM {DIRTY} d, b
  WHERE price_outlier < q1 - 1.5 * (q3 - q1) OR price_outlier > q3 + 1.5 * (q3 - q1)""")
def q_outlier_rows(spark, sf):
    """P10: the rows behind the outlier counts (bounds broadcast, one row per column)."""
    df = table(spark, sf, "dirty_orders").select("o_orderkey", "price_outlier")
    cat, fk = stats.build_catalog(spark, df.select("price_outlier"), "dirty_orders")
    bounds = quality.iqr_outliers(fk, cat, "builder")
    rows = quality.outlier_rows(df, bounds, "dirty_orders", "o_orderkey")
    return rows.select("key", "name", "value")


# ---------------------------------------------------------------- Q7 - Q12
def _summary_sql() -> str:
    issues = _type_issue_sql("pipeline")
    outl_b = _outlier_sql("builder")
    dup = f"(SELECT COUNT(*) FROM {DIRTY} d) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {DIRTY} d) x)"
    return f"""WITH c AS {CAT},
    s AS (SELECT MAX(n_rows) AS row_count, COUNT(*) AS column_count, CAST(SUM(missing_count) AS BIGINT) AS total_missing,
            CAST(SUM(CASE WHEN is_empty THEN 1 ELSE 0 END) AS BIGINT) AS n_empty,
            CAST(SUM(CASE WHEN distinct_count <= 1 AND NOT is_empty THEN 1 ELSE 0 END) AS BIGINT) AS n_constant,
            SUM(CASE WHEN distinct_count = 1 AND NOT is_empty THEN 1 ELSE 0 END) AS n_constant_builder,
            SUM(CASE WHEN semantic_type_builder = 'numeric' THEN 1 ELSE 0 END) AS n_numeric_builder FROM c),
    t AS (SELECT s.*, {dup} AS duplicate_row_count, (SELECT COUNT(*) FROM ({issues}) i) AS n_type_issues,
            (SELECT SUM(outlier_count) FROM ({outl_b}) o) AS total_outliers_builder FROM s),
    u AS (SELECT *, {PR('total_missing / CAST(row_count * column_count AS DOUBLE)', 4)} AS missing_ratio_overall,
            {PR('duplicate_row_count / CAST(row_count AS DOUBLE)', 4)} AS duplicate_row_ratio,
            total_missing / CAST(row_count * column_count AS DOUBLE) AS mr, duplicate_row_count / CAST(row_count AS DOUBLE) AS dr FROM t)
    SELECT 'dirty_orders' AS "table", row_count, column_count, total_missing, missing_ratio_overall, duplicate_row_count,
      duplicate_row_ratio, n_empty, n_constant, n_type_issues,
      {PR('GREATEST(100.0 - LEAST(missing_ratio_overall * 100, 30.0) - LEAST(duplicate_row_ratio * 100, 20.0)\n        - LEAST(n_empty * 5, 15) - LEAST(n_constant * 3, 9) - LEAST(n_type_issues * 5, 15), 0.0)', 2)} AS quality_score,
      {PR('GREATEST(100.0 - (mr * 60.0 + dr * 20.0 + (n_empty / CAST(GREATEST(column_count, 1) AS DOUBLE)) * 10.0\n        + (n_constant_builder / CAST(GREATEST(column_count, 1) AS DOUBLE)) * 5.0\n        + CASE WHEN n_numeric_builder > 0 AND row_count > 0 THEN (total_outliers_builder / CAST(n_numeric_builder * row_count AS DOUBLE)) * 20.0 ELSE 0.0 END), 0.0)', 2)} AS quality_score_builder
    FROM u"""


SUMMARY_SQL = _summary_sql()


def _summary(spark, sf):
    df, cat, fk = catalog_for(spark, sf, "dirty_orders")
    dups = duplicate_rows(df, "dirty_orders")
    issues = quality.type_issues(df, cat, "dirty_orders", "o_orderkey", "pipeline")
    values = quality.numeric_values(fk, cat)
    outliers = partial(quality.iqr_outliers, fk, cat, quartiles=quality.value_quartiles(values), values=values)   # for either variant
    return quality.quality_summary(cat, dups, issues, outliers("builder")), cat, outliers


@reg("quality_score_pipeline", f"""SELECT "table", missing_ratio_overall, duplicate_row_ratio, n_empty, n_constant, n_type_issues, quality_score FROM ({SUMMARY_SQL}) q""")
def q_quality_pipeline(spark, sf):
    """Q7: 100 - capped penalties over 4-digit ratios, floor 0, 2 digits."""
    s, _, _ = _summary(spark, sf)
    return s.select("table", "missing_ratio_overall", "duplicate_row_ratio", "n_empty", "n_constant", "n_type_issues", "quality_score")


@reg("quality_score_builder", f"""SELECT "table", quality_score_builder FROM ({SUMMARY_SQL}) q""")
def q_quality_builder(spark, sf):
    """Q8: weighted penalties incl. the average outlier ratio."""
    s, _, _ = _summary(spark, sf)
    return s.select("table", "quality_score_builder")


@reg("quality_report", f"SELECT * FROM ({SUMMARY_SQL}) q")
def q_quality_report(spark, sf):
    """Q11: the whole report row (missing, duplicates, empties, constants, issues, both scores)."""
    s, _, _ = _summary(spark, sf)
    return s


@reg("quality_gate", f"""SELECT "table", quality_score, quality_score >= 40.0 AS passes FROM ({SUMMARY_SQL}) q""")
def q_quality_gate(spark, sf):
    """Q12: the declared score threshold (default 40), applied."""
    s, _, _ = _summary(spark, sf)
    return quality.quality_gate(s)


@reg("quality_quick", f"""WITH d AS (SELECT * FROM {DIRTY} x),
  m AS (SELECT COUNT(*) AS rows, {" + ".join(f"COUNT(*) - COUNT({c})" for c, _ in DCOLS)} AS missing FROM d),
  u AS (SELECT m.*, m.rows - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM d) y) AS dupes FROM m)
  SELECT 'dirty_orders' AS "table", rows, {len(DCOLS)} AS cols, missing, {PR('missing / CAST(rows * ' + str(len(DCOLS)) + ' AS DOUBLE) * 100', 2)} AS missing_pct,
    dupes, {PR('dupes / CAST(rows AS DOUBLE) * 100', 2)} AS dupe_pct,
    {PR('GREATEST(0.0, LEAST(100.0, 100.0 - (missing / CAST(rows * ' + str(len(DCOLS)) + ' AS DOUBLE) * 100) * 1.5 - (dupes / CAST(rows AS DOUBLE) * 100) * 0.5))', 1)} AS score FROM u""")
def q_quality_quick(spark, sf):
    """Q9: the upload-page score (1.5 x missing % + 0.5 x duplicate %)."""
    return quality.quick_quality(table(spark, sf, "dirty_orders"), "dirty_orders")


def _pct_sql(e: str) -> str:
    return "(printf('%.1f', " + PR(f"({e}) * 100.0", 1) + ") || '%')"


_Q = "'"
QW_SQL = (
    f"WITH c AS {CAT}, s AS ({SUMMARY_SQL}), o AS ({_outlier_sql('pipeline')})\n"
    f"SELECT \"table\", 1 AS seq, 'missing_overall' AS code, 'warning' AS level, "
    f"'Overall missing ratio is ' || {_pct_sql('missing_ratio_overall')} || ' (threshold: 5%).' AS message "
    f"FROM s WHERE missing_ratio_overall > 0.05\n"
    f"UNION ALL SELECT \"table\", 100 + ordinal, 'missing_column', 'warning', "
    f"'Column {_Q}{_Q}' || name || '{_Q}{_Q} has ' || {_pct_sql(PR('missing_ratio', 4))} || ' missing values.' "
    f"FROM c WHERE {PR('missing_ratio', 4)} > 0.3\n"
    f"UNION ALL SELECT \"table\", 2000, 'duplicates', 'warning', duplicate_row_count || ' duplicate rows detected (' || "
    f"{_pct_sql('duplicate_row_ratio')} || ' of data).' FROM s WHERE duplicate_row_ratio > 0.05\n"
    f"UNION ALL SELECT \"table\", 3000, 'outliers', 'warning', SUM(outlier_count) || ' outlier values detected across ' || "
    f"COUNT(*) || ' numeric column(s).' FROM o WHERE outlier_count > 0 GROUP BY \"table\"\n"
    f"UNION ALL SELECT \"table\", 4000, 'constant_columns', 'warning', 'Constant (single-value) columns: [{_Q}{_Q}' || "
    f"string_agg(name, '{_Q}{_Q}, {_Q}{_Q}' ORDER BY ordinal) || '{_Q}{_Q}]' FROM c WHERE distinct_count <= 1 AND NOT is_empty GROUP BY \"table\"\n"
    f"UNION ALL SELECT \"table\", 5000, 'empty_columns', 'error', 'Fully empty columns: [{_Q}{_Q}' || "
    f"string_agg(name, '{_Q}{_Q}, {_Q}{_Q}' ORDER BY ordinal) || '{_Q}{_Q}]' FROM c WHERE is_empty GROUP BY \"table\""
)


@reg("quality_warnings", QW_SQL)
def q_quality_warnings(spark, sf):
    """Q10: warning/error rows of the pipeline report."""
    s, cat, outliers = _summary(spark, sf)
    return quality.quality_warnings(cat, s, outliers("pipeline"))


def _report_sql(variant: str) -> str:
    score = "quality_score" if variant == "pipeline" else "quality_score_builder"
    said = QW_SQL if variant == "pipeline" else f"""WITH c AS {CAT}, s AS ({SUMMARY_SQL})
      SELECT "table", 1 AS seq, 'Found empty columns: [''' || string_agg(name, ''', ''' ORDER BY ordinal) || ''']' AS message, 'warning' AS level FROM c WHERE is_empty GROUP BY 1
      UNION ALL SELECT "table", 2, 'Found constant columns: [''' || string_agg(name, ''', ''' ORDER BY ordinal) || ''']', 'warning' FROM c WHERE distinct_count = 1 GROUP BY 1
      UNION ALL SELECT "table", 3, 'Found ' || duplicate_row_count || ' duplicate rows.', 'warning' FROM s WHERE duplicate_row_count > 0
      UNION ALL SELECT "table", 4, 'Found ' || total_missing || ' missing values in total.', 'warning' FROM s WHERE total_missing > 0"""
    return f"""WITH w AS ({said}), o AS ({_outlier_sql(variant)}), i AS ({_type_issue_sql(variant)}), k AS {CAT}, s AS ({SUMMARY_SQL})
      SELECT "table", row_count, column_count, total_missing, duplicate_row_count, {score} AS quality_score,
        (SELECT string_agg(name || '=' || missing_count, ',' ORDER BY ordinal) FROM k) AS missing_by_column,
        (SELECT string_agg(name, ',' ORDER BY ordinal) FROM k WHERE is_empty) AS empty_columns,
        (SELECT string_agg(name, ',' ORDER BY ordinal) FROM k WHERE distinct_count <= 1 AND NOT is_empty) AS constant_columns,
        (SELECT string_agg(name || '=' || outlier_count, ',' ORDER BY ordinal) FROM o) AS outliers,
        (SELECT COALESCE(string_agg(name || ': ' || issue || ' ' || count || ' ' || examples || ' ' || severity, ',' ORDER BY ordinal), '') FROM i) AS type_issues,
        (SELECT COALESCE(string_agg(message, '|' ORDER BY seq) FILTER (WHERE level = 'warning'), '') FROM w) AS warnings,
        (SELECT COALESCE(string_agg(message, '|' ORDER BY seq) FILTER (WHERE level = 'error'), '') FROM w) AS errors FROM s"""


def _report(spark, sf, variant):
    df, cat, fk = catalog_for(spark, sf, "dirty_orders")
    typed = [r["name"] for r in cat.where("semantic_type = 'numeric' or semantic_type_builder = 'numeric'").select("name").collect()]
    quarters = stats.column_quartiles(df, "dirty_orders", typed)
    failed = quality.failed_cells(df, cat, "dirty_orders", "o_orderkey")
    issues = {v: quality.type_issues(df, cat, "dirty_orders", "o_orderkey", v, failed=failed) for v in {"pipeline", variant}}
    ob = quality.iqr_outliers(fk, cat, "builder", quartiles=quarters)
    s = quality.quality_summary(cat, duplicate_rows(df, "dirty_orders"), issues["pipeline"], ob)
    out = ob if variant == "builder" else quality.iqr_outliers(fk, cat, "pipeline", quartiles=quarters)
    said = quality.builder_warnings(cat, s) if variant == "builder" else quality.quality_warnings(cat, s, out)
    r = quality.full_report(cat, s, out, issues[variant], said, variant)
    lines = lambda c, fn: F.coalesce(F.array_join(F.transform(c, fn), ","), F.lit(""))
    text = lambda c: c.cast("string")
    return r.select(
        "table", "row_count", "column_count", "total_missing", "duplicate_row_count", "quality_score",
        lines(F.map_entries("missing_by_column"), lambda x: F.concat_ws("=", x["key"], text(x["value"]))).alias("missing_by_column"),
        F.array_join("empty_columns", ",").alias("empty_columns"), F.array_join("constant_columns", ",").alias("constant_columns"),
        lines("outliers", lambda x: F.concat_ws("=", x["name"], text(x["outlier_count"]))).alias("outliers"),
        lines("type_issues", lambda x: F.concat(x["name"], F.lit(": "), F.concat_ws(" ", x["issue"], text(x["count"]), x["examples"], x["severity"]))).alias("type_issues"),
        F.array_join("warnings", "|").alias("warnings"), F.array_join("errors", "|").alias("errors"))


@reg("quality_report_full", _report_sql("pipeline"))
def q_quality_report_full(spark, sf):
    """Q11: the nested pipeline report, its lists joined as text."""
    return _report(spark, sf, "pipeline")


@reg("quality_report_builder", _report_sql("builder"))
def q_quality_report_builder(spark, sf):
    """Q11: the nested builder report with its own warnings and issues."""
    return _report(spark, sf, "builder")


@reg("profile_notes", f"""SELECT 'embeddings' AS "table", 1 AS ordinal, 'embedding' AS name, 'unknown' AS semantic_type, 'unknown:values_of_no_known_type' AS note
  WHERE EXISTS (SELECT 1 FROM embeddings WHERE embedding IS NOT NULL)""")
def q_profile_notes(spark, sf):
    """R1 notes: columns with values of no known type (an empty column has no note)."""
    out = []
    for t in ("embeddings", "dirty_orders"):
        df, cat, fk = catalog_for(spark, sf, t)
        prof, _ = profile.profile_report(df, cat, fk, t)
        out.append(profile.profile_notes(prof))
    return out[0].unionByName(out[1])


@reg("catalog_samples", f"""SELECT 'customer' AS "table", name, string_agg(value, '|' ORDER BY position) AS sample_values FROM (
  SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY k) AS position FROM (
  {" UNION ALL ".join(f"SELECT '{c}' AS name, c_custkey AS k, CAST({c} AS VARCHAR) AS value FROM customer WHERE {c} IS NOT NULL" for c, _ in O.SCHEMAS["customer"])}
  ) u) WHERE position <= 5 GROUP BY 2""")
def q_catalog_samples(spark, sf):
    """Q2: the catalog with its sample values."""
    df, cat, _ = catalog_for(spark, sf, "customer")
    return stats.with_samples(cat, df, "c_custkey", table="customer").select("table", "name", F.array_join("sample_values", "|").alias("sample_values"))


#: Values that cuts, fixed decimals and narrow rounding would change; sums of them are exact in any order.
EXTREME_SQL = """(SELECT o_orderkey, o_orderkey / CAST(1073741824 AS DOUBLE) / 1024 AS tiny, o_orderkey * CAST(1.2980742146337069e33 AS DOUBLE) AS huge,
    1700000000000000000 + CAST(o_orderkey AS BIGINT) * 1024 AS epoch, CASE WHEN o_orderkey % 1000 = 7 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(o_orderkey AS DOUBLE) END AS endless,
    repeat(o_orderpriority || ' ', 40) || o_orderstatus AS long_text FROM orders)"""


def _extreme(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", (k / F.lit(1073741824.0) / 1024).alias("tiny"), (k * F.lit(1.2980742146337069e33)).alias("huge"),
        (F.lit(1700000000000000000) + k * 1024).alias("epoch"), F.when(k % 1000 == 7, F.lit(float("inf"))).otherwise(k.cast("double")).alias("endless"),
        F.concat(F.repeat(F.concat("o_orderpriority", F.lit(" ")), F.lit(40)), F.col("o_orderstatus")).alias("long_text"))


@reg("extreme_profile", "\nUNION ALL\n".join(f"""SELECT '{c}' AS name, COUNT({c}) AS count, {'CAST(NULL AS DOUBLE)' if c == 'endless' else f'SUM(CAST({c} AS DOUBLE)) / COUNT({c})'} AS mean,
  CAST(MIN({c}) AS DOUBLE) AS min, CASE WHEN isinf(CAST(MAX({c}) AS DOUBLE)) THEN NULL ELSE CAST(MAX({c}) AS DOUBLE) END AS max, CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq FROM {EXTREME_SQL} e"""
  for c in ("tiny", "huge", "endless")) + f"""\nUNION ALL SELECT 'long_text', (SELECT COUNT(*) FROM orders), NULL, NULL, NULL, t.top, t.freq FROM (
  SELECT long_text AS top, COUNT(*) AS freq FROM {EXTREME_SQL} e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) t""")
def q_extreme_profile(spark, sf):
    """R1 on tiny and huge numbers, infinity and long categories."""
    df = _extreme(spark, sf)
    cat, fk = stats.build_catalog(spark, df, "extreme")
    prof, _ = profile.profile_report(df, cat, fk, "extreme")
    return prof.where(F.col("name").isin("tiny", "huge", "endless", "long_text")).select("name", "count", "mean", "min", "max", "top", "freq")


@reg("extreme_outliers", "\nUNION ALL\n".join(f"""SELECT '{c}' AS name, CAST(0 AS BIGINT) AS outlier_count, {PR('q1 - 1.5 * (q3 - q1)', 4)} AS low, {PR('q3 + 1.5 * (q3 - q1)', 4)} AS high
  FROM ({O.np_quantiles_sql(f"SELECT CAST({c} AS DOUBLE) AS v FROM {EXTREME_SQL} e", {"q1": 0.25, "q3": 0.75})}) b""" for c in ("epoch", "huge")))
def q_extreme_outliers(spark, sf):
    """Q3 on epochs and huge numbers: fences keep their size."""
    cat, fk = stats.build_catalog(spark, _extreme(spark, sf).select("epoch", "huge"), "extreme")
    return quality.iqr_outliers(fk, cat, "pipeline").select("name", F.col("outlier_count").cast("long").alias("outlier_count"), "low", "high")


@reg("csv_dialect", "\nUNION ALL\n".join(f"SELECT '{t}' AS \"table\", COUNT(*) AS rows, COUNT(*) AS same FROM {t}" for t in ("documents", "pages", "conversations")))
def q_csv_dialect(spark, sf):
    """Texts with quotes, commas, blanks and line ends come back byte for byte."""
    from ..session import scratch_path
    from ..sources.readers import read_csv
    from ..sources.sinks import write_csv

    out = None
    for t, key, c in (("documents", ["doc_id"], "text"), ("pages", ["page_id"], "html"), ("conversations", ["conv_id", "turn"], "text")):
        df = table(spark, sf, t).select(*[F.col(k).cast("string").alias(k) for k in key], F.col(c).alias("was"))
        back = read_csv(spark, write_csv(df, scratch_path(spark, "csv"))).withColumnRenamed("was", "now")
        one = df.join(back, key).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("was") == F.col("now")).alias("same"))
        one = one.select(F.lit(t).alias("table"), "rows", "same")
        out = one if out is None else out.unionByName(one)
    return out


@reg("csv_split", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents UNION ALL SELECT conv_id || '/' || turn, text, role FROM conversations")
def q_csv_split(spark, sf):
    """Files with line ends inside quotes, written by as many tasks as read the tables and cut into small splits, give back their rows."""
    from ..session import scratch_path, stage
    from ..sources.csv_split import parsed, records
    from ..sources.readers import CSV_DIALECT
    from ..sources.sinks import write_csv

    df = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang").unionByName(
        table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("doc_id"), "text", F.col("role").alias("lang")))
    path = write_csv(df, scratch_path(spark, "csv"))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        text, _ = records(spark, path)
        return stage(parsed(text, 3, CSV_DIALECT).select(F.col("c0").alias("doc_id"), F.col("c1").alias("text"), F.col("c2").alias("lang")), "rows")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


# ---------------------------------------------------------------- R1 / R2 profiles
def _profile_sql(variant: str) -> str:
    st = "semantic_type" if variant == "pipeline" else "semantic_type_builder"
    parts = []
    for c, k in DCOLS:
        v = O.value_num_sql(c, k)
        d = O.value_dt_sql(c, k)
        num = (f"SELECT COUNT(v) AS n, CAST(SUM(CAST(v AS DECIMAL(38,6))) AS DOUBLE) / COUNT(v) AS mean, STDDEV_SAMP(v) AS std, MIN(v) AS mn, "
               f"quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, MAX(v) AS mx "
               f"FROM (SELECT {v} AS v FROM {DIRTY} x) z")
        top = (f"SELECT CAST({c} AS VARCHAR) AS top, COUNT(*) AS freq FROM {DIRTY} x WHERE {c} IS NOT NULL GROUP BY 1 "
               f"ORDER BY freq DESC, top ASC LIMIT 1")
        dts = f"SELECT COUNT(t) AS n, MIN(t) AS mn, MAX(t) AS mx FROM (SELECT {d} AS t FROM {DIRTY} x) z"
        std = "n.std" if variant == "pipeline" else "CASE WHEN n.n = 1 THEN 0.0 ELSE n.std END"
        mr = PR('cat.missing_ratio', 4) if variant == "pipeline" else "cat.missing_ratio"
        al = PR('cat.avg_len', 2) if variant == "pipeline" else "cat.avg_len"
        s = f"cat.{st}"
        parts.append(f"""SELECT cat."table", cat.ordinal, cat.name, {s} AS semantic_type, cat.missing_count, {mr} AS missing_ratio,
          CAST(CASE WHEN {s} = 'numeric' THEN n.n WHEN {s} IN ('categorical', 'boolean') THEN cat.non_null
               WHEN {s} = 'datetime' THEN dt.n WHEN {s} = 'text' THEN cat.non_null END AS BIGINT) AS count,
          CASE WHEN {s} = 'numeric' THEN n.mean END AS mean, CASE WHEN {s} = 'numeric' THEN round({std}, 6) END AS std,
          CASE WHEN {s} = 'numeric' THEN n.mn END AS min, CASE WHEN {s} = 'numeric' THEN round(n.p25, 6) END AS p25,
          CASE WHEN {s} = 'numeric' THEN round(n.p50, 6) END AS median, CASE WHEN {s} = 'numeric' THEN round(n.p75, 6) END AS p75,
          CASE WHEN {s} = 'numeric' THEN n.mx END AS max,
          CASE WHEN {s} IN ('categorical', 'boolean') THEN cat.distinct_count END AS "unique",
          CASE WHEN {s} IN ('categorical', 'boolean') THEN t.top END AS top,
          CASE WHEN {s} IN ('categorical', 'boolean') THEN t.freq END AS freq,
          CASE WHEN {s} = 'datetime' THEN {O.iso_sql('dt.mn')} END AS dt_min,
          CASE WHEN {s} = 'datetime' THEN {O.iso_sql('dt.mx')} END AS dt_max,
          CASE WHEN {s} = 'text' AND cat.non_null > 0 THEN {al} END AS avg_length,
          CAST(CASE WHEN {s} = 'text' AND cat.non_null > 0 THEN cat.min_len END AS INTEGER) AS min_length,
          CAST(CASE WHEN {s} = 'text' AND cat.non_null > 0 THEN cat.max_len END AS INTEGER) AS max_length
        FROM {CAT} cat, ({num}) n, ({dts}) dt LEFT JOIN ({top}) t ON true WHERE cat.name = '{c}'""")
    return "\nUNION ALL\n".join(parts)


def _profile(spark, sf, variant):
    df, cat, fk = catalog_for(spark, sf, "dirty_orders")
    prof, _ = profile.profile_report(df, cat, fk, "dirty_orders", variant)
    return prof.select("table", "ordinal", "name", "semantic_type", "missing_count", "missing_ratio", "count", "mean",
                       r6("std").alias("std"), "min", r6("p25").alias("p25"), r6("median").alias("median"),
                       r6("p75").alias("p75"), "max", "unique", "top", "freq", "dt_min", "dt_max", "avg_length",
                       "min_length", "max_length")


@reg("profile_report", _profile_sql("pipeline"))
def q_profile_report(spark, sf):
    """Per-column profile by pipeline semantic type."""
    return _profile(spark, sf, "pipeline")


@reg("profile_report_builder", _profile_sql("builder"))
def q_profile_report_builder(spark, sf):
    """R2: builder variant (std 0.0 for one value, unrounded ratios)."""
    return _profile(spark, sf, "builder")


# ---------------------------------------------------------------- S8 / T4 dates by name
@reg("date_autoparse", f"""SELECT o_orderkey, {O.dt_sql('date_text', True)} AS date_text, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate
  FROM {DIRTY} d""")
def q_date_autoparse(spark, sf):
    """Every column whose lower-cased name contains a date keyword is parsed day-first."""
    from ..sources.readers import autoparse_dates

    d = table(spark, sf, "dirty_orders").select("o_orderkey", "date_text", "o_orderdate")
    return autoparse_dates(d, DATE_KEYWORDS)


@reg("date_fallback", f"""WITH c AS {CAT} SELECT name, ratio, ratio >= 0.8 AS is_date FROM (
  {" UNION ALL ".join(f"SELECT '{c}' AS name, COUNT({O.value_dt_sql('v', k, True)}) / CAST(COUNT(*) AS DOUBLE) AS ratio FROM (SELECT {c} AS v FROM {DIRTY} d WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT 200) s HAVING COUNT(*) > 0" for c, k in DCOLS if any(kw in c.lower().replace('_', ' ') for kw in DATE_FALLBACK_KEYWORDS))}
  ) u WHERE name NOT IN (SELECT name FROM c WHERE semantic_type = 'datetime')""")
def q_date_fallback(spark, sf):
    """T4: name has a date keyword, not typed datetime, first 200 values parse day-first >= 80 %."""
    from ..operators.spec_checks import date_fallback

    df, cat, _ = catalog_for(spark, sf, "dirty_orders")
    return date_fallback(df, cat, "dirty_orders", "o_orderkey")


# ---------------------------------------------------------------- A19 box plot
@reg("boxplot_stats", f"""WITH v AS (SELECT l_extendedprice AS x FROM lineitem WHERE l_extendedprice IS NOT NULL),
  q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM v),
  f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS hf FROM q)
  SELECT COUNT(*) AS count, MIN(x) AS min, round(MIN(f.q1), 6) AS q1, round(MIN(f.med), 6) AS median, round(MIN(f.q3), 6) AS q3, MAX(x) AS max,
    round(MIN(lf), 6) AS low_fence, round(MIN(hf), 6) AS high_fence, MIN(x) FILTER (WHERE x >= lf AND x <= hf) AS whisker_low,
    MAX(x) FILTER (WHERE x >= lf AND x <= hf) AS whisker_high, COUNT(*) FILTER (WHERE x < lf OR x > hf) AS n_outliers FROM v, f""")
def q_boxplot(spark, sf):
    """Five-number summary, 1.5 IQR fences and whiskers of one measure."""
    b = charts.box_stats(table(spark, sf, "lineitem"), "l_extendedprice")
    return b.select("count", "min", r6("q1").alias("q1"), r6("median").alias("median"), r6("q3").alias("q3"), "max",
                    r6("low_fence").alias("low_fence"), r6("high_fence").alias("high_fence"), "whisker_low", "whisker_high", "n_outliers")


# ---------------------------------------------------------------- S9 / S10 / S11 sinks
@reg("scan_roundtrip", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, o_orderpriority FROM orders""")
def q_scan_roundtrip(spark, sf):
    """S9 + S1: write orders as CSV to the shared folder, read it back all-string, cast back."""
    from ..session import scratch_path
    from ..sources.readers import read_csv
    from ..sources.sinks import write_csv

    o = table(spark, sf, "orders")
    path = write_csv(o, scratch_path(spark, "csv"))
    back = read_csv(spark, path)
    return back.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"),
                       "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"),
                       F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_orderpriority")


@reg("extract_parquet", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, o_orderpriority FROM orders""")
def q_extract_parquet(spark, sf):
    """The table written as a partitioned Parquet extract and re-read."""
    from ..session import scratch_path
    from ..sources.sinks import write_extract

    o = table(spark, sf, "orders")
    path = write_extract(o, scratch_path(spark, "extract"), ["o_orderstatus"])
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                                           "o_orderpriority")


@reg("extract_observed", f"""SELECT name, kind, n_rows, missing_count, {PR("missing_ratio", 4)} AS missing_ratio, is_empty,
  distinct_count = 1 AND NOT is_empty AS single_valued, n_rows AS rows_in_extract FROM {O.catalog_sql(["dirty_orders"])}""")
def q_extract_observed(spark, sf):
    """S10 + Q1/Q11: the counts of the extract come from the job that writes it; its rows are counted again here."""
    from ..session import scratch_path
    from ..sources.sinks import write_extract_observed

    path = scratch_path(spark, "extract")
    seen = write_extract_observed(table(spark, sf, "dirty_orders"), path, ["o_orderstatus"])
    return seen.select("name", "kind", "n_rows", "missing_count", py_round(F.col("missing_ratio"), 4).alias("missing_ratio"),
                       "is_empty", "single_valued", F.lit(spark.read.parquet(path).count()).cast("long").alias("rows_in_extract"))


@reg("report_json", f"""SELECT "table", row_count, quality_score FROM ({SUMMARY_SQL}) q""")
def q_report_json(spark, sf):
    """The quality report written as JSON and read back."""
    from ..session import scratch_path
    from ..sources.sinks import write_report_json

    s, _, _ = _summary(spark, sf)
    path = write_report_json(s, scratch_path(spark, "report"))
    back = spark.read.schema("table string, row_count long, quality_score double").json(path)
    return back


#: Subqueries that oracles share, from the outer to the inner ones.
SHARED = {
    "summary_": f"({SUMMARY_SQL})",
    **{f"issues_{v}{'_dayfirst' * d}": f"({_type_issue_sql(v, d)})" for v in ("pipeline", "builder") for d in (False, True)},
    **{f"outliers_{v}": f"({_outlier_sql(v)})" for v in ("pipeline", "builder")},
    "catalog_dayfirst": O.catalog_sql(["dirty_orders"], True), "catalog_": CAT, "dirty_": DIRTY,
}
Q = {k: (fn, sql and O.named(sql, SHARED)) for k, (fn, sql) in Q.items()}
