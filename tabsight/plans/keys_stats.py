"""Registered queries: scans, casts, column statistics (S*, P*, A*, T*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rounding import py_round

from ..functions import casts
from ..functions.constants import EDA_SAMPLE_VALUES, HISTOGRAM_BINS, PREVIEW_ROWS, SAMPLE_VALUES_COUNT
from ..operators import charts, comoments, dates, heavy, incremental, quantiles, semantic, stats
from ..operators.freq import static_catalog, value_frequencies, with_kind
from . import oracle as O
from ..functions.rounding import py_round_sql as PR
from .common import catalog_for, multi_catalog, r6, table

Q = {}


def reg(key, sql=None):
    def deco(fn):
        Q[key] = (fn, sql)
        return fn
    return deco


DIRTY = O.SOURCES["dirty_orders"]
CAT_DIRTY = O.catalog_sql(["dirty_orders"])
TYPE_TABLES = ["dirty_orders", "labels", "documents", "events", "customer"]
CAT_TYPES = O.catalog_sql(TYPE_TABLES)


# ---------------------------------------------------------------- A1 shape
SHAPE_TABLES = ["orders", "lineitem", "customer", "part", "events", "documents", "labels", "conversations"]


@reg("dataset_shape", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS \"table\", (SELECT COUNT(*) FROM {t}) AS row_count, "
    f"(SELECT COUNT(*) FROM information_schema.columns WHERE table_name = '{t}') AS column_count" for t in SHAPE_TABLES))
def q_dataset_shape(spark, sf):
    out = None
    for t in SHAPE_TABLES:
        df = table(spark, sf, t)
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(t).alias("table"), "row_count", F.lit(len(df.columns)).cast("long").alias("column_count"))
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- Q2/A24 catalog
@reg("column_catalog", f"""SELECT "table", ordinal, name, kind, n_rows, missing_count, {PR("missing_ratio", 4)} AS missing_ratio,
  distinct_count, distinct_count <= 1 AS is_constant, is_empty, semantic_type FROM {CAT_DIRTY}""")
def q_column_catalog(spark, sf):
    _, cat, _ = catalog_for(spark, sf, "dirty_orders")
    return cat.select("table", "ordinal", "name", "kind", "n_rows", "missing_count",
                      py_round(F.col("missing_ratio"), 4).alias("missing_ratio"), "distinct_count",
                      (F.col("distinct_count") <= 1).alias("is_constant"), "is_empty", "semantic_type")


@reg("catalog_incremental", f"""SELECT "table", ordinal, name, kind, n_rows, missing_count, min_len, max_len, num_parsed, dt_parsed, num_min, num_max,
  CASE WHEN distinct_count <= 50 THEN distinct_count END AS few_distinct, is_empty, semantic_type, semantic_type_builder FROM {CAT_DIRTY}""")
def q_catalog_incremental(spark, sf):
    """Q2/A5: states of the orders before 1998, of 1998 to 1999, and of the rest, merged; each row is scanned once."""
    from ..session import scratch_path

    df, path, day = table(spark, sf, "dirty_orders"), scratch_path(spark, "states"), F.col("o_orderdate")
    old = F.coalesce(day < "1998-01-01", F.lit(False))
    for part, rows in {"base": old, "1998": ~old & (day < "2000-01-01"), "rest": ~old & F.coalesce(day >= "2000-01-01", F.lit(True))}.items():
        incremental.add_part(df.where(rows), path, "dirty_orders", part)
    cat = incremental.merged_catalog(spark, path, "dirty_orders")
    few = F.when(F.col("distinct_count") <= 50, F.col("distinct_count"))
    return cat.select("table", "ordinal", "name", "kind", "n_rows", "missing_count", F.col("min_len").cast("long").alias("min_len"),
                      F.col("max_len").cast("long").alias("max_len"), "num_parsed", "dt_parsed", "num_min", "num_max", few.alias("few_distinct"), "is_empty", "semantic_type", "semantic_type_builder")


@reg("missing_by_column", f"""SELECT name, missing_count, {PR("missing_ratio", 4)} AS missing_ratio,
  round(100.0 * missing_count / n_rows, 2) AS missing_pct FROM {CAT_DIRTY}""")
def q_missing_by_column(spark, sf):
    cat = stats.basic_stats(table(spark, sf, "dirty_orders"), "dirty_orders")
    return cat.select("name", "missing_count", py_round(F.col("missing_ratio"), 4).alias("missing_ratio"),
                      F.round(F.col("missing_count") * 100.0 / F.col("n_rows"), 2).alias("missing_pct"))


@reg("missing_overall", f"""SELECT CAST(SUM(missing_count) AS BIGINT) AS total_missing, MAX(n_rows) * COUNT(*) AS total_cells,
  {PR("SUM(missing_count) / CAST(MAX(n_rows) * COUNT(*) AS DOUBLE)", 4)} AS missing_ratio_overall FROM {CAT_DIRTY}""")
def q_missing_overall(spark, sf):
    cat = stats.basic_stats(table(spark, sf, "dirty_orders"), "dirty_orders")
    return cat.agg(F.sum("missing_count").alias("total_missing"),
                   (F.max("n_rows") * F.count(F.lit(1))).alias("total_cells")).select(
        "total_missing", "total_cells", py_round(F.col("total_missing") / F.col("total_cells"), 4).alias("missing_ratio_overall"))


@reg("missing_table", f"""SELECT name, missing_count, round(100.0 * missing_count / n_rows, 2) AS missing_pct
  FROM {CAT_DIRTY} WHERE missing_count > 0""")
def q_missing_table(spark, sf):
    """Only columns with missing values, by count descending."""
    cat = stats.basic_stats(table(spark, sf, "dirty_orders"), "dirty_orders")
    return (cat.where(F.col("missing_count") > 0)
            .select("name", "missing_count", F.round(F.col("missing_count") * 100.0 / F.col("n_rows"), 2).alias("missing_pct"))
            .orderBy(F.desc("missing_count"), "name"))


@reg("distinct_counts", f"""SELECT "table", name, distinct_count FROM {O.catalog_sql(["dirty_orders", "lineitem"])}""")
def q_distinct_counts(spark, sf):
    cat = multi_catalog(spark, sf, ["dirty_orders", "lineitem"])
    return cat.select("table", "name", "distinct_count")


@reg("constant_columns", f"""SELECT name, distinct_count <= 1 AND NOT is_empty AS is_constant,
  distinct_count = 1 AND NOT is_empty AS is_constant_builder, is_empty FROM {CAT_DIRTY}""")
def q_constant_columns(spark, sf):
    cat = stats.basic_stats(table(spark, sf, "dirty_orders"), "dirty_orders")
    return cat.select("name", F.col("single_valued").alias("is_constant"), F.col("single_valued").alias("is_constant_builder"), "is_empty")


# ---------------------------------------------------------------- A0 / A12 / A13 / A7 / S7
VC_COLS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


@reg("value_counts", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS count FROM lineitem GROUP BY {c}" for c in VC_COLS))
def q_value_counts(spark, sf):
    li = table(spark, sf, "lineitem")
    return value_frequencies(li, "lineitem", VC_COLS).select("name", "value", F.col("cnt").alias("count"))


TOPK = [("orders", "o_orderpriority"), ("orders", "o_orderstatus"), ("customer", "c_mktsegment"),
        ("customer", "c_nationkey"), ("part", "p_brand"), ("part", "p_size")]


def _topk_sql(k):
    parts = [f"""SELECT '{t}' AS "table", '{c}' AS name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS count FROM {t}
             WHERE {c} IS NOT NULL GROUP BY {c}""" for t, c in TOPK]
    body = "\nUNION ALL\n".join(parts)
    return f"""SELECT "table", name, CAST(rank AS INTEGER) AS rank, value, count FROM (
      SELECT *, row_number() OVER (PARTITION BY "table", name ORDER BY count DESC, value ASC) AS rank FROM ({body}) u)
      WHERE rank <= {k}"""


@reg("topk_values", _topk_sql(10))
def q_topk_values(spark, sf):
    out = None
    for t in sorted({t for t, _ in TOPK}):
        df = table(spark, sf, t)
        cols = [c for tt, c in TOPK if tt == t]
        fk = with_kind(value_frequencies(df, t, cols), static_catalog(spark, df, t))
        one = stats.topk_values(fk, 10).select("table", "name", "rank", "value", "count")
        out = one if out is None else out.unionByName(one)
    return out


NULL_COLS = ["flag_text", "empty_col", "price_text", "date_text", "o_orderstatus", "constant_col"]


@reg("topk_with_nulls", f"""SELECT name, CAST(rank AS INTEGER) AS rank, value, count FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY count DESC, value ASC) AS rank FROM (
  {" UNION ALL ".join(f"SELECT '{c}' AS name, COALESCE(CAST({c} AS VARCHAR), 'nan') AS value, COUNT(*) AS count FROM {DIRTY} d GROUP BY 2" for c in NULL_COLS)}
  ) u) WHERE rank <= 10""")
def q_topk_with_nulls(spark, sf):
    """Top-10 per categorical column where missing is its own 'nan' value (<= 6 columns)."""
    d = table(spark, sf, "dirty_orders").select(*[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in NULL_COLS])
    fk = with_kind(value_frequencies(d, "dirty_orders"), static_catalog(spark, d, "dirty_orders"))
    return stats.topk_values(fk, 10).select("name", "rank", "value", "count")


@reg("sample_values", f"""SELECT name, CAST(position AS INTEGER) AS position, value FROM (
  SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY k) AS position FROM (
  {" UNION ALL ".join(f"SELECT '{c}' AS name, c_custkey AS k, CAST({c} AS VARCHAR) AS value FROM customer WHERE {c} IS NOT NULL" for c, _ in O.SCHEMAS["customer"])}
  ) u) WHERE position <= {SAMPLE_VALUES_COUNT}""")
def q_sample_values(spark, sf):
    """First 5 non-null values per column in key order."""
    cu = table(spark, sf, "customer")
    return stats.first_values(cu, "c_custkey", SAMPLE_VALUES_COUNT).select("name", "position", "value")


@reg("preview_rows", f"SELECT * FROM orders ORDER BY o_orderkey LIMIT {PREVIEW_ROWS}")
def q_preview_rows(spark, sf):
    """First rows by key (the limit is the feature)."""
    return table(spark, sf, "orders").orderBy("o_orderkey").limit(PREVIEW_ROWS)


# ---------------------------------------------------------------- A8/A9 duplicates
#: Lists with nulls at either end, and a map, told apart by a group that has each form.
NESTED = """CASE o_orderkey % 4 WHEN 0 THEN [1, 2] WHEN 1 THEN [1] WHEN 2 THEN [1, NULL] ELSE [NULL, 1] END AS a,
  CASE o_orderkey % 4 WHEN 0 THEN [3] WHEN 1 THEN [2, 3] ELSE [0] END AS b, MAP {o_orderstatus: o_orderkey % 3} AS m"""


@reg("duplicate_rows", f"""SELECT 'dirty_orders' AS "table", COUNT(*) AS n_rows, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {DIRTY} x) y) AS duplicate_row_count FROM {DIRTY} d
  UNION ALL
  SELECT 'lineitem_flags', COUNT(*), COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem) y) FROM lineitem
  UNION ALL
  SELECT 'embeddings', COUNT(*), COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT vec_id % 50 AS k, label, embedding FROM embeddings) y) FROM embeddings
  UNION ALL
  SELECT 'nested_orders', COUNT(*), COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT {NESTED} FROM orders) y) FROM orders""")
def q_duplicate_rows(spark, sf):
    a = stats.duplicate_rows(table(spark, sf, "dirty_orders"), "dirty_orders")
    b = stats.duplicate_rows(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"), "lineitem_flags")
    c = stats.duplicate_rows(table(spark, sf, "embeddings").select((F.col("vec_id") % 50).alias("k"), "label", "embedding"), "embeddings")
    d = stats.duplicate_rows(table(spark, sf, "orders").selectExpr(
        "CASE o_orderkey % 4 WHEN 0 THEN array(1, 2) WHEN 1 THEN array(1) WHEN 2 THEN array(1, NULL) ELSE array(NULL, 1) END AS a",
        "CASE o_orderkey % 4 WHEN 0 THEN array(3) WHEN 1 THEN array(2, 3) ELSE array(0) END AS b",
        "map(o_orderstatus, o_orderkey % 3) AS m"), "nested_orders")
    return a.unionByName(b).unionByName(c).unionByName(d)


# ---------------------------------------------------------------- A10/A11 numeric profile
NUM_COLS = [c for c, k in O.SCHEMAS["lineitem"] if k == "numeric"]


def _numprof_sql(t, cols):
    return "\nUNION ALL\n".join(
        f"""SELECT '{t}' AS "table", '{c}' AS name, COUNT({c}) AS count, CAST(SUM(CAST({c} AS DECIMAL(38,6))) AS DOUBLE) / COUNT({c}) AS mean, round(STDDEV_SAMP({c}), 6) AS std,
        CAST(MIN({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS median,
        round(quantile_cont({c}, 0.75), 6) AS p75, CAST(MAX({c}) AS DOUBLE) AS max FROM {t}""" for c in cols)


@reg("numeric_profile", _numprof_sql("lineitem", NUM_COLS) + "\nUNION ALL\n" + _numprof_sql("customer", ["c_acctbal"]))
def q_numeric_profile(spark, sf):
    out = None
    for t, cols in [("lineitem", NUM_COLS), ("customer", ["c_acctbal"])]:
        df = table(spark, sf, t)
        # counts, moments and quartiles need no distinct values: no A0
        mom = stats.numeric_moments(df, cols, t)
        one = mom.join(stats.column_quartiles(df, t, cols), ["table", "name"], "left").select(
            "table", "name", "count", "mean", r6("std").alias("std"), "min",
            r6("p25").alias("p25"), r6("median").alias("median"), r6("p75").alias("p75"), "max")
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- A12 without the shuffle of A0
HEAVY_COLS = ["l_shipdate", "l_suppkey", "l_partkey", "l_quantity", "l_returnflag", "l_orderkey"]


@reg("heavy_hitters", f"""SELECT name, CAST(rank AS INTEGER) AS rank, value, count FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY count DESC, value) AS rank FROM (
  {" UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS count FROM lineitem WHERE {c} IS NOT NULL GROUP BY 2" for c in HEAVY_COLS)})) WHERE rank <= 10""")
def q_heavy_hitters(spark, sf):
    """The top 10 of columns with many values from a bounded summary and one recount."""
    top, _ = heavy.heavy_hitters(table(spark, sf, "lineitem"), HEAVY_COLS, 10, "lineitem")
    return top.select("name", "rank", "value", "count")


# ---------------------------------------------------------------- A11 by refinement, names and groups of any kind
QUANTS = [0.01, 0.25, 0.5, 0.9]


def _quantile_sql(t, name, c, by="NULL"):
    return " UNION ALL ".join(f"SELECT '{name}' AS name, {by} AS grp, CAST({q} AS DOUBLE) AS q, round(quantile_cont(CAST({c} AS DOUBLE), {q}), 6) AS quantile FROM {t} GROUP BY 2"
                              for q in QUANTS)


@reg("quantiles_refined", "\nUNION ALL\n".join(
    [_quantile_sql("lineitem", c, c, "CAST(NULL AS VARCHAR)") for c in NUM_COLS]
    + [_quantile_sql("lineitem", "price by flag", "l_extendedprice", "CAST(nullif(l_returnflag, 'A') AS VARCHAR)"),
       _quantile_sql("lineitem", "quantity by part", "l_quantity", "CAST(l_partkey AS VARCHAR)")]))
def q_quantiles_refined(spark, sf):
    """Quantiles of columns, of three groups of which one is null, and of many groups, without a shuffle of values."""
    li = table(spark, sf, "lineitem")
    out = quantiles.column_quantiles(li, {c: F.col(c) for c in NUM_COLS}, QUANTS).select(
        "name", F.lit(None).cast("string").alias("grp"), "q", "quantile")
    flag = F.when(F.col("l_returnflag") != "A", F.col("l_returnflag"))
    for name, by, x in [("price by flag", flag, "l_extendedprice"), ("quantity by part", F.col("l_partkey").cast("string"), "l_quantity")]:
        one = quantiles.refined_quantiles(li.select(by.alias("grp"), x), ["grp"], QUANTS, x)
        out = out.unionByName(one.select(F.lit(name).alias("name"), "grp", "q", "quantile"))
    return out.select("name", "grp", "q", r6("quantile").alias("quantile"))


#: Column names with dots, backticks and blanks, and names that the operators use themselves.
ODD = [("o_orderkey", "x"), ("o_totalprice", "Sales.Amount"), ("o_orderstatus", "a`b"), ("o_orderpriority", "count"),
       ("o_orderdate", "q"), ("o_custkey", "value")]
ODD_SQL = ", ".join(f'{c} AS "{n}"' for c, n in ODD)


def odd_orders(spark, sf):
    return table(spark, sf, "orders").select(*[F.col(c).alias(n) for c, n in ODD])


@reg("odd_names_catalog", " UNION ALL ".join(
    f"""SELECT '{n.replace("'", "''")}' AS name, COUNT(*) AS n_rows, COUNT(*) - COUNT(c) AS missing_count, COUNT(DISTINCT c) AS distinct_count
    FROM (SELECT "{n}" AS c FROM (SELECT {ODD_SQL} FROM orders) o) t""" for _, n in ODD))
def q_odd_names_catalog(spark, sf):
    """A0/Q2 over names that have to be quoted."""
    cat, _ = stats.build_catalog(spark, odd_orders(spark, sf), "odd")
    return cat.select("name", "n_rows", "missing_count", "distinct_count")


@reg("odd_names_charts", f"""WITH o AS (SELECT {ODD_SQL} FROM orders), f AS (SELECT *, nullif(count, '5-LOW') AS g FROM o)
  SELECT 'box' AS chart, g AS a, CAST(NULL AS VARCHAR) AS b, CAST(COUNT(*) AS DOUBLE) AS n, round(quantile_cont(CAST("Sales.Amount" AS DOUBLE), 0.5), 6) AS v FROM f GROUP BY g
  UNION ALL SELECT 'median', g, NULL, 1, round(quantile_cont(CAST("Sales.Amount" AS DOUBLE), 0.5), 6) FROM f GROUP BY g
  UNION ALL SELECT 'line', g, "a`b", CAST(year(q) AS DOUBLE), CAST(COUNT("Sales.Amount") AS DOUBLE) FROM f GROUP BY g, "a`b", year(q)
  UNION ALL SELECT 'infinite', NULL, NULL, CAST(bin AS DOUBLE), CAST(COUNT(*) AS DOUBLE) FROM (
    SELECT CAST(least(floor((v - lo) / (hi - lo) * 30), 29) AS BIGINT) AS bin FROM (SELECT CAST("Sales.Amount" AS DOUBLE) AS v FROM o WHERE x % 5 <> 0),
      (SELECT CAST(min("Sales.Amount") AS DOUBLE) AS lo, CAST(max("Sales.Amount") AS DOUBLE) AS hi FROM o WHERE x % 5 <> 0)) GROUP BY bin""")
def q_odd_names_charts(spark, sf):
    """A null group, two series, infinite values, and names that the operators use themselves."""
    o = odd_orders(spark, sf).withColumn("count", F.when(F.col("count") != "5-LOW", F.col("count")))
    nothing = F.lit(None).cast("string").alias("b")
    box = charts.box_stats(o, "Sales.Amount", "count")   # whose output then has two columns called count
    box = box.toDF(*["g", *[f"c{i}" for i in range(1, len(box.columns))]])
    parts = [box.select(F.lit("box").alias("chart"), F.col("g").alias("a"), nothing, F.col("c1").cast("double").alias("n"), r6("c4").alias("v")),
             charts.bar_chart(o, "count", "Sales.Amount", "median").select(
                 F.lit("median").alias("chart"), F.col("category").alias("a"), nothing, F.lit(1.0).alias("n"), r6("value").alias("v")),
             charts.line_chart(o, "q", "Sales.Amount", "count", "year", ["count", "a`b"]).select(
                 F.lit("line").alias("chart"), F.col("series").alias("a"), F.col("series_2").alias("b"),
                 F.year("period").cast("double").alias("n"), F.col("value").cast("double").alias("v"))]
    far = o.withColumn("Sales.Amount", F.when(F.col("x") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("`Sales.Amount`")))
    parts.append(charts.histogram(far, "Sales.Amount").select(F.lit("infinite").alias("chart"), F.lit(None).cast("string").alias("a"), nothing,
                                                              F.col("bin").cast("double").alias("n"), F.col("count").cast("double").alias("v")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


DESCRIBE_STATS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]


@reg("describe_table", f"""SELECT name, statistic, value FROM (SELECT name, CAST(count AS DOUBLE) AS count, mean, std, min,
  p25, median, p75, max FROM ({_numprof_sql("lineitem", NUM_COLS)}) p0) p
  UNPIVOT (value FOR statistic IN (count AS 'count', mean AS 'mean', std AS 'std', min AS 'min', p25 AS '25%', median AS '50%', p75 AS '75%', max AS 'max'))""")
def q_describe_table(spark, sf):
    """describe() of up to 8 numeric columns, unpivoted to (name, statistic, value)."""
    wide = q_numeric_profile(spark, sf).where(F.col("table") == "lineitem")
    return wide.select("name", F.col("count").cast("double").alias("count"), "mean", "std", "min",
                       F.col("p25").alias("25%"), F.col("median").alias("50%"), F.col("p75").alias("75%"), "max") \
        .unpivot(["name"], DESCRIBE_STATS, "statistic", "value")


# ---------------------------------------------------------------- A18 histogram / A20 correlation
HIST = [("lineitem", "l_extendedprice"), ("lineitem", "l_quantity"), ("part", "p_retailprice"), ("customer", "c_acctbal")]


def _hist_sql(t, c, bins=HISTOGRAM_BINS):
    return f"""SELECT '{t}' AS "table", '{c}' AS name, bin, round(lo + (hi - lo) * bin / {bins}, 6) AS bin_low,
      round(lo + (hi - lo) * (bin + 1) / {bins}, 6) AS bin_high, count FROM (
      SELECT CASE WHEN hi = lo THEN 0 ELSE LEAST(CAST(FLOOR(({c} - lo) / (hi - lo) * {bins}) AS BIGINT), {bins - 1}) END AS bin,
        MIN(lo) AS lo, MIN(hi) AS hi, COUNT(*) AS count
      FROM {t}, (SELECT MIN({c}) AS lo, MAX({c}) AS hi FROM {t}) b WHERE {c} IS NOT NULL GROUP BY 1) h"""


@reg("histogram_30", "\nUNION ALL\n".join(_hist_sql(t, c) for t, c in HIST))
def q_histogram(spark, sf):
    out = None
    for t, c in HIST:
        h = charts.histogram(table(spark, sf, t), c, HISTOGRAM_BINS).select(
            F.lit(t).alias("table"), F.lit(c).alias("name"), "bin", r6("bin_low").alias("bin_low"),
            r6("bin_high").alias("bin_high"), "count")
        out = h if out is None else out.unionByName(h)
    return out


CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@reg("correlation_matrix", "\nUNION ALL\n".join(
    f"""SELECT '{a}' AS x, '{b}' AS y, round(covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})), 6) AS corr
    FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL"""
    for a in CORR_COLS for b in CORR_COLS))
def q_correlation_matrix(spark, sf):
    return charts.correlation_matrix(table(spark, sf, "lineitem"), CORR_COLS).select("x", "y", r6("corr").alias("corr"))


DIMS = 64


@reg("correlation_wide", f"""WITH v AS (SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
  w AS (SELECT vec_id, 'e' || dim AS name, CASE WHEN vec_id % 11 <> dim % 11 THEN CAST(e AS DOUBLE) END AS x FROM v WHERE dim < {DIMS}
    UNION ALL SELECT vec_id, 'label', CAST(label AS DOUBLE) FROM embeddings)
  SELECT a.name AS x, b.name AS y, COUNT(*) AS n, round(covar_samp(a.x, b.x) / (stddev_samp(a.x) * stddev_samp(b.x)), 6) AS corr
  FROM w a JOIN w b ON a.vec_id = b.vec_id WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY ALL""")
def q_correlation_wide(spark, sf):
    """65 columns (a component is missing in every eleventh row), all 4,225 pairs in one scan."""
    e = table(spark, sf, "embeddings")
    cols = [F.when(F.col("vec_id") % 11 != d % 11, F.get("embedding", F.lit(d)).cast("double")).alias(f"e{d}") for d in range(DIMS)]
    return comoments.correlations(e.select(*cols, "label"), [f"e{d}" for d in range(DIMS)] + ["label"]).select("x", "y", "n", r6("corr").alias("corr"))


# ---------------------------------------------------------------- A14 / A15 / A21 / A25
@reg("datetime_profile", f"""SELECT 'orders' AS "table", 'o_orderdate' AS name, COUNT(o_orderdate) AS count,
  strftime(MIN(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS min, strftime(MAX(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS max FROM orders
  UNION ALL SELECT 'lineitem', 'l_shipdate', COUNT(l_shipdate), strftime(MIN(l_shipdate), '%Y-%m-%dT%H:%M:%S'),
  strftime(MAX(l_shipdate), '%Y-%m-%dT%H:%M:%S') FROM lineitem
  UNION ALL SELECT 'dirty_orders', 'date_text', COUNT({O.dt_sql('date_text', True)}),
  strftime(MIN({O.dt_sql('date_text', True)}), '%Y-%m-%dT%H:%M:%S'), strftime(MAX({O.dt_sql('date_text', True)}), '%Y-%m-%dT%H:%M:%S') FROM {DIRTY} d""")
def q_datetime_profile(spark, sf):
    """Parsed count and ISO range (date text parsed day-first)."""
    out = None
    for t, c, dayfirst in [("orders", "o_orderdate", False), ("lineitem", "l_shipdate", False), ("dirty_orders", "date_text", True)]:
        df = table(spark, sf, t)
        one = charts.datetime_range(df, c, dayfirst).select(F.lit(t).alias("table"), F.lit(c).alias("name"), "count", "min", "max")
        out = one if out is None else out.unionByName(one)
    return out


@reg("daily_counts", """SELECT 'events' AS "table", 'ts' AS name, CAST(ts AS DATE) AS day, COUNT(*) AS count FROM events WHERE ts IS NOT NULL GROUP BY 3
  UNION ALL SELECT 'orders', 'o_orderdate', CAST(o_orderdate AS DATE), COUNT(*) FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 3""")
def q_daily_counts(spark, sf):
    """Per-day counts of up to two datetime columns."""
    a = charts.daily_counts(table(spark, sf, "events"), "ts").select(F.lit("events").alias("table"), F.lit("ts").alias("name"), "day", "count")
    b = charts.daily_counts(table(spark, sf, "orders"), "o_orderdate").select(
        F.lit("orders").alias("table"), F.lit("o_orderdate").alias("name"), "day", "count")
    return a.unionByName(b)


TEXT = [("documents", "text"), ("pages", "html"), ("conversations", "text"), ("benchmark", "text")]


@reg("text_profile", "\nUNION ALL\n".join(
    f"""SELECT '{t}' AS "table", '{c}' AS name, COUNT({c}) AS count, round(AVG(length({c})), 2) AS avg_length,
    CAST(MIN(length({c})) AS INTEGER) AS min_length, CAST(MAX(length({c})) AS INTEGER) AS max_length FROM {t}""" for t, c in TEXT))
def q_text_profile(spark, sf):
    """Length statistics over whole texts."""
    out = None
    for t, c in TEXT:
        one = charts.text_lengths(table(spark, sf, t), c).select(F.lit(t).alias("table"), F.lit(c).alias("name"), "count",
                                                                 F.round("avg_length", 2).alias("avg_length"), "min_length", "max_length")
        out = one if out is None else out.unionByName(one)
    return out


@reg("parse_ratios", f"""SELECT "table", name, non_null, round(num_parsed / CAST(non_null AS DOUBLE), 6) AS numeric_ratio,
  round(dt_parsed / CAST(non_null AS DOUBLE), 6) AS datetime_ratio FROM {O.catalog_sql(["dirty_orders", "events"])}
  WHERE kind = 'string' AND non_null > 0""")
def q_parse_ratios(spark, sf):
    """Parse-success ratios of text columns (numeric and month-first datetime)."""
    cat = multi_catalog(spark, sf, ["dirty_orders", "events"])
    return cat.where((F.col("kind") == "string") & (F.col("non_null") > 0)).select(
        "table", "name", "non_null", r6("num_ratio").alias("numeric_ratio"), r6("dt_ratio").alias("datetime_ratio"))


# ---------------------------------------------------------------- T1 / T2 / T3 / T5 / T6
@reg("semantic_types_pipeline", f"""SELECT "table", ordinal, name, semantic_type FROM {CAT_TYPES}""")
def q_semantic_pipeline(spark, sf):
    return multi_catalog(spark, sf, TYPE_TABLES).select("table", "ordinal", "name", "semantic_type")


@reg("semantic_types_builder", f"""SELECT "table", ordinal, name, semantic_type_builder AS semantic_type,
  round(dt_parsed / CAST(NULLIF(non_null, 0) AS DOUBLE), 6) AS parsed_success_ratio FROM {CAT_TYPES}""")
def q_semantic_builder(spark, sf):
    return multi_catalog(spark, sf, TYPE_TABLES).select(
        "table", "ordinal", "name", F.col("semantic_type_builder").alias("semantic_type"), r6("dt_ratio").alias("parsed_success_ratio"))


@reg("type_buckets", f"""WITH c AS {CAT_TYPES}, t AS (SELECT * FROM (VALUES ('numeric',0),('categorical',1),('datetime',2),('boolean',3),('text',4),('unknown',5)) v(semantic_type, type_order))
  SELECT tb."table", t.semantic_type, t.type_order, CAST(COUNT(c.name) AS INTEGER) AS n_columns,
    COALESCE(string_agg(c.name, ',' ORDER BY c.ordinal), '') AS columns
  FROM (SELECT DISTINCT "table" FROM c) tb CROSS JOIN t LEFT JOIN c ON c."table" = tb."table" AND c.semantic_type = t.semantic_type
  GROUP BY 1, 2, 3""")
def q_type_buckets(spark, sf):
    """T5: ordered column lists per semantic type."""
    return semantic.type_buckets(multi_catalog(spark, sf, TYPE_TABLES))


@reg("field_roles", f"""SELECT "table", ordinal, name, semantic_type,
  CASE WHEN semantic_type = 'numeric' THEN 'measure' ELSE 'dimension' END AS role,
  CASE semantic_type WHEN 'numeric' THEN 'Sum' WHEN 'datetime' THEN 'Year' ELSE 'Count' END AS default_aggregation FROM {CAT_TYPES}""")
def q_field_roles(spark, sf):
    return semantic.field_roles(multi_catalog(spark, sf, TYPE_TABLES))


EDA_TABLES = ["dirty_orders", "events"]


def _eda_sql():
    parts = []
    for t in EDA_TABLES:
        src = O.SOURCES[t]
        key = "o_orderkey" if t == "dirty_orders" else "event_id"
        for c, k in O.SCHEMAS[t]:
            if k == "numeric":
                parts.append(f"SELECT '{t}' AS \"table\", '{c}' AS name, 'numeric' AS eda_type")
            elif k == "datetime":
                parts.append(f"SELECT '{t}', '{c}', 'categorical'")
            elif k == "string":
                parts.append(f"""SELECT '{t}', '{c}', CASE WHEN COUNT(*) = 0 THEN 'categorical'
                  WHEN COUNT({O.dt_sql('v')}) / CAST(COUNT(*) AS DOUBLE) >= 0.8 THEN 'datetime' ELSE 'categorical' END
                  FROM (SELECT {c} AS v FROM {src} s WHERE {c} IS NOT NULL ORDER BY {key} LIMIT {EDA_SAMPLE_VALUES}) x""")
    return "\nUNION ALL\n".join(parts)


@reg("eda_column_types", _eda_sql())
def q_eda_types(spark, sf):
    """Numeric by type; text columns whose first 50 values parse >= 80 % are datetime."""
    out = None
    for t in EDA_TABLES:
        key = "o_orderkey" if t == "dirty_orders" else "event_id"
        one = semantic.eda_column_types(table(spark, sf, t), key, t)
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- P4 one format per column
#: ISO, day-first and month-name columns whose other rows use another format, hold no date or are blank.
_MIXED = {"iso_day": ("%Y-%m-%d", "yyyy-MM-dd", "%d/%m/%Y", "dd/MM/yyyy"), "day_iso": ("%d/%m/%Y", "dd/MM/yyyy", "%Y-%m-%d", "yyyy-MM-dd"),
          "slash_time": ("%Y/%m/%d %H:%M", "yyyy/MM/dd HH:mm", "%d %b %Y", "dd MMM yyyy")}
_LABELS = dict(zip(O.ISO_FMTS + O.DAY_FIRST + O.MONTH_FIRST + O.YEAR_SLASH + O.MONTH_NAME,
                   casts.ISO_FORMATS + casts.DAY_FIRST_FORMATS + casts.MONTH_FIRST_FORMATS + casts.YEAR_SLASH_FORMATS + casts.MONTH_NAME_FORMATS, strict=True))


def _inferred_sql(ordinal: int, name: str, main: str, other: str) -> str:
    cell = (f"CASE WHEN o_orderkey % 11 = 3 THEN NULL WHEN o_orderkey % 13 = 5 THEN '  ' WHEN o_orderkey % 17 = 6 THEN 'soon' "
            f"WHEN o_orderkey % 7 = 4 THEN strftime(o_orderdate, '{other}') ELSE strftime(o_orderdate, '{main}') END")
    chosen = " ".join(f"WHEN try_strptime(f.raw, '{k}') IS NOT NULL THEN {O.lit_list([v])}" for k, v in _LABELS.items())
    parsed = " ".join(f"WHEN {O.lit_list([v])} THEN try_strptime(d.raw, '{k}')" for k, v in _LABELS.items())
    return f"""(WITH d AS (SELECT o_orderkey AS k, nullif(trim({cell}), '') AS raw FROM orders),
      f AS (SELECT raw FROM d WHERE raw IS NOT NULL ORDER BY k, raw LIMIT 1), g AS (SELECT CASE {chosen} END AS format FROM f),
      p AS (SELECT d.*, g.format, CASE g.format {parsed} END AS value FROM d, g WHERE d.raw IS NOT NULL)
      SELECT {ordinal} AS ordinal, '{name}' AS name, MAX(format) AS format, COUNT(*) AS n_values, COUNT(value) AS n_parsed,
        COUNT(value) / CAST(COUNT(*) AS DOUBLE) AS parse_ratio, MIN(value) AS first, MAX(value) AS last,
        (SELECT COALESCE(string_agg(raw, '|' ORDER BY k, raw), '') FROM (SELECT * FROM p WHERE value IS NULL ORDER BY k, raw LIMIT 5) e) AS examples FROM p)"""


@reg("datetime_inferred", "\nUNION ALL\n".join(_inferred_sql(i, c, main, other) for i, (c, (main, _, other, _)) in enumerate(_MIXED.items())))
def q_datetime_inferred(spark, sf):
    """Three mixed columns, each held to the format of its first value; what uses another is reported."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    cells = {c: F.when(k % 11 == 3, None).when(k % 13 == 5, "  ").when(k % 17 == 6, "soon")
             .when(k % 7 == 4, F.date_format(day, other)).otherwise(F.date_format(day, main)) for c, (_, main, _, other) in _MIXED.items()}
    df = table(spark, sf, "orders").select("o_orderkey", *[v.alias(c) for c, v in cells.items()])
    return dates.format_report(df, list(cells), ["o_orderkey"], dayfirst=True)
