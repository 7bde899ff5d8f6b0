"""Q1-Q12: data-quality checks, reports and scores (both variants + quick).

Everything is computed from the catalog (one row per column), A0 and one
group-by over all columns for duplicates; results are small DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import py_round

from ..functions.casts import nan_to_null, quote, to_datetime, to_number, under_each_other
from ..functions.constants import (
    DUPLICATE_RATIO_WARNING, IQR_MULTIPLIER, MISSING_RATIO_HIGH, MISSING_RATIO_WARNING,
    QUALITY_THRESHOLD_DEFAULT,
)
from ..session import stage
from .quantiles import quantile_columns, weighted_quantiles
from .stats import _dt_of, _num_of, duplicate_rows


def validate_min_requirements(df: DataFrame, max_columns: int = 500) -> DataFrame:
    """One row with row count, non-empty row count and the verdict."""
    df = nan_to_null(df)
    non_empty = F.greatest(*[F.col(quote(c)).isNotNull().cast("int") for c in df.columns]) if len(df.columns) > 1 \
        else F.col(quote(df.columns[0])).isNotNull().cast("int")
    agg = df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(non_empty), F.lit(0)).alias("non_empty_rows"))
    ncols = len(df.columns)
    return agg.select(
        "row_count", "non_empty_rows", F.lit(ncols).alias("column_count"),
        F.when(F.col("row_count") < 1, F.lit("too_few_rows"))
        .when(F.lit(ncols) > max_columns, F.lit("too_many_columns"))
        .when(F.col("non_empty_rows") == 0, F.lit("all_rows_empty"))
        .otherwise(F.lit("ok")).alias("status"))


def numeric_values(freq_k: DataFrame, catalog: DataFrame, *type_cols: str) -> DataFrame:
    """``table, name, x, cnt``: the numbers in the columns typed numeric under any of ``type_cols``, staged.

    Text is parsed once here; the rounds of the quartiles and the counts behind them read numbers.
    """
    numeric = F.array_contains(F.array(*type_cols or ("semantic_type", "semantic_type_builder")), "numeric")
    fk = freq_k.join(F.broadcast(catalog.where(numeric).select("table", "name")), ["table", "name"], "left_semi")
    return stage(fk.where(F.col("value").isNotNull())
                 .select("table", "name", _num_of(F.col("kind"), F.col("value")).alias("x"), "cnt")
                 .where(F.col("x").isNotNull()), "numbers")


def value_quartiles(values: DataFrame) -> DataFrame:
    """``table, name, p25, p75`` of ``numeric_values``."""
    return quantile_columns(weighted_quantiles(values, ["table", "name"], [0.25, 0.75]), ["table", "name"], {0.25: "p25", 0.75: "p75"})


def iqr_outliers(freq_k: DataFrame, catalog: DataFrame, variant: str = "pipeline",
                 multiplier: float = IQR_MULTIPLIER, type_col: str | None = None,
                 quartiles: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    """Q3 (pipeline) / Q4 (builder): fences from exact quartiles, strict comparison.

    ``quartiles`` (``table, name, p25, p75`` of all numeric columns) saves the ranking where it is known, ``values``
    (the ``numeric_values`` of both variants) their parsing.

    Bounds (one row per column) are broadcast back to the numeric A0 rows and the
    outlier count is a weighted sum -- no pass over the raw rows.
    """
    type_col = type_col or ("semantic_type" if variant == "pipeline" else "semantic_type_builder")
    if values is not None:
        names = catalog.where(F.col(type_col) == "numeric").select("table", "name")
        vals = values.join(F.broadcast(names), ["table", "name"], "left_semi")
    else:
        vals = numeric_values(freq_k, catalog, type_col)
    q = (quartiles if quartiles is not None else value_quartiles(vals)).select(
        "table", "name", F.col("p25").alias("q1"), F.col("p75").alias("q3"))
    n = vals.groupBy("table", "name").agg(F.sum("cnt").alias("n"))
    iqr = F.col("q3") - F.col("q1")
    b = q.join(n, ["table", "name"]).select("table", "name", "n", "q1", "q3",
                                           (F.col("q1") - multiplier * iqr).alias("low"),
                                           (F.col("q3") + multiplier * iqr).alias("high"))
    cnt = (vals.join(F.broadcast(b.select("table", "name", "low", "high")), ["table", "name"])
           .groupBy("table", "name")
           .agg(F.sum(F.when((F.col("x") < F.col("low")) | (F.col("x") > F.col("high")), F.col("cnt"))
                      .otherwise(0)).alias("outlier_count")))
    out = b.join(cnt, ["table", "name"]).join(catalog.select("table", "name", "ordinal"), ["table", "name"])
    if variant == "pipeline":
        return out.select("table", "ordinal", "name", "outlier_count",
                          py_round(F.col("low"), 4).alias("low"), py_round(F.col("high"), 4).alias("high"))
    valid = (F.col("n") >= 4) & (iqr != 0)
    return out.select("table", "ordinal", "name",
                      F.when(valid, F.col("outlier_count")).otherwise(F.lit(0)).cast("long").alias("outlier_count"),
                      F.when(valid, F.col("low")).alias("low"), F.when(valid, F.col("high")).alias("high"))


def outlier_rows(df: DataFrame, bounds: DataFrame, table: str, key: str) -> DataFrame:
    """P10: rows whose value lies strictly outside the column's fences.

    The raw rows are unpivoted to ``(key, name, x)`` and joined with the bounds
    (one row per column: broadcast is size-bounded by the column count).
    """
    names = [r for r in df.columns if r != key]
    long = under_each_other(df, {c: F.col(quote(c)).cast("string") for c in names}, [F.col(quote(key))], "raw").withColumnRenamed("_k0", "key")
    b = bounds.where(F.col("table") == table).select("name", "low", "high")
    j = long.join(F.broadcast(b), "name").select("key", "name", to_number(F.col("raw")).alias("value"), "low", "high")
    return j.where((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))


def failed_cells(df: DataFrame, catalog: DataFrame, table: str, order_col: str, dayfirst: bool = False) -> DataFrame:
    """``_ord, name, st, raw`` of the cells that do not parse as the column's type of either variant, staged: one pass for both."""
    cat = catalog.where(F.col("table") == table).select("name", "kind", F.array_distinct(F.array("semantic_type", "semantic_type_builder")).alias("types"))
    cells = []
    for c, k, st in [(r["name"], r["kind"], st) for r in cat.collect() for st in r["types"]]:  # one row per column
        if st not in ("numeric", "datetime") or k not in ("string", "numeric", "datetime"):
            continue
        col = F.col(quote(c))
        parsed = to_number(col) if (st == "numeric" and k == "string") else (
            col.cast("double") if st == "numeric" else _dt_of(F.lit(k), col.cast("string"), dayfirst))
        cells.append(F.when(col.isNotNull() & parsed.isNull(),
                            F.struct(F.lit(c).alias("name"), F.lit(st).alias("st"), col.cast("string").alias("raw"))))
    order = F.col(quote(order_col)).alias("_ord")
    if not cells:
        return df.select(order, F.lit("").alias("name"), F.lit("").alias("st"), F.lit("").alias("raw")).limit(0)
    # only cells that fail leave the scan
    return stage(df.select(order, F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull()))), "failedcells")


def type_issues(df: DataFrame, catalog: DataFrame, table: str, order_col: str, variant: str = "pipeline",
                dayfirst: bool = False, n_examples: int = 5, failed: DataFrame | None = None) -> DataFrame:
    """Q5/Q6: coercion failures in numeric / datetime columns with the first examples.

    ``failed`` (the ``failed_cells`` of the same arguments) saves the pass over the rows where both variants are wanted.
    """
    type_col = "semantic_type" if variant == "pipeline" else "semantic_type_builder"
    cat = catalog.where(F.col("table") == table).select("name", "ordinal", "kind", F.col(type_col).alias("st"), "n_rows")
    failed = failed if failed is not None else failed_cells(df, catalog, table, order_col, dayfirst)
    long = failed.join(F.broadcast(cat.select("name", "st")), ["name", "st"], "left_semi").select("_ord", "name", "raw")
    counts = long.groupBy("name").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("name").orderBy("_ord")
    ex = (long.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= n_examples)
          .groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_p", "raw"))),
                                                        lambda s: s["raw"]), "|").alias("examples")))
    out = counts.join(ex, "name").join(cat, "name")
    if variant == "pipeline":
        issue = F.when(F.col("st") == "numeric", "Non-numeric values in numeric column").otherwise("Unparseable datetime values")
        sev = F.when((F.col("st") == "numeric") & (F.col("count") / F.col("n_rows") > 0.1), "high").otherwise("medium")
    else:
        issue = F.when(F.col("st") == "numeric", "numeric_coercion_failed").otherwise("datetime_parse_failed")
        sev = F.lit("high")
    return out.select(F.lit(table).alias("table"), "ordinal", "name", issue.alias("issue"), "count", "examples",
                      sev.alias("severity"))


def quality_summary(catalog: DataFrame, dups: DataFrame, issues: DataFrame, outliers_builder: DataFrame | None = None) -> DataFrame:
    """Q7/Q8: one row per table with the inputs and both scores."""
    per_table = catalog.groupBy("table").agg(
        F.max("n_rows").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.sum("missing_count").alias("total_missing"),
        F.sum(F.col("is_empty").cast("int")).alias("n_empty"),
        F.sum(((F.col("distinct_count") <= 1) & ~F.col("is_empty")).cast("int")).alias("n_constant"),
        F.sum(((F.col("distinct_count") == 1) & ~F.col("is_empty")).cast("int")).alias("n_constant_builder"),
        F.sum((F.col("semantic_type_builder") == "numeric").cast("int")).alias("n_numeric_builder"),
    )
    n_issues = issues.groupBy("table").agg(F.count(F.lit(1)).alias("n_type_issues"))
    s = (per_table.join(dups.select("table", "duplicate_row_count"), "table", "left")
         .join(n_issues, "table", "left")
         .fillna({"n_type_issues": 0, "duplicate_row_count": 0}))
    if outliers_builder is not None:
        s = s.join(outliers_builder.groupBy("table").agg(F.sum("outlier_count").alias("total_outliers_builder")),
                   "table", "left")
    else:   # without the outliers the builder score is not known
        s = s.withColumn("total_outliers_builder", F.lit(None).cast("long"))
    cells = F.col("row_count") * F.col("column_count")
    mr_raw = F.col("total_missing") / cells
    dr_raw = F.col("duplicate_row_count") / F.col("row_count")
    s = s.select("*", py_round(mr_raw, 4).alias("missing_ratio_overall"), py_round(dr_raw, 4).alias("duplicate_row_ratio"),
                 mr_raw.alias("_mr"), dr_raw.alias("_dr"))
    score = (F.lit(100.0)
             - F.least(F.col("missing_ratio_overall") * 100, F.lit(30.0))
             - F.least(F.col("duplicate_row_ratio") * 100, F.lit(20.0))
             - F.least(F.col("n_empty") * 5, F.lit(15))
             - F.least(F.col("n_constant") * 3, F.lit(9))
             - F.least(F.col("n_type_issues") * 5, F.lit(15)))
    cols_ = F.greatest(F.col("column_count"), F.lit(1))
    pen = (F.col("_mr") * 60.0 + F.col("_dr") * 20.0 + (F.col("n_empty") / cols_) * 10.0
           + (F.col("n_constant_builder") / cols_) * 5.0)
    pen = pen + F.when((F.col("n_numeric_builder") > 0) & (F.col("row_count") > 0),
                       (F.col("total_outliers_builder") / (F.col("n_numeric_builder") * F.col("row_count"))) * 20.0
                       ).otherwise(0.0)
    return s.select("table", "row_count", "column_count", "total_missing", "missing_ratio_overall",
                    "duplicate_row_count", "duplicate_row_ratio", "n_empty", "n_constant", "n_type_issues",
                    py_round(F.greatest(score, F.lit(0.0)), 2).alias("quality_score"),
                    F.when(F.lit(outliers_builder is not None) | (F.col("n_numeric_builder") == 0),
                           py_round(F.greatest(F.lit(100.0) - pen, F.lit(0.0)), 2)).alias("quality_score_builder"))


def quick_quality(df: DataFrame, table: str = "t") -> DataFrame:
    """Q9: missing and duplicate percentages and a 1-digit score in one row."""
    df = nan_to_null(df)
    ncols = len(df.columns)
    missing = df.agg(F.count(F.lit(1)).alias("rows"),
                     sum([F.sum(F.col(quote(c)).isNull().cast("long")) for c in df.columns]).alias("missing"))
    d = duplicate_rows(df, table)
    # two one-row aggregates combined by a union and a two-row aggregate (no join)
    none = F.lit(None).cast("long")
    j = (missing.select("rows", "missing", none.alias("duplicate_row_count"))
         .unionByName(d.select(none.alias("rows"), none.alias("missing"), "duplicate_row_count"))
         .agg(F.max("rows").alias("rows"), F.max("missing").alias("missing"),
              F.max("duplicate_row_count").alias("duplicate_row_count")))
    mp = F.col("missing") / (F.col("rows") * ncols) * 100
    dp = F.col("duplicate_row_count") / F.col("rows") * 100
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - mp * 1.5 - dp * 0.5))
    return j.select(F.lit(table).alias("table"), "rows", F.lit(ncols).alias("cols"), "missing",
                    py_round(mp, 2).alias("missing_pct"), F.col("duplicate_row_count").alias("dupes"),
                    py_round(dp, 2).alias("dupe_pct"), py_round(score, 1).alias("score"))


def _pct(c: Column) -> Column:
    """Python's ``format(x, '.1%')``: x*100 rounded half-even on the binary value, one decimal."""
    return F.concat(F.format_string("%.1f", py_round(c * 100.0, 1)), F.lit("%"))


def _pylist(names: Column) -> Column:
    """Python's repr of a list of strings: ['a', 'b']."""
    return F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']"))


def quality_warnings(catalog: DataFrame, summary: DataFrame, outliers: DataFrame) -> DataFrame:
    """Q10 (pipeline): warning/error rows (table, seq, code, level, message) in report order."""
    ov = summary.where(F.col("missing_ratio_overall") > MISSING_RATIO_WARNING).select(
        "table", F.lit(1).alias("seq"), F.lit("missing_overall").alias("code"), F.lit("warning").alias("level"),
        F.concat(F.lit("Overall missing ratio is "), _pct(F.col("missing_ratio_overall")), F.lit(" (threshold: 5%).")).alias("message"))
    # rounded once into a column: py_round repeats its argument, so nesting it would blow up the generated code
    mr = F.col("_mr")
    col_miss = catalog.withColumn("_mr", py_round(F.col("missing_ratio"), 4)).where(mr > MISSING_RATIO_HIGH).select(
        "table", (F.lit(100) + F.col("ordinal")).alias("seq"), F.lit("missing_column").alias("code"), F.lit("warning").alias("level"),
        F.concat(F.lit("Column '"), F.col("name"), F.lit("' has "), _pct(mr), F.lit(" missing values.")).alias("message"))
    dup = summary.where(F.col("duplicate_row_ratio") > DUPLICATE_RATIO_WARNING).select(
        "table", F.lit(2000).alias("seq"), F.lit("duplicates").alias("code"), F.lit("warning").alias("level"),
        F.concat(F.col("duplicate_row_count").cast("string"), F.lit(" duplicate rows detected ("),
                 _pct(F.col("duplicate_row_ratio")), F.lit(" of data).")).alias("message"))
    outl = outliers.where(F.col("outlier_count") > 0).groupBy("table").agg(
        F.sum("outlier_count").alias("_t"), F.count(F.lit(1)).alias("_n")).select(
        "table", F.lit(3000).alias("seq"), F.lit("outliers").alias("code"), F.lit("warning").alias("level"),
        F.concat(F.col("_t").cast("string"), F.lit(" outlier values detected across "), F.col("_n").cast("string"),
                 F.lit(" numeric column(s).")).alias("message"))

    def listed(cond, seq, code, level, prefix):
        g = catalog.where(cond).groupBy("table").agg(F.sort_array(F.collect_list(F.struct("ordinal", "name"))).alias("_c"))
        return g.select("table", F.lit(seq).alias("seq"), F.lit(code).alias("code"), F.lit(level).alias("level"),
                        F.concat(F.lit(prefix), _pylist(F.transform("_c", lambda x: x["name"]))).alias("message"))

    const = listed((F.col("distinct_count") <= 1) & ~F.col("is_empty"), 4000, "constant_columns", "warning",
                   "Constant (single-value) columns: ")
    empty = listed(F.col("is_empty"), 5000, "empty_columns", "error", "Fully empty columns: ")
    return ov.unionByName(col_miss).unionByName(dup).unionByName(outl).unionByName(const).unionByName(empty)


def builder_warnings(catalog: DataFrame, summary: DataFrame) -> DataFrame:
    """Q10 (builder): its four warnings in report order, ``table, seq, message``."""
    def listed(cond: Column, seq: int, prefix: str) -> DataFrame:
        g = catalog.where(cond).groupBy("table").agg(F.sort_array(F.collect_list(F.struct("ordinal", "name"))).alias("_c"))
        return g.select("table", F.lit(seq).alias("seq"), F.concat(F.lit(prefix), _pylist(F.transform("_c", lambda x: x["name"]))).alias("message"))

    dup = summary.where("duplicate_row_count > 0").select("table", F.lit(3).alias("seq"), F.concat(
        F.lit("Found "), F.col("duplicate_row_count").cast("string"), F.lit(" duplicate rows.")).alias("message"))
    missing = summary.where("total_missing > 0").select("table", F.lit(4).alias("seq"), F.concat(
        F.lit("Found "), F.col("total_missing").cast("string"), F.lit(" missing values in total.")).alias("message"))
    return (listed(F.col("is_empty"), 1, "Found empty columns: ")
            .unionByName(listed((F.col("distinct_count") == 1) & ~F.col("is_empty"), 2, "Found constant columns: "))
            .unionByName(dup).unionByName(missing))


def full_report(catalog: DataFrame, summary: DataFrame, outliers: DataFrame, issues: DataFrame, warnings: DataFrame,
                variant: str = "pipeline") -> DataFrame:
    """Q11: one nested row per table: scores and totals, missing by column, outliers with bounds by column, empty and
    constant columns, type issues, warnings and errors (``warnings`` has ``table, seq, message`` and may have ``level``).
    """
    in_order = lambda *fields: F.sort_array(F.collect_list(F.struct(*fields)))
    names = lambda cond: F.transform(F.filter("cols", cond), lambda x: x["name"])
    single = lambda x: ~x["is_empty"] & (x["distinct_count"] <= 1)
    cols = catalog.groupBy("table").agg(in_order("ordinal", "name", "missing_count", "is_empty", "distinct_count").alias("cols")).select(
        "table", F.map_from_entries(F.transform("cols", lambda x: F.struct(x["name"], x["missing_count"]))).alias("missing_by_column"),
        names(lambda x: x["is_empty"]).alias("empty_columns"), names(single).alias("constant_columns"))
    out = outliers.groupBy("table").agg(in_order("ordinal", "name", "outlier_count", "low", "high").alias("outliers"))
    iss = issues.groupBy("table").agg(in_order("ordinal", "name", "issue", "count", "examples", "severity").alias("type_issues"))
    level = F.col("level") if "level" in warnings.columns else F.lit("warning")
    told = lambda kind: F.transform(F.filter("m", lambda x: x["_l"] == kind), lambda x: x["message"]).alias(f"{kind}s")
    said = warnings.withColumn("_l", level).groupBy("table").agg(in_order("seq", "message", "_l").alias("m")).select(
        "table", told("warning"), told("error"))
    score = "quality_score" if variant == "pipeline" else "quality_score_builder"
    head = summary.select("table", "row_count", "column_count", "total_missing", "missing_ratio_overall", "duplicate_row_count",
                          "duplicate_row_ratio", F.col(score).alias("quality_score"))
    return head.join(cols, "table", "left").join(out, "table", "left").join(iss, "table", "left").join(said, "table", "left")


def quality_gate(summary: DataFrame, threshold: float = QUALITY_THRESHOLD_DEFAULT) -> DataFrame:
    """Q12: tables whose score reaches the threshold (declared, applied here)."""
    return summary.select("table", "quality_score", (F.col("quality_score") >= threshold).alias("passes"))
