"""Checks over chart specs and the date-column fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.casts import datetime_value, kind_of
from ..functions.constants import DATE_FALLBACK_KEYWORDS, DATE_FALLBACK_SAMPLE, PARSE_RATIO_THRESHOLD
from .stats import first_values


def date_fallback(df: DataFrame, catalog: DataFrame, table: str, order_col: str,
                  sample: int = DATE_FALLBACK_SAMPLE, type_col: str = "semantic_type") -> DataFrame:
    """T4: columns not typed datetime whose name holds a date keyword and whose first
    ``sample`` non-null values parse day-first >= 80 %.  Returns (name, ratio, is_date)."""
    typed = {r["name"] for r in catalog.where((F.col("table") == table) & (F.col(type_col) == "datetime"))
             .select("name").collect()}  # one row per column
    cand = [f.name for f in df.schema.fields
            if f.name not in typed and any(kw in f.name.lower().replace("_", " ") for kw in DATE_FALLBACK_KEYWORDS)]
    if not cand:
        return df.sparkSession.createDataFrame([], "name string, ratio double, is_date boolean")
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    native = [c for c in cand if kinds[c] != "string"]
    head = first_values(df.select(order_col, *[F.col(c).cast("string").alias(c) if c in native else F.col(c) for c in cand]),
                        order_col, sample, cand, table)
    parsed = datetime_value(F.col("value"), "string", dayfirst=True)
    r = head.groupBy("name").agg((F.count(parsed) / F.count(F.lit(1))).alias("ratio"))
    return r.select("name", "ratio", (F.col("ratio") >= PARSE_RATIO_THRESHOLD).alias("is_date"))


def dangling_columns(specs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Columns that a chart refers to and its table does not have: ``table, column, title``."""
    refs = specs.select("table", "title", F.explode(F.concat(
        F.array_compact(F.array("x", "y")), F.coalesce("group_by", F.array().cast("array<string>")))).alias("column"))
    return refs.join(catalog.select("table", F.col("name").alias("column")), ["table", "column"], "left_anti")


def merge_specs(base: DataFrame, injected: DataFrame) -> DataFrame:
    """Injected charts go before the others where their title is new to the table."""
    new = injected.join(base.select("table", "title"), ["table", "title"], "left_anti")
    return new.withColumn("seq", F.col("seq") - 10).unionByName(base)


def constraint_violations(specs: DataFrame) -> DataFrame:
    """W4 on charts: ``table, title, problem`` for a confidence outside [0, 1], a blank title, a blank list item."""
    blank_item = F.exists(F.coalesce("group_by", F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))) == "")
    problems = F.array_compact(F.array(
        F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), F.lit("confidence not in 0..1")),
        F.when(F.trim(F.coalesce("title", F.lit(""))) == "", F.lit("blank title")),
        F.when(blank_item, F.lit("blank list item"))))
    return specs.select("table", "title", F.explode(problems).alias("problem"))


def settings_violations(settings: DataFrame) -> DataFrame:
    """W4 on settings ``table, max_visualizations, threshold, score``: ``table, problem`` for each one out of range."""
    problems = F.array_compact(F.array(
        F.when(~F.col("max_visualizations").between(1, 20), F.lit("max_visualizations not in 1..20")),
        F.when(~F.col("threshold").between(0, 100), F.lit("threshold not in 0..100")),
        F.when(F.col("score") < 0, F.lit("score below 0"))))
    return settings.select("table", F.explode(problems).alias("problem"))
