"""K1-K3: column roles, time coverage and key entities over a catalog of tables.

Rules run on the catalog (one row per column); windows are partitioned by
table, so a catalog of thousands of tables is one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import quote, name_has_any
from ..functions.constants import (
    DATE_KEYWORDS, GEO_KEYWORDS, ID_KEYWORDS, IDENTIFIER_UNIQUENESS, NUMERIC_DIMENSION_MAX_DISTINCT,
)


def lower_name() -> Column:
    return F.regexp_replace(F.lower(F.col("name")), " ", "_")


def py_title(c: Column) -> Column:
    """Python ``str.title()`` for ASCII text: capitalise after every non-letter."""
    chars = F.split(c, "")
    return F.array_join(F.transform(chars, lambda ch, i: F.when(
        (i == 0) | ~F.element_at(chars, i).rlike("^[A-Za-z]$"), F.upper(ch)).otherwise(F.lower(ch))), "")


def column_roles(catalog: DataFrame) -> DataFrame:
    """K1: first match wins; geographic columns are also dimensions (two rows)."""
    cl = lower_name()
    uniq = F.col("distinct_count") / F.greatest(F.col("n_rows"), F.lit(1))
    is_num = F.col("kind").isin("numeric", "boolean")
    role = (F.when(name_has_any(cl, ID_KEYWORDS) & (uniq > IDENTIFIER_UNIQUENESS), F.array(F.lit("identifier")))
            .when((F.col("kind") == "datetime") | name_has_any(cl, DATE_KEYWORDS), F.array(F.lit("temporal")))
            .when(name_has_any(cl, GEO_KEYWORDS), F.array(F.lit("geographic"), F.lit("dimension")))
            .when(is_num & (F.col("distinct_count") <= NUMERIC_DIMENSION_MAX_DISTINCT), F.array(F.lit("dimension")))
            .when(is_num, F.array(F.lit("measure")))
            .otherwise(F.array(F.lit("dimension"))))
    return catalog.select("table", "ordinal", "name", "kind", "distinct_count", F.explode(role).alias("role"))


def role_position(roles: DataFrame) -> DataFrame:
    """Position of each column inside its role list (per table, by ordinal)."""
    w = Window.partitionBy("table", "role").orderBy("ordinal")
    return roles.withColumn("position", F.row_number().over(w))


def time_coverage(roles: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """K2: first temporal column per table and its ``min year-max year``.

    Which column is first is metadata (one row per table); the years come from one
    aggregate per table.
    """
    from ..functions.casts import datetime_value, kind_of

    first = (role_position(roles).where((F.col("role") == "temporal") & (F.col("position") == 1))
             .select("table", "name").collect())  # at most one row per table
    spark = roles.sparkSession
    parts = []
    for r in first:
        df = tables[r["table"]]
        f = df.schema[r["name"]]
        k = kind_of(f.dataType)
        col = F.col(quote(r["name"]))
        ts = F.make_timestamp_ntz(col.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) if k == "numeric" \
            else datetime_value(col, k)
        parts.append(df.agg(F.min(F.year(ts)).alias("y0"), F.max(F.year(ts)).alias("y1")).select(
            F.lit(r["table"]).alias("table"), F.lit(r["name"]).alias("time_column"),
            F.concat_ws("-", F.col("y0").cast("string"), F.col("y1").cast("string")).alias("estimated_range")))
    tabs = roles.select("table").distinct()
    if not parts:
        return tabs.select("table", F.lit(False).alias("has_time_dimension"), F.lit(None).cast("string").alias("time_column"),
                           F.lit(None).cast("string").alias("estimated_range"))
    cov = parts[0]
    for p in parts[1:]:
        cov = cov.unionByName(p)
    return tabs.join(cov, "table", "left").select(
        "table", F.col("time_column").isNotNull().alias("has_time_dimension"), "time_column", "estimated_range")


def key_entities(roles: DataFrame, catalog: DataFrame) -> DataFrame:
    """K3: per identifier, the entity base name, a matching ``*name*`` column and its cardinality."""
    ids = roles.where(F.col("role") == "identifier").select("table", "ordinal", "name", "distinct_count")
    base = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.col("name")), "_id", ""), " id", ""))
    ids = ids.withColumn("base", base)
    names = catalog.select(F.col("table").alias("n_table"), F.col("ordinal").alias("n_ord"), F.col("name").alias("name_column"),
                           F.lower(F.col("name")).alias("n_lc"))
    j = ids.join(names, (F.col("table") == F.col("n_table")) & F.contains(F.col("n_lc"), F.lit("name"))
                 & F.contains(F.col("n_lc"), F.col("base")), "left")
    w = Window.partitionBy("table", "ordinal").orderBy(F.col("n_ord").asc_nulls_last())
    first = j.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    return first.select("table", "ordinal", py_title(F.col("base")).alias("entity_name"), F.col("name").alias("id_column"),
                        "name_column", F.concat(F.lit("~"), F.col("distinct_count").cast("string"), F.lit(" unique")).alias("estimated_cardinality"))
