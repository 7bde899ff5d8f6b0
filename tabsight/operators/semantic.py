"""Semantic type inference as CASE chains over per-column statistics.

The statistics come from one aggregate over the value-frequency table (A0),
so every rule below costs nothing per row of data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import (
    BUILDER_TEXT_AVG_LEN, BUILDER_TEXT_DISTINCT, CATEGORICAL_CARDINALITY_THRESHOLD,
    PARSE_RATIO_THRESHOLD, SEMANTIC_ROLE, SEMANTIC_TYPES, TEXT_AVG_LENGTH_THRESHOLD,
)


def pipeline_type() -> Column:
    """T1 (`pipeline` variant), order matters."""
    k = F.col("kind")
    nn = F.col("non_null")
    nd = F.col("distinct_count")
    return (
        F.when(nn == 0, "unknown")
        .when(k == "boolean", "boolean")
        .when((k == "string") & F.coalesce(F.col("str_bool"), F.lit(False)) & (nd <= 2), "boolean")
        .when(k == "datetime", "datetime")
        .when((k == "numeric") & F.coalesce(F.col("zero_one"), F.lit(False)) & (nd <= 2), "boolean")
        .when(k == "numeric", "numeric")
        .when((k == "string") & (F.col("num_ratio") >= PARSE_RATIO_THRESHOLD), "numeric")
        .when((k == "string") & (F.col("dt_ratio") >= PARSE_RATIO_THRESHOLD), "datetime")
        .when((k == "string") & (nd <= CATEGORICAL_CARDINALITY_THRESHOLD), "categorical")
        .when((k == "string") & (F.col("avg_len") > TEXT_AVG_LENGTH_THRESHOLD), "text")
        .when(k == "string", "categorical")
        .otherwise("unknown")
    )


def builder_type(datetime_threshold: float = PARSE_RATIO_THRESHOLD) -> Column:
    """T2 (`builder` variant): native bool counts as numeric; strings never become numeric."""
    k = F.col("kind")
    return (
        F.when(F.col("non_null") == 0, "unknown")
        .when(k == "other", "unknown")
        .when(k.isin("numeric", "boolean"), "numeric")
        .when(F.coalesce(F.col("builder_bool"), F.lit(False)), "boolean")
        .when(F.col("dt_ratio") >= datetime_threshold, "datetime")
        .when((F.col("distinct_count") > BUILDER_TEXT_DISTINCT) | (F.col("avg_len") > BUILDER_TEXT_AVG_LEN), "text")
        .otherwise("categorical")
    )


def with_semantic_types(stats: DataFrame) -> DataFrame:
    """Add ``semantic_type`` (pipeline) and ``semantic_type_builder`` to a stats catalog."""
    return stats.withColumn("semantic_type", pipeline_type()) \
                .withColumn("semantic_type_builder", builder_type())


def type_buckets(catalog: DataFrame, type_col: str = "semantic_type") -> DataFrame:
    """T5: ordered name list per (table, type); all six types present per table."""
    grid = catalog.select("table").distinct().select(
        "table", F.posexplode(F.array(*[F.lit(t) for t in SEMANTIC_TYPES])).alias("type_order", "semantic_type"))
    lists = (catalog.groupBy("table", F.col(type_col).alias("semantic_type"))
             .agg(F.sort_array(F.collect_list(F.struct("ordinal", "name"))).alias("_c")))
    return (grid.join(lists, ["table", "semantic_type"], "left")
            .select("table", "semantic_type", "type_order",
                    F.coalesce(F.size("_c"), F.lit(0)).alias("n_columns"),
                    F.coalesce(F.array_join(F.transform("_c", lambda s: s["name"]), ","), F.lit("")).alias("columns")))


def field_roles(catalog: DataFrame, type_col: str = "semantic_type") -> DataFrame:
    """Semantic type -> BI role and default aggregation (6-row mapping, broadcast)."""
    m = catalog.sparkSession.createDataFrame(SEMANTIC_ROLE, "semantic_type string, role string, default_aggregation string")
    return (catalog.withColumnRenamed(type_col, "semantic_type").join(F.broadcast(m), "semantic_type", "left")
            .select("table", "ordinal", "name", "semantic_type", "role", "default_aggregation"))


def eda_column_types(df: DataFrame, order_col: str, table: str = "t", sample: int = 50) -> DataFrame:
    """Numeric by physical type; a text column is datetime when its first ``sample``
    non-null values (in ``order_col`` order) parse >= 80 %; everything else categorical.
    """
    from ..functions.casts import kind_of, to_datetime
    from .stats import first_values

    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    strings = [c for c, k in kinds.items() if k == "string"]
    spark = df.sparkSession
    base = spark.createDataFrame([(table, c, "numeric" if k == "numeric" else "categorical") for c, k in kinds.items()],
                                 "table string, name string, base_type string")
    if not strings:
        return base.select("table", "name", F.col("base_type").alias("eda_type"))
    head = first_values(df, order_col, sample, strings, table)
    ratio = head.groupBy("table", "name").agg(F.avg(to_datetime(F.col("value")).isNotNull().cast("double")).alias("r"))
    return (base.join(ratio, ["table", "name"], "left")
            .select("table", "name", F.when(F.col("r") >= PARSE_RATIO_THRESHOLD, "datetime").otherwise(F.col("base_type")).alias("eda_type")))
