"""The flagship query: lineitem numeric profile joined with IQR outlier counts.

scan -> NaN normalise -> A0 (one shuffle for all columns, checkpointed) ->
catalog aggregate -> exact quartiles (range-partitioned, one pass for p25/p50/p75)
-> fences broadcast back to the numeric A0 rows -> weighted outlier counts; the
raw-row moments are one wide aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import quote, columns_of_kind
from ..functions.constants import IQR_MULTIPLIER
from ..functions.rounding import py_round
from ..operators.freq import numeric_frequencies
from ..operators.stats import build_catalog, column_quartiles, moments_from_frequencies
from ..sources.tables import load


def numeric_profile_with_outliers(spark: SparkSession, df: DataFrame, table: str) -> DataFrame:
    num_cols = columns_of_kind(df, "numeric")   # the others are not reported: they need not be read
    cat, fk = build_catalog(spark, df.select(*[F.col(quote(c)) for c in num_cols]), table)
    mom = moments_from_frequencies(fk, num_cols)
    vals = numeric_frequencies(fk)
    qs = column_quartiles(df, table, num_cols)
    iqr = F.col("p75") - F.col("p25")
    fences = qs.select("table", "name", "p25", "median", "p75", (F.col("p25") - IQR_MULTIPLIER * iqr).alias("low"),
                       (F.col("p75") + IQR_MULTIPLIER * iqr).alias("high"))
    counts = (vals.join(F.broadcast(fences.select("table", "name", "low", "high")), ["table", "name"])  # one row per column
              .groupBy("table", "name")
              .agg(F.sum(F.when((F.col("x") < F.col("low")) | (F.col("x") > F.col("high")), F.col("cnt")).otherwise(0))
                   .alias("outlier_count")))
    return (cat.select("table", "ordinal", "name", "n_rows", "missing_count", "distinct_count", "semantic_type")
            .join(mom, ["table", "name"]).join(fences, ["table", "name"]).join(counts, ["table", "name"])
            .select("table", "ordinal", "name", "semantic_type", "n_rows", "missing_count", "distinct_count",
                    "count", "mean", "std", "min", "p25", "median", "p75", "max", "outlier_count",
                    py_round(F.col("low"), 4).alias("low"), py_round(F.col("high"), 4).alias("high")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric_profile_with_outliers(spark, load(spark, sf_dir, "lineitem"), "lineitem")
