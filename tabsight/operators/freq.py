"""A0: the value-frequency table, the shared basis of the column statistics.

``value_frequencies`` unpivots the chosen columns into ``(table, name, value)``
and counts each distinct value once: one Expand + partial (map-side) hash
aggregation + one shuffle for all columns together.  NULL is kept as its own
row, so missing counts come out of the same shuffle.  A hot value (a third of
all rows) is collapsed by the partial aggregation before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import kind_of, nan_to_null, quote, under_each_other


def static_catalog(spark: SparkSession, df: DataFrame, table: str) -> DataFrame:
    """One row per column from the schema only: table, ordinal, name, dtype_raw, kind.

    Built from metadata (bounded by the column count, at most 500 per table).
    """
    rows = [(table, i, f.name, f.dataType.simpleString(), kind_of(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    schema = "table string, ordinal int, name string, dtype_raw string, kind string"
    return spark.createDataFrame(rows, schema)


def _as_text(f: T.StructField):
    c = F.col(quote(f.name))
    dt = f.dataType
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        c = F.when(F.isnan(c), None).otherwise(c + F.lit(0.0))  # -0.0 and 0.0 are one value
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def _counted(f: T.StructField) -> tuple[str, Column]:
    """The type in which a column's values are counted, and its values in it; no two of one text differ in it."""
    c, dt = F.col(quote(f.name)), f.dataType
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "long", c.cast("long")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return "double", F.when(~F.isnan(c), c + F.lit(0.0))   # -0.0 and 0.0 are one value
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp", c.cast("timestamp_ntz")
    return "text", _as_text(f)


def value_frequencies(df: DataFrame, table: str = "t", cols: list[str] | None = None) -> DataFrame:
    """A0: ``(table, name, value string, len int, cnt long)``; NULL value = missing cells.

    Values are the values, however long: top-k lists report them as they are.  Columns are counted together with those
    that hold the same type, so that numbers and times become text once a distinct value, after the shuffle.
    """
    cols = cols if cols is not None else df.columns
    fields = {f.name: f for f in df.schema.fields}
    kinds: dict[str, dict[str, Column]] = {}
    for c in cols:
        kind, value = _counted(fields[c])
        kinds.setdefault(kind, {})[c] = value
    parts = [under_each_other(df, cells).groupBy("name", "value").agg(F.count(F.lit(1)).alias("cnt"))
             .select("name", F.col("value").cast("string").alias("value"), "cnt") for cells in kinds.values()]
    return reduce(DataFrame.unionAll, parts).select(F.lit(table).alias("table"), "name", "value", F.char_length("value").alias("len"), "cnt")


def multi_table_frequencies(tables: dict[str, DataFrame]) -> DataFrame:
    """A0 over a catalog of several tables in one job (union, then one shuffle each)."""
    parts = [value_frequencies(nan_to_null(df), name) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_kind(freq: DataFrame, static: DataFrame) -> DataFrame:
    """Attach ordinal/kind to A0 rows; the static catalog is bounded by the column count."""
    return freq.join(F.broadcast(static.select("table", "name", "ordinal", "kind")), ["table", "name"])


def numeric_frequencies(freq_k: DataFrame) -> DataFrame:
    """Numeric instance of A0 for numeric columns: ``(table, name, x double, cnt)``."""
    return (freq_k.where((F.col("kind") == "numeric") & F.col("value").isNotNull())
            .select("table", "name", "ordinal", F.col("value").try_cast("double").alias("x"), "cnt"))
