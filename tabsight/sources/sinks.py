"""CSV, Parquet (extract) and JSON report sinks.

Staged outputs go under the shared checkpoint folder (``session.scratch_path``),
never a machine-local temporary folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import quote
from ..operators.stats import basic_aggregates
from .readers import CSV_DIALECT


def write_csv(df: DataFrame, path: str) -> str:
    """Header + comma CSV, one folder of part files, in the dialect that ``read_csv`` reads.

    The empty text is written as two quotes, so that other readers can tell it from null; ``read_csv`` takes
    both for null, as its null tokens say.
    """
    df.write.mode("overwrite").options(**CSV_DIALECT, emptyValue='""').csv(path)
    return path


def write_extract(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """The whole table as a columnar extract (Parquet), optionally partitioned."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_extract_observed(df: DataFrame, path: str, partition_by: list[str] | None = None, table: str = "t") -> DataFrame:
    """S10 with Q1/Q11's counts: writes the extract and returns ``stats.basic_stats`` of the rows written.

    The counts are observed by the job that writes, so there is no second scan.  They are taken in its last stage,
    whose tasks count once however often they are retried.  NaN counts as missing and is written as it is.
    """
    seen = Observation()
    aggs, entries = basic_aggregates(df)
    write_extract(df.observe(seen, *aggs), path, partition_by)
    got = seen.get
    schema = T.StructType([T.StructField(k, T.BooleanType() if k[0] in "bp" else T.LongType()) for k in got])
    return df.sparkSession.createDataFrame([tuple(got.values())], schema).select(F.lit(table).alias("table"), F.inline(F.array(*entries)))


def write_report_json(report: DataFrame, path: str) -> str:
    """One JSON document per report row."""
    report.select(F.to_json(F.struct(*[F.col(quote(c)) for c in report.columns])).alias("value")).write.mode(
        "overwrite").text(path)
    return path
