"""One date format per column, inferred from its first value and held to by all others.

``casts.to_datetime`` lets every value choose its format.  Here the first value that is not blank, in the order of
given columns, decides: what follows another format is a failure, as a day and a month that change places should be.
The first pass is one aggregate for all columns (``min_by``); the second parses each with its own format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import (
    DAY_FIRST_FORMATS, FRACTION_PATTERN, ISO_FORMATS, MONTH_FIRST_FORMATS, MONTH_NAME_FORMATS, YEAR_SLASH_FORMATS,
    ZONE_PATTERN, quote, to_datetime,
)
from .freq import under_each_other

FRACTION, ZONE = "ISO with a fraction", "ISO with a zone"


def candidate_formats(dayfirst: bool = False) -> list[str]:
    """In the order in which they are tried; a first value that fits only the other order of day and month has that one."""
    orders = [MONTH_FIRST_FORMATS, DAY_FIRST_FORMATS]
    return [*ISO_FORMATS, FRACTION, ZONE, *orders[dayfirst], *orders[not dayfirst], *YEAR_SLASH_FORMATS, *MONTH_NAME_FORMATS]


def parse_as(c: Column, fmt: str) -> Column:
    """Text -> timestamp_ntz by one format; NULL for all other text."""
    s = F.trim(c.cast("string"))
    if fmt == FRACTION:
        return F.when(s.rlike(FRACTION_PATTERN), s.try_cast("timestamp_ntz"))
    if fmt == ZONE:
        return F.when(s.rlike(ZONE_PATTERN), F.convert_timezone(F.current_timezone(), F.lit("UTC"), s.try_cast("timestamp").cast("timestamp_ntz")))
    return F.try_to_timestamp(s, F.lit(fmt)).cast("timestamp_ntz")


def infer_formats(df: DataFrame, columns: list[str], order_by: list[str], dayfirst: bool = False) -> dict[str, str | None]:
    """Format of the first value of each text column, in the order of ``order_by``; None without values or a known format.

    Blank cells and rows whose order is NULL decide nothing.  Rows equal in their order are decided by the lesser text.
    """
    if not columns:
        return {}
    firsts = []
    for i, c in enumerate(columns):
        s = F.trim(F.col(quote(c)).cast("string"))
        told = (s != "") & F.concat(*[F.col(quote(o)).cast("string") for o in order_by]).isNotNull()
        firsts.append(F.min_by(s, F.when(told, F.struct(*[F.col(quote(o)) for o in order_by], s.alias("_s")))).alias(f"c{i}"))
    formats = [F.coalesce(*[F.when(parse_as(F.col(f"c{i}"), f).isNotNull(), F.lit(f)) for f in candidate_formats(dayfirst)]).alias(f"c{i}")
               for i in range(len(columns))]
    row = df.agg(*firsts).select(*formats).first()   # one row
    return dict(zip(columns, row, strict=True))


def inferred_datetime(c: Column, fmt: str | None, dayfirst: bool = False) -> Column:
    """``c`` by its column's format; without one every value may use any, as in ``to_datetime``."""
    return parse_as(c, fmt) if fmt else to_datetime(c, dayfirst)


def inferred_datetimes(df: DataFrame, columns: list[str], order_by: list[str], dayfirst: bool = False) -> DataFrame:
    """``df`` with the text columns parsed, each by its inferred format; other columns and all rows stay."""
    formats = infer_formats(df, columns, order_by, dayfirst)
    return df.withColumns({c: inferred_datetime(F.col(quote(c)), f, dayfirst) for c, f in formats.items()}) if formats else df


def format_report(df: DataFrame, columns: list[str], order_by: list[str], dayfirst: bool = False, n_examples: int = 5) -> DataFrame:
    """One row per column: its format, values, parsed values, the parse ratio, first and last date, and the first failures."""
    formats = infer_formats(df, columns, order_by, dayfirst)
    values = {c: F.struct(F.nullif(F.trim(F.col(quote(c)).cast("string")), F.lit("")).alias("raw"),
                          inferred_datetime(F.col(quote(c)), f, dayfirst).alias("value")) for c, f in formats.items()}
    long = under_each_other(df, values, [F.col(quote(o)) for o in order_by], "v").where("v.raw is not null")
    counts = long.groupBy("name").agg(F.count(F.lit(1)).alias("n_values"), F.count("v.value").alias("n_parsed"),
                                      F.min("v.value").alias("first"), F.max("v.value").alias("last"))
    keys = [f"_k{i}" for i in range(len(order_by))]
    w = Window.partitionBy("name").orderBy(*keys, "raw")
    failed = (long.where("v.value is null").select("name", *keys, F.col("v.raw").alias("raw"))
              .withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= n_examples)
              .groupBy("name").agg(F.array_join(F.sort_array(F.collect_list(F.struct("_p", "raw")))["raw"], "|").alias("examples")))
    known = df.sparkSession.createDataFrame([(i, c, formats[c]) for i, c in enumerate(columns)], "ordinal int, name string, format string")
    return (known.join(F.broadcast(counts), "name", "left").join(F.broadcast(failed), "name", "left")   # a row a column
            .select("ordinal", "name", "format", F.coalesce("n_values", F.lit(0)).alias("n_values"), F.coalesce("n_parsed", F.lit(0)).alias("n_parsed"),
                    F.try_divide(F.col("n_parsed"), F.col("n_values")).alias("parse_ratio"), "first", "last", F.coalesce("examples", F.lit("")).alias("examples")))
