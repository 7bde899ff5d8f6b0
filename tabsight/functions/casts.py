"""Projections, casts and predicates.

All helpers return Column expressions that stay inside whole-stage codegen;
ANSI mode is respected by using ``try_*`` functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import NA_TOKENS

# --- fixed values: accepted numeric text (exponent, sign, inf), case-insensitive ---
NUMERIC_TEXT_PATTERN = r"^\s*[+-]?(((\d+\.?\d*)|(\.\d+))([eE][+-]?\d+)?|inf|infinity)\s*$"

# --- fixed values: datetime formats tried, in order ---------------------------
ISO_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
]
MONTH_FIRST_FORMATS = ["M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy"]
DAY_FIRST_FORMATS = ["d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy"]
YEAR_SLASH_FORMATS = ["yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d"]
MONTH_NAME_FORMATS = ["MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy"]
ISO_PATTERN = r"^\d{4}-\d{2}-\d{2}([ Tt]\d{2}:\d{2}(:\d{2})?)?$"
YEAR_LAST_PATTERN = r"^\d{1,4}/\d+/\+?\d{4,}( \d+:\d{2}(:\d{2})?)?$"
FRACTION_PATTERN = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}\.\d{1,9}$"
ZONE_PATTERN = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})$"
YEAR_SLASH_PATTERN = r"^\d{4}/\d"
MONTH_NAME_PATTERN = r"^(\d{1,2}[ -])?[A-Z][a-z]{2,8}[ -](\d{1,2}, )?\d{4}$"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def quote(name: str) -> str:
    """A column name as ``F.col`` takes it, whatever dots and backticks it holds."""
    return "`" + name.replace("`", "``") + "`"


def under_each_other(df: DataFrame, cells: dict[str, Column], keep: list[Column] | None = None, value: str = "value") -> DataFrame:
    """``*keep, name, value`` of the named cells, one row each; names may hold dots, backticks or clash with anything.

    The unpivot (an Expand) works under names of its own; the real ones come from a literal list of the columns.
    """
    kept = [c.alias(f"_k{i}") for i, c in enumerate(keep or [])]
    wide = df.select(*kept, *[c.alias(f"_c{i}") for i, c in enumerate(cells.values())])
    long = wide.unpivot([f"_k{i}" for i in range(len(kept))], [f"_c{i}" for i in range(len(cells))], "_name", value)
    names = F.array(*[F.lit(n) for n in cells])
    real = F.element_at(names, F.substring("_name", 3, 9).cast("int") + 1)
    return long.select(*[F.col(f"_k{i}") for i in range(len(kept))], real.alias("name"), value)


def kind_of(dt: T.DataType) -> str:
    """Physical kind of a Spark type: numeric, boolean, datetime, string, other."""
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dt, DATETIME_TYPES):
        return "datetime"
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    return "other"


def columns_of_kind(df: DataFrame, *kinds: str) -> list[str]:
    """Type-based column selection."""
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in kinds]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Map NaN to NULL on float/double columns (pandas treats both as missing)."""
    exprs = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.col(quote(f.name))
            exprs[f.name] = F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c)
    return df.withColumns(exprs) if exprs else df


def null_tokens(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """String cells equal to a null token become NULL."""
    cols = cols if cols is not None else columns_of_kind(df, "string")
    if not cols:
        return df
    return df.withColumns({
        c: F.when(F.col(quote(c)).isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(F.col(quote(c)))
        for c in cols
    })


def trim_header(df: DataFrame) -> DataFrame:
    """Strip spaces around every column name."""
    return df.toDF(*[c.strip() for c in df.columns])


def to_number(c: Column) -> Column:
    """Text -> double, NULL when the text is not a plain decimal number."""
    s = F.trim(c.cast("string"))
    low = F.lower(s)
    value = (F.when(low.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf")))
             .when(low.isin("-inf", "-infinity"), F.lit(float("-inf")))
             .otherwise(s.try_cast("double")))
    return F.when(s.rlike("(?i)" + NUMERIC_TEXT_PATTERN), value)


def numeric_value(c: Column, kind: str) -> Column:
    """Numeric view of a column of any kind (native numbers pass through)."""
    if kind == "numeric":
        return c.cast("double")
    if kind == "boolean":
        return c.cast("int").cast("double")
    if kind == "string":
        return to_number(c)
    return F.lit(None).cast("double")


def to_datetime(c: Column, dayfirst: bool = False) -> Column:
    """Text -> timestamp_ntz with an explicit format list (never format-free).

    ISO with or without a fraction of a second, slashes in either order, year first, and English month
    names; a zone or offset is turned into UTC.  Patterns go before the formats that they admit, and the number of
    colons picks one of a list: a format that fails costs an exception, so text is tried with the one that can hold it.
    """
    s = F.trim(c.cast("string"))
    colons = F.length(s) - F.length(F.translate(s, ":", ""))

    def parsed(fmt: str) -> Column:
        return F.try_to_timestamp(s, F.lit(fmt)).cast("timestamp_ntz")

    def by_colons(formats: list[str]) -> Column:
        two, one, none = formats
        return F.when(colons == 2, parsed(two)).when(colons == 1, parsed(one)).when(colons == 0, parsed(none))

    blank, letter, minutes, day = ISO_FORMATS
    iso = F.when(colons == 2, F.when(F.substring(s, 11, 1) == " ", parsed(blank)).otherwise(parsed(letter))).when(
        colons == 1, parsed(minutes)).when(colons == 0, parsed(day))
    zoned = F.convert_timezone(F.current_timezone(), F.lit("UTC"), s.try_cast("timestamp").cast("timestamp_ntz"))
    named = F.when(s.rlike("^[A-Z]"), F.coalesce(*map(parsed, MONTH_NAME_FORMATS[:2]))).when(
        s.rlike("^[0-9]{1,2} "), F.coalesce(*map(parsed, MONTH_NAME_FORMATS[2:4]))).otherwise(parsed(MONTH_NAME_FORMATS[4]))
    return (F.when(s.rlike(r"^\d{1,4}-\d"), F.coalesce(
        F.when(s.rlike(ISO_PATTERN), iso),
        F.when(s.rlike(FRACTION_PATTERN), s.try_cast("timestamp_ntz")),
        F.when(s.rlike(ZONE_PATTERN), zoned)))
        .when(s.rlike(r"^\d{1,4}/\d"), F.coalesce(
            F.when(s.rlike(YEAR_LAST_PATTERN), by_colons(DAY_FIRST_FORMATS if dayfirst else MONTH_FIRST_FORMATS)),
            F.when(s.rlike(YEAR_SLASH_PATTERN), by_colons(YEAR_SLASH_FORMATS))))
        .when(s.rlike(MONTH_NAME_PATTERN), named))


def datetime_value(c: Column, kind: str, dayfirst: bool = False) -> Column:
    if kind == "datetime":
        return c.cast("timestamp_ntz")
    if kind == "string":
        return to_datetime(c, dayfirst)
    return F.lit(None).cast("timestamp_ntz")


def normalise_text(c: Column) -> Column:
    """P5: cast to string, trim, lower-case."""
    return F.lower(F.trim(c.cast("string")))


def finite_or_null(c: Column) -> Column:
    """NaN / +-inf -> NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(c)


def iso_text(c: Column) -> Column:
    """Timestamp -> ISO text (seconds, no fraction when zero)."""
    frac = F.date_format(c, "SSSSSS")
    return F.when(c.isNull(), None).when(
        frac == "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    ).otherwise(F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), frac))


def name_has_any(name_col: Column, keywords: list[str]) -> Column:
    """Substring test of a keyword list against a (lower-cased) name column."""
    out = F.lit(False)
    for kw in keywords:
        out = out | F.contains(name_col, F.lit(kw))
    return out


def fixed2(c: Column) -> Column:
    """Exact money arithmetic: DECIMAL(18,2)."""
    return c.cast("decimal(18,2)")
