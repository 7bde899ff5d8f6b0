"""CSV/Parquet scans with the guards and normalisations of the reference loader.

CSV is read with an all-string schema (typing is the job of the semantic-type
operators), header names are trimmed, null tokens become NULL, and a file whose
bytes are not UTF-8 is read in a second encoding.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import columns_of_kind, datetime_value, kind_of, nan_to_null, null_tokens, quote
from ..functions.constants import MAX_COLUMNS
from .csv_split import header_of, parsed, records

SUPPORTED_SUFFIXES = [".csv", ".parquet"]
UPLOAD_LIMIT_BYTES = 200 * 1024 * 1024


class DataLoadError(Exception):
    """The source cannot be read as a table."""


class DataValidationError(Exception):
    """The table does not meet the minimum requirements."""


def check_source(spark: SparkSession, path: str, limit_bytes: int | None = UPLOAD_LIMIT_BYTES) -> DataFrame:
    """S3: suffix, existence and total size of the files behind ``path`` (one row)."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in SUPPORTED_SUFFIXES and not os.path.isdir(path):
        raise DataLoadError(f"unsupported file type {suffix!r}")
    try:
        files = spark.read.format("binaryFile").load(path).select("path", "length")
    except Exception as e:  # AnalysisException: path does not exist
        raise DataLoadError(str(e)) from e
    size = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    return size.select("files", "bytes", (F.lit(limit_bytes is None) | (F.col("bytes") <= F.lit(limit_bytes or 0))).alias("within_limit"))


#: The usual dialect: a quote inside a quoted field is doubled, blanks are part of a field.
CSV_DIALECT = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def header_names(raw: list[str]) -> list[str]:
    """Names without blanks around them; a name that is taken gets ``.1``, ``.2`` ..., an empty one its place."""
    def told_apart(names: list[str]) -> list[str]:
        out: list[str] = []
        for n in names:
            free, i = n, 0
            while free in out or (i and free in names):
                i += 1
                free = f"{n}.{i}"
            out.append(free)
        return out

    return told_apart([n.strip() or f"_c{i}" for i, n in enumerate(told_apart(raw))])


def read_csv(spark: SparkSession, path: str, fallback: str = "ISO-8859-1") -> DataFrame:
    """All-string CSV; quoted fields may hold commas, doubled quotes and line ends.

    Files are split among tasks wherever they may be cut (``csv_split``).  A file is UTF-8 if all its bytes are, else it is
    read as ``fallback``, each file of a folder for itself; a replacement character in the text is text.  Names come from
    the header of the first file, and every file's first record is a header.  A row with more fields than the header, a
    quoted field that is never closed, a missing file and a table without rows raise; a row with fewer fields is filled with
    nulls, a blank line is no row.
    """
    try:
        text, blocks = records(spark, path, fallback)
        raw, broken = header_of(blocks, fallback)
    except AnalysisException as e:
        raise DataLoadError(str(e)) from e
    if broken:
        raise DataLoadError(f"a quoted field is never closed in {broken}")
    if not raw:
        raise DataLoadError("there is no header")
    rows = parsed(text, len(raw), CSV_DIALECT)
    # a row with too few fields is filled with nulls, as it always was; only its last field can be missing
    last = F.col(f"c{len(raw) - 1}")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(last.isNotNull(), F.substring("_broken", 1, 200))).alias("wide")).first()
    if seen["wide"] is not None:
        raise DataLoadError(f"a row has more than {len(raw)} fields: {seen['wide']!r}")
    if not seen["n"]:
        raise DataLoadError("the file has a header but no rows")
    return null_tokens(rows.drop("_broken").toDF(*header_names(raw)))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV by suffix; NaN normalised to NULL."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".csv":
        return read_csv(spark, path)
    if suffix == ".parquet" or os.path.isdir(path):
        try:
            return nan_to_null(spark.read.parquet(path))
        except Exception as e:  # noqa: BLE001
            raise DataLoadError(str(e)) from e
    raise DataLoadError(f"unsupported file type {suffix!r}")


def validate(df: DataFrame) -> None:
    """Q1 as an eager guard: raise when the table is unusable."""
    if len(df.columns) > MAX_COLUMNS:
        raise DataValidationError(f"{len(df.columns)} columns; at most {MAX_COLUMNS}")
    if df.isEmpty():
        raise DataValidationError("no rows")
    if df.na.drop(how="all").isEmpty():
        raise DataValidationError("all rows are empty")


def autoparse_dates(df: DataFrame, keywords: list[str], dayfirst: bool = True) -> DataFrame:
    """Parse every text or date column whose lower-cased name contains a date keyword (day-first).

    Numbers stay numbers, whatever their column is called.
    """
    out = {}
    for f in df.schema.fields:
        if any(kw in f.name.lower() for kw in keywords) and kind_of(f.dataType) in ("string", "datetime"):
            out[f.name] = datetime_value(F.col(quote(f.name)), kind_of(f.dataType), dayfirst)
    return df.withColumns(out) if out else df


__all__ = ["DataLoadError", "DataValidationError", "check_source", "read_csv", "read_table", "validate",
           "autoparse_dates", "columns_of_kind"]
