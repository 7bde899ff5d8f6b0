"""Q2/A5 kept up to date: a column catalog from mergeable states, one per part of a table.

A part (a day, a load, a folder) is scanned once, when it comes; its state is one row per column: exact counts, sums,
ranges and domain tests, co-moments, a HyperLogLog sketch of the values and a KLL sketch of the numbers.  The catalog of
the table is the merge of its parts' states, so a new part costs its own scan and some rows per column, whatever the
table's size.  Adding a part again replaces its state, so a repeated or retried load counts once.

All but ``distinct_count`` and the quartiles is exact.  The distinct count has a relative standard error of
``1.04 / sqrt(2 ** LOG_CELLS)`` (0.8 %), and is exact for some hundred values and fewer, which is where the type rules look; the quartiles
have a rank error of about 0.7 % (``KLL_SIZE``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import datetime_value, kind_of, nan_to_null, numeric_value, quote
from ..functions.constants import BOOL_FALSE, BOOL_TRUE, PIPELINE_BOOL_STRINGS
from .freq import _as_text
from .semantic import with_semantic_types

#: HyperLogLog cells (as a power of two) and the size parameter of the KLL sketches.
LOG_CELLS, KLL_SIZE = 14, 400
#: Parts of a state that only some kinds of columns have, and their types; null for the others.
USED_BY = {"len_sum min_len max_len str_bool builder_bool": ["string"], "dt_parsed dt_min dt_max": ["string", "datetime"],
           "num_parsed num_min num_max n_finite mean m2 zero_one quantile_sketch": ["string", "numeric"]}
TYPES = {**dict.fromkeys(["len_sum", "num_parsed", "dt_parsed", "n_finite"], "long"), **dict.fromkeys(["min_len", "max_len"], "int"),
         **dict.fromkeys(["dt_min", "dt_max"], "timestamp_ntz"), **dict.fromkeys(["str_bool", "builder_bool", "zero_one"], "boolean"),
         "quantile_sketch": "binary"}


def part_state(df: DataFrame, dayfirst: bool = False) -> DataFrame:
    """One row per column of ``df``: ``ordinal, name, dtype_raw, kind`` and what can be merged with other parts.

    One scan and one aggregate, without a shuffle of values.  A part without rows has a state of zeros and nulls; names
    may hold dots and backticks.
    """
    df = nan_to_null(df)
    cells, aggs, each = [], [F.count(F.lit(1)).alias("rows")], []
    for i, f in enumerate(df.schema.fields):
        k, c = kind_of(f.dataType), F.col(quote(f.name))
        # computed once below the aggregate: casts of text are what costs
        cells += [_as_text(f).alias(f"t{i}"), datetime_value(c, k, dayfirst).alias(f"d{i}"),
                  (numeric_value(c, k) if k != "boolean" else F.lit(None).cast("double")).alias(f"x{i}")]
        text, x, day = F.col(f"t{i}"), F.col(f"x{i}"), F.col(f"d{i}")
        n_chars = F.char_length(text) if k == "string" else F.lit(None).cast("int")
        finite = F.when(F.abs(x) < float("inf"), x)
        # a sum of equal numbers divided by their count need not be that number
        mean = F.when(F.min(finite) == F.max(finite), F.min(finite)).otherwise(F.avg(finite))
        parts = {
            "non_null": F.count(text), "len_sum": F.sum(n_chars), "min_len": F.min(n_chars), "max_len": F.max(n_chars),
            "num_parsed": F.count(x), "dt_parsed": F.count(day), "num_min": F.min(x), "num_max": F.max(x), "dt_min": F.min(day), "dt_max": F.max(day),
            "n_finite": F.count(finite), "mean": mean, "m2": F.coalesce(F.var_pop(finite), F.lit(0.0)) * F.count(finite),
            "str_bool": F.bool_and(text.isin(PIPELINE_BOOL_STRINGS)), "zero_one": F.bool_and(x.isin(0.0, 1.0)),
            "builder_bool": F.bool_and(F.lower(F.trim(text)).isin(BOOL_TRUE + BOOL_FALSE)),
            "distinct_sketch": F.hll_sketch_agg(text, LOG_CELLS), "quantile_sketch": F.kll_sketch_agg_double(finite, KLL_SIZE)}
        skip = {p for names, kinds in USED_BY.items() if k not in kinds for p in names.split()}
        aggs += [v.alias(f"{p}{i}") for p, v in parts.items() if p not in skip]
        each.append(F.struct(
            F.lit(i).alias("ordinal"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype_raw"), F.lit(k).alias("kind"),
            F.col("rows").alias("part_rows"), *[(F.lit(None).cast(TYPES.get(p, "double")) if p in skip else F.col(f"{p}{i}")).alias(p) for p in parts]))
    return df.select(*cells).agg(*aggs).select(F.inline(F.array(*each)))


def _states(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path.rstrip('/')}/table={table}").select("*", F.col("part").cast("string").alias("_part")).drop("part")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def add_part(df: DataFrame, path: str, table: str, part: str, dayfirst: bool = False) -> None:
    """Writes the state of the part ``df`` of ``table`` under ``path``, in the place of an earlier one of that part.

    Only ``df`` is scanned.  A column whose kind (number, text, ...) differs from the other parts' is an error, and
    nothing is written; so is a name of a table or part that is no plain folder name.
    """
    for n in (table, part):
        if not n or set(n) & set("/\\=%:*?\"<>{}") or n.startswith((".", "_")):
            raise ValueError(f"not a plain name: {n!r}")
    held = _states(df.sparkSession, path, table)
    if held is not None:
        kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
        other = held.where(F.col("_part") != part).select("name", "kind").distinct().collect()   # one row per column and kind
        wrong = sorted(f"{r['name']}: {r['kind']}, now {kinds[r['name']]}" for r in other if kinds.get(r["name"], r["kind"]) != r["kind"])
        if wrong:
            raise ValueError(f"columns of {table} change their kind: {'; '.join(wrong)}")
    part_state(df, dayfirst).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/table={table}/part={part}")


def merged_catalog(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The catalog of all parts of ``table``: the columns of ``stats.build_catalog`` (without those that only A0 has), and
    ``n_parts, num_count, num_mean, num_std, p25, median, p75`` of the finite numbers.

    Reads the states only.  Rows of a part that lacks a column are missing values of it; ordinals and types are those of the
    part whose name is greatest.
    """
    held = _states(spark, path, table)
    if held is None:
        raise ValueError(f"no part of {table} under {path}")
    rows = held.groupBy("_part").agg(F.max("part_rows").alias("n")).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("parts")).first()
    n_rows = F.lit(rows["rows"]).cast("long")
    n = F.col("n_finite")
    # means relative to the least of them: equal means differ by exactly zero, so that a constant column has no spread
    shifts = held.groupBy("name").agg(F.min("mean").alias("shift"))
    merged = held.join(shifts, "name").withColumn("d", F.col("mean") - F.col("shift")).groupBy("name", "kind").agg(
        F.max_by("ordinal", "_part").alias("ordinal"), F.max_by("dtype_raw", "_part").alias("dtype_raw"),
        F.sum("non_null").alias("non_null"), F.sum("len_sum").alias("len_sum"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("num_parsed", "dt_parsed")],
        *[F.min(c).alias(c) for c in ("min_len", "num_min", "dt_min", "shift")],
        *[F.max(c).alias(c) for c in ("max_len", "num_max", "dt_max")],
        *[F.bool_and(c).alias(c) for c in ("str_bool", "zero_one", "builder_bool")],
        F.coalesce(F.sum(n), F.lit(0)).alias("num_count"), F.sum(n * F.col("d")).alias("nd"), F.sum(n * F.col("d") * F.col("d")).alias("ndd"), F.sum("m2").alias("m2"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_count"),
        F.kll_merge_agg_double("quantile_sketch").alias("sketch"))
    count, non_null = F.col("num_count"), F.col("non_null").cast("double")
    some = count > 0
    spread = F.greatest(F.col("m2") + F.col("ndd") - F.try_divide(F.col("nd") * F.col("nd"), count), F.lit(0.0))
    string = (F.col("kind") == "string") & (non_null > 0)
    cat = merged.select(
        F.lit(table).alias("table"), "ordinal", "name", "dtype_raw", "kind", n_rows.alias("n_rows"), F.lit(rows["parts"]).cast("long").alias("n_parts"),
        (n_rows - F.col("non_null")).alias("missing_count"), "non_null", "distinct_count", "len_sum", "min_len", "max_len",
        "num_parsed", "dt_parsed", "num_min", "num_max", "dt_min", "dt_max", "str_bool", "zero_one", "builder_bool",
        F.try_divide(n_rows - F.col("non_null"), n_rows).alias("missing_ratio"),
        F.when(string, F.col("len_sum") / non_null).alias("avg_len"),
        F.try_divide("num_parsed", non_null).alias("num_ratio"), F.try_divide("dt_parsed", non_null).alias("dt_ratio"),
        (F.col("non_null") == 0).alias("is_empty"), "num_count",
        F.when(some, F.col("shift") + F.col("nd") / count).alias("num_mean"),
        F.when(count > 1, F.sqrt(spread / (count - 1))).alias("num_std"),
        *[F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(q))).alias(a) for q, a in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))])
    return with_semantic_types(cat)
