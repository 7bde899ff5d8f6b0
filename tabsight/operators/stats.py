"""Column statistics, built as few passes as possible.

* ``column_stats``: one aggregate over A0 gives, per column, rows, nulls,
  distinct count, length sums, parse successes and domain tests.
* ``numeric_moments``: one wide aggregate over the raw table gives count, mean,
  std, min, max of every numeric column (partial aggregates, no value shuffle).
* exact quartiles come from refined histograms (``quantiles``), over the raw columns or the numeric
  instance of A0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import (
    finite_or_null, kind_of, nan_to_null, numeric_value, quote, to_datetime, to_number, under_each_other,
)
from ..functions.constants import (
    BOOL_FALSE, BOOL_TRUE, PIPELINE_BOOL_STRINGS, PIPELINE_BOOL_TEXT_EXTRA, SAMPLE_VALUES_COUNT,
)
from ..session import checkpoint_dir, stage
from .charts import exact_sum
from .freq import _as_text, numeric_frequencies, static_catalog, value_frequencies, with_kind
from .quantiles import column_quantiles, quantile_columns, weighted_quantiles
from .semantic import with_semantic_types


def _num_of(kind: Column, v: Column) -> Column:
    return F.when(kind == "numeric", v.try_cast("double")).when(kind == "string", to_number(v))


def _dt_of(kind: Column, v: Column, dayfirst: bool) -> Column:
    return F.when(kind == "datetime", v.try_cast("timestamp_ntz")).when(kind == "string", to_datetime(v, dayfirst))


def column_stats(freq_k: DataFrame, dayfirst: bool = False, from_text: bool = False) -> DataFrame:
    """Per-column statistics from A0 rows carrying ``kind`` and ``ordinal``."""
    v, cnt, kind = F.col("value"), F.col("cnt"), F.col("kind")
    nn = v.isNotNull()
    num = _num_of(kind, v)
    dt = _dt_of(kind, v, dayfirst)
    bool_dom = PIPELINE_BOOL_STRINGS + (PIPELINE_BOOL_TEXT_EXTRA if from_text else [])
    s = freq_k.groupBy("table", "ordinal", "name", "kind").agg(
        F.sum(cnt).alias("n_rows"),
        F.sum(F.when(~nn, cnt).otherwise(0)).alias("missing_count"),
        F.sum(F.when(nn, cnt).otherwise(0)).alias("non_null"),
        F.count(v).alias("distinct_count"),
        F.sum(F.when(nn, F.col("len") * cnt)).alias("len_sum"),
        F.min(F.when(nn & (kind == "string"), F.col("len"))).alias("min_len"),
        F.max(F.when(nn & (kind == "string"), F.col("len"))).alias("max_len"),
        F.sum(F.when(num.isNotNull(), cnt).otherwise(0)).alias("num_parsed"),
        F.sum(F.when(dt.isNotNull(), cnt).otherwise(0)).alias("dt_parsed"),
        F.min(num).alias("num_min"),
        F.max(num).alias("num_max"),
        F.min(dt).alias("dt_min"),
        F.max(dt).alias("dt_max"),
        F.bool_and(F.when(nn, v.isin(bool_dom))).alias("str_bool"),
        F.bool_and(F.when(nn, num.isin(0.0, 1.0))).alias("zero_one"),
        F.bool_and(F.when(nn, F.lower(F.trim(v)).isin(BOOL_TRUE + BOOL_FALSE))).alias("builder_bool"),
    )
    nnd = F.col("non_null").cast("double")
    return s.select(
        "*",
        (F.col("missing_count") / F.col("n_rows")).alias("missing_ratio"),
        F.when((F.col("kind") == "string") & (F.col("non_null") > 0), F.col("len_sum") / nnd).alias("avg_len"),
        F.when(F.col("non_null") > 0, F.col("num_parsed") / nnd).alias("num_ratio"),
        F.when(F.col("non_null") > 0, F.col("dt_parsed") / nnd).alias("dt_ratio"),
        (F.col("non_null") == 0).alias("is_empty"),
    )


def build_catalog(spark, df: DataFrame, table: str = "t", dayfirst: bool = False,
                  from_text: bool = False, freq: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Column catalog with semantic types; returns ``(catalog, freq_k)``.

    ``freq_k`` is A0 with ordinal/kind attached; callers reuse it for top-k,
    outliers and quantiles so the table is scanned and shuffled once.
    """
    df = nan_to_null(df)
    static = static_catalog(spark, df, table)
    freq = freq if freq is not None else value_frequencies(df, table)
    checkpoint_dir(spark)
    # A0 is written once to the shared checkpoint folder: every consumer (catalog,
    # quartiles, top-k, outliers) reads it instead of re-running the shuffle
    freq_k = stage(with_kind(freq, static), "freq")
    stats = column_stats(freq_k, dayfirst=dayfirst, from_text=from_text)
    cat = static.select("table", "ordinal", "name", "dtype_raw", F.col("kind").alias("_kind")).join(
        stats, ["table", "ordinal", "name"], "left")
    return stage(with_semantic_types(_of_empty(cat)), "catalog"), freq_k


def _of_empty(cat: DataFrame) -> DataFrame:
    """Columns of a table without rows: nothing is missing, nothing distinct, all of it empty."""
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_rows", "missing_count", "non_null", "distinct_count", "num_parsed", "dt_parsed")}
    return cat.withColumns(zero | {"kind": F.coalesce("kind", "_kind"), "is_empty": F.coalesce("is_empty", F.lit(True))}).drop("_kind")


def basic_stats(df: DataFrame, table: str = "t") -> DataFrame:
    """Per column, from one aggregate and without a shuffle of values: ``table, ordinal, name, kind, n_rows,
    missing_count, non_null, missing_ratio, is_empty, single_valued, builder_bool, pipeline_bool``.

    A column has a single value if the least and the greatest 64-bit hash of its values are equal; the
    booleans say whether all texts of a column lie in the domain (and, for the pipeline, are at most two).
    """
    aggs, entries = basic_aggregates(df)
    return df.agg(*aggs).select(F.lit(table).alias("table"), F.inline(F.array(*entries)))


def basic_aggregates(df: DataFrame) -> tuple[list[Column], list[Column]]:
    """The aggregates of ``basic_stats``, and the struct of each column over their results."""
    aggs, entries = [F.count(F.lit(1)).alias("rows")], []
    for i, f in enumerate(df.schema.fields):
        c, k = F.col(quote(f.name)), kind_of(f.dataType)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        v = F.xxhash64(_as_text(f))
        aggs += [F.count(c).alias(f"n{i}"), F.min(F.when(c.isNotNull(), v)).alias(f"lo{i}"), F.max(F.when(c.isNotNull(), v)).alias(f"hi{i}")]
        builder = pipeline = F.lit(None).cast("boolean")
        if k == "string":
            seen = F.lit(0)
            for bit, word in enumerate(PIPELINE_BOOL_STRINGS):
                seen = F.when(c == word, F.lit(1 << bit)).otherwise(seen)
            aggs += [F.bool_and(F.lower(F.trim(c)).isin(BOOL_TRUE + BOOL_FALSE)).alias(f"b{i}"),
                     F.bool_and(c.isin(PIPELINE_BOOL_STRINGS)).alias(f"p{i}"), F.bit_or(seen).alias(f"w{i}")]
            builder, pipeline = F.coalesce(f"b{i}", F.lit(False)), F.coalesce(f"p{i}", F.lit(False)) & (F.bit_count(f"w{i}") <= 2)
        entries.append(F.struct(
            F.lit(i).alias("ordinal"), F.lit(f.name).alias("name"), F.lit(k).alias("kind"), F.col("rows").alias("n_rows"),
            (F.col("rows") - F.col(f"n{i}")).alias("missing_count"), F.col(f"n{i}").alias("non_null"),
            F.try_divide(F.col("rows") - F.col(f"n{i}"), F.col("rows")).alias("missing_ratio"), (F.col(f"n{i}") == 0).alias("is_empty"),
            F.coalesce(F.col(f"lo{i}") == F.col(f"hi{i}"), F.lit(False)).alias("single_valued"),
            builder.alias("builder_bool"), pipeline.alias("pipeline_bool")))
    return aggs, entries


def catalog_of_tables(spark, tables: dict[str, DataFrame], dayfirst: bool = False) -> DataFrame:
    """Catalog over several tables as one job (union of A0, one aggregate)."""
    statics, freqs = [], []
    for name, df in tables.items():
        df = nan_to_null(df)
        statics.append(static_catalog(spark, df, name))
        freqs.append(value_frequencies(df, name))
    static, freq = statics[0], freqs[0]
    for s_, f_ in zip(statics[1:], freqs[1:]):
        static, freq = static.unionByName(s_), freq.unionByName(f_)
    stats = column_stats(with_kind(freq, static), dayfirst=dayfirst)
    cat = static.select("table", "ordinal", "name", "dtype_raw", F.col("kind").alias("_kind")).join(stats, ["table", "ordinal", "name"], "left")
    checkpoint_dir(spark)
    # the catalog is one row per column; materialising it keeps every rule plan small
    return stage(with_semantic_types(_of_empty(cat)), "catalog")


def numeric_moments(df: DataFrame, cols: list[str], table: str = "t", parse_text: bool = True,
                    exact_mean: bool = True) -> DataFrame:
    """A10: count/mean/std/min/max per column in one wide aggregate, returned long.

    String columns are coerced with P3 first (``parse_text``).
    """
    df = nan_to_null(df)
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}

    def val(c):
        col = F.col(quote(c))
        return to_number(col) if (kinds[c] == "string" and parse_text) else col.cast("double")

    aggs = []
    for i, c in enumerate(cols):
        x = val(c)
        mean = F.try_divide(exact_sum(x), F.count(x)) if exact_mean else F.avg(x)
        aggs += [F.count(x).alias(f"n{i}"), mean.alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*aggs)
    entries = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"n{i}").alias("count"), F.col(f"m{i}").alias("mean"),
                                 F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
                        for i, c in enumerate(cols)])
    return row.select(F.inline(entries)).select(F.lit(table).alias("table"), "*")


def quartiles(freq_k: DataFrame, names: list[str] | None = None, parse_text: bool = False) -> DataFrame:
    """Exact p25/median/p75 per numeric column from A0 (no group in one task)."""
    fk = freq_k
    if names is not None:
        fk = fk.where(F.col("name").isin(names))
    if parse_text:
        num = fk.where(F.col("value").isNotNull()).select(
            "table", "name", _num_of(F.col("kind"), F.col("value")).alias("x"), "cnt").where(F.col("x").isNotNull())
    else:
        num = numeric_frequencies(fk)
    q = weighted_quantiles(num, ["table", "name"], [0.25, 0.5, 0.75])
    return quantile_columns(q, ["table", "name"], {0.25: "p25", 0.5: "median", 0.75: "p75"})


def column_quartiles(df: DataFrame, table: str, names: list[str]) -> DataFrame:
    """Exact p25/median/p75 of the named columns from the raw rows; text is coerced with P3."""
    if not names:
        return df.sparkSession.createDataFrame([], "table string, name string, p25 double, median double, p75 double")
    cells = {n: numeric_value(F.col(quote(n)), kind_of(df.schema[n].dataType)) for n in names}
    q = column_quantiles(df, cells, [0.25, 0.5, 0.75]).select(F.lit(table).alias("table"), "name", "q", "quantile")
    return quantile_columns(q, ["table", "name"], {0.25: "p25", 0.5: "median", 0.75: "p75"})


def _flat(name: str, dt: T.DataType) -> Column:
    """A nested column as text that tells its nulls and ends apart; maps as sorted entries."""
    c = F.col(quote(name))
    if isinstance(dt, T.MapType):
        c = F.array_sort(F.map_entries(c))
    nested = isinstance(dt, (T.ArrayType, T.MapType, T.StructType))
    return F.to_json(c, {"ignoreNullFields": "false"}) if nested else c


def row_fingerprint(df: DataFrame) -> list[Column]:
    """Two independent 64-bit hashes of a whole row, plus its null mask.

    Hash functions skip NULL inputs, so the null mask keeps (NULL, 'x') and
    ('x', NULL) apart; 128 bits make collisions negligible even at 10^12 rows.
    Nested columns are hashed as JSON: hashing them directly skips their null elements.
    """
    cols = [_flat(f.name, f.dataType) for f in df.schema.fields]
    mask = F.concat_ws("", *[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    return [F.xxhash64(F.lit(1), mask, *cols).alias("_h1"), F.xxhash64(F.lit(2), mask, *cols).alias("_h2")]


def duplicate_rows(df: DataFrame, table: str = "t", fingerprint: bool = True) -> DataFrame:
    """Rows equal to an earlier row on all columns (NULLs equal).

    Rows are grouped by a 128-bit fingerprint (``fingerprint=True``) so the
    shuffle carries 16 bytes per distinct row instead of the whole row; partial
    (map-side) counts shrink a hot duplicate group to one row per partition
    before the shuffle.  ``fingerprint=False`` groups by the columns themselves.
    """
    df = nan_to_null(df)
    keys = row_fingerprint(df) if fingerprint else [_flat(f.name, f.dataType) for f in df.schema.fields]
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    agg = groups.agg(F.sum("_c").alias("n_rows"), F.sum(F.col("_c") - 1).alias("duplicate_row_count"))
    return agg.select(F.lit(table).alias("table"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
                      F.coalesce("duplicate_row_count", F.lit(0)).alias("duplicate_row_count"))


def topk_values(freq_k: DataFrame, k: int, names: list[str] | None = None) -> DataFrame:
    """Top-k values per column, count desc then value asc (fixed tie rule).

    ``row_number() <= k`` is planned with a partial per-partition group limit
    before the shuffle, so a column with billions of values never reaches one task
    whole.
    """
    fk = freq_k.where(F.col("value").isNotNull())
    if names is not None:
        fk = fk.where(F.col("name").isin(names))
    w = Window.partitionBy("table", "name").orderBy(F.desc("cnt"), F.asc("value"))
    return (fk.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("table", "ordinal", "name", "rank", "value", F.col("cnt").alias("count")))


def first_values(df: DataFrame, order_col: str, k: int, cols: list[str] | None = None, table: str = "t") -> DataFrame:
    """First k non-null values of each column in ``order_col`` order.

    Unpivot + ``row_number() <= k``: planned as a per-partition group limit, then
    a final limit, so nothing unbounded reaches one task.
    """
    df = nan_to_null(df)
    cols = cols if cols is not None else df.columns
    fields = {f.name: f for f in df.schema.fields}
    long = under_each_other(df, {c: _as_text(fields[c]) for c in cols}, [F.col(quote(order_col))]).where(F.col("value").isNotNull())
    w = Window.partitionBy("name").orderBy("_k0")
    return (long.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
            .select(F.lit(table).alias("table"), "name", "position", "value"))


def with_samples(catalog: DataFrame, df: DataFrame, order_col: str, k: int = SAMPLE_VALUES_COUNT, table: str = "t") -> DataFrame:
    """Q2: the catalog with ``sample_values``, the first ``k`` values of each column that are not null."""
    first = first_values(df, order_col, k, None, table).groupBy("table", "name").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "value"))), lambda x: x["value"]).alias("sample_values"))
    return catalog.join(first, ["table", "name"], "left")


def sketch_catalog(spark, df: DataFrame, table: str = "t", dayfirst: bool = False, rsd: float = 0.01) -> DataFrame:
    """Scale mode: the catalog from one pass over the raw rows, no value shuffle.

    Distinct counts are HyperLogLog estimates (``approx_count_distinct`` with
    relative error ``rsd``); everything else (nulls, lengths, parse successes,
    domain tests, numeric range) is exact.  Each column contributes a handful of
    partial aggregates, merged in one final step -- the cost is one scan however
    large the table.  Same columns as ``build_catalog``'s catalog, so the type
    rules, roles and chart rules run unchanged on it.
    """
    df = nan_to_null(df)
    static = static_catalog(spark, df, table)
    bool_dom = PIPELINE_BOOL_STRINGS
    aggs, entries = [], []
    for i, f in enumerate(df.schema.fields):
        k = kind_of(f.dataType)
        c = F.col(quote(f.name))
        txt = c.cast("string") if k != "other" else F.to_json(c)
        num = c.cast("double") if k == "numeric" else (to_number(c) if k == "string" else F.lit(None).cast("double"))
        dtv = c.cast("timestamp_ntz") if k == "datetime" else (to_datetime(c, dayfirst) if k == "string" else F.lit(None).cast("timestamp_ntz"))
        ln = F.char_length(txt) if k == "string" else F.lit(None).cast("int")
        aggs += [
            F.count(F.lit(1)).alias(f"r{i}"), F.count(c).alias(f"n{i}"), F.approx_count_distinct(txt, rsd).alias(f"d{i}"),
            F.sum(ln).alias(f"ls{i}"), F.min(ln).alias(f"lmin{i}"), F.max(ln).alias(f"lmax{i}"),
            F.count(num).alias(f"np{i}"), F.count(dtv).alias(f"dp{i}"), F.min(num).alias(f"nmin{i}"), F.max(num).alias(f"nmax{i}"),
            F.bool_and(F.when(c.isNotNull(), txt.isin(bool_dom))).alias(f"sb{i}"),
            F.bool_and(F.when(c.isNotNull(), num.isin(0.0, 1.0))).alias(f"z{i}"),
            F.bool_and(F.when(c.isNotNull(), F.lower(F.trim(txt)).isin(BOOL_TRUE + BOOL_FALSE))).alias(f"bb{i}"),
        ]
        entries.append(F.struct(
            F.lit(f.name).alias("name"), F.lit(k).alias("kind"), F.col(f"r{i}").alias("n_rows"),
            (F.col(f"r{i}") - F.col(f"n{i}")).alias("missing_count"), F.col(f"n{i}").alias("non_null"),
            F.col(f"d{i}").alias("distinct_count"), F.col(f"ls{i}").cast("long").alias("len_sum"),
            F.col(f"lmin{i}").alias("min_len"), F.col(f"lmax{i}").alias("max_len"), F.col(f"np{i}").alias("num_parsed"),
            F.col(f"dp{i}").alias("dt_parsed"), F.col(f"nmin{i}").alias("num_min"), F.col(f"nmax{i}").alias("num_max"),
            F.col(f"sb{i}").alias("str_bool"), F.col(f"z{i}").alias("zero_one"), F.col(f"bb{i}").alias("builder_bool")))
    s = df.agg(*aggs).select(F.inline(F.array(*entries)))
    nnd = F.col("non_null").cast("double")
    s = s.select("*", (F.col("missing_count") / F.col("n_rows")).alias("missing_ratio"),
                 F.when((F.col("kind") == "string") & (F.col("non_null") > 0), F.col("len_sum") / nnd).alias("avg_len"),
                 F.when(F.col("non_null") > 0, F.col("num_parsed") / nnd).alias("num_ratio"),
                 F.when(F.col("non_null") > 0, F.col("dt_parsed") / nnd).alias("dt_ratio"),
                 (F.col("non_null") == 0).alias("is_empty"))
    cat = static.select("table", "ordinal", "name", "dtype_raw").join(s, "name")
    return with_semantic_types(cat)


def moments_from_frequencies(freq_k: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A10 from A0 instead of the raw rows: count, exact mean, std (ddof=1), min, max.

    The raw table is not scanned again.  The mean is ``exact_sum`` of value x count over
    the count, null for a column that holds infinity; the std is a second pass over the
    (already staged) A0 rows with the per-column mean broadcast back (one row per column).
    """
    fk = freq_k.where(F.col("value").isNotNull())
    if names is not None:
        fk = fk.where(F.col("name").isin(names))
    vals = fk.select("table", "name", _num_of(F.col("kind"), F.col("value")).alias("x"), "cnt").where(F.col("x").isNotNull())
    first = vals.groupBy("table", "name").agg(
        F.sum("cnt").alias("count"),
        finite_or_null(exact_sum(F.col("x"), F.col("cnt")) / F.sum("cnt")).alias("mean"),
        F.min("x").alias("min"), F.max("x").alias("max"))
    dev = (vals.join(F.broadcast(first.select("table", "name", "mean")), ["table", "name"])
           .groupBy("table", "name")
           .agg(F.sum(F.col("cnt") * (F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean"))).alias("_ss")))
    return first.join(dev, ["table", "name"]).select(
        "table", "name", "count", "mean",
        F.when(F.col("count") > 1, F.sqrt(F.col("_ss") / (F.col("count") - 1))).alias("std"), "min", "max")
