"""The data behind each chart spec.

Every chart is a group-by (or a projection) over the whole table; nothing is
sampled or capped.  Medians and box statistics use the distributed exact
quantiles, so a hot group never has to fit one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import datetime_value, finite_or_null, iso_text, kind_of, nan_to_null, numeric_value, quote
from ..functions.constants import HISTOGRAM_BINS, IQR_MULTIPLIER
from ..session import stage
from .quantiles import quantile_columns, refined_quantiles

TABLE_ROWS = 500
AGGREGATIONS = ["sum", "avg", "count", "min", "max", "median"]


def _kind(df: DataFrame, c: str) -> str:
    return kind_of(df.schema[c].dataType)


def num(df: DataFrame, c: str) -> Column:
    return numeric_value(F.col(quote(c)), _kind(df, c))


def dt(df: DataFrame, c: str, dayfirst: bool = False) -> Column:
    return datetime_value(F.col(quote(c)), _kind(df, c), dayfirst)


def exact_sum(x: Column, times: Column | None = None) -> Column:
    """Sum of ``x`` (each value ``times`` times) as a double.

    Where every value of the group is a decimal of up to six places, as money and counts are, the sum is
    exact and does not depend on the order of rows.  One value that is not (tiny, huge, infinite, or a float's
    binary fraction) makes it the sum of doubles; nothing is cut off.
    """
    d = x.try_cast("decimal(38,6)")
    fits = F.bool_and(F.when(x.isNotNull(), F.coalesce(d.cast("double") == x, F.lit(False))))
    exact = F.try_sum(d if times is None else F.try_multiply(d, times.cast("decimal(38,0)"))).cast("double")
    return F.coalesce(F.when(fits, exact), F.sum(x if times is None else x * times))


def _agg(fn: str, x: Column) -> Column:
    fn = fn.lower()
    if fn == "sum":
        return exact_sum(x)
    if fn == "avg":
        return F.avg(x)
    if fn == "count":
        return F.count(x)
    if fn == "min":
        return F.min(x)
    if fn == "max":
        return F.max(x)
    raise ValueError(f"unsupported aggregation {fn}")


def aggregate_by(df: DataFrame, keys: list[Column], names: list[str], y: Column | None, fn: str,
                 out: str = "value") -> DataFrame:
    """Group the rows by ``keys`` and aggregate ``y``; ``median`` is exact and distributed.  A null key is a group."""
    kdf = df.select(*[k.alias(n) for k, n in zip(keys, names)], (y if y is not None else F.lit(1)).alias("_y"))
    if fn.lower() != "median":
        return kdf.groupBy(*names).agg(_agg(fn, F.col("_y")).alias(out))
    q = refined_quantiles(kdf, names, [0.5], "_y")
    every = kdf.select(*names).distinct()
    same = [F.col(f"k.{n}").eqNullSafe(F.col(f"q.{n}")) for n in names]
    return every.alias("k").join(q.alias("q"), same, "left").select(*[F.col(f"k.{n}").alias(n) for n in names], F.col("q.quantile").alias(out))


# ---------------------------------------------------------------- A14 / A15 / A21
def datetime_range(df: DataFrame, c: str, dayfirst: bool = False) -> DataFrame:
    d = dt(df, c, dayfirst)
    return df.agg(F.count(d).alias("count"), F.min(d).alias("_mn"), F.max(d).alias("_mx")).select(
        "count", iso_text(F.col("_mn")).alias("min"), iso_text(F.col("_mx")).alias("max"))


def daily_counts(df: DataFrame, c: str, dayfirst: bool = False) -> DataFrame:
    d = dt(df, c, dayfirst)
    return (df.select(F.to_date(d).alias("day")).where(F.col("day").isNotNull())
            .groupBy("day").agg(F.count(F.lit(1)).alias("count")).orderBy("day"))


def text_lengths(df: DataFrame, c: str) -> DataFrame:
    ln = F.char_length(F.col(quote(c)).cast("string"))
    return df.agg(F.count(ln).alias("count"), F.avg(ln).alias("avg_length"),
                  F.min(ln).alias("min_length"), F.max(ln).alias("max_length"))


# ---------------------------------------------------------------- A18 / C4 histogram
def histogram(df: DataFrame, c: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed; edges as ``lo + i*(hi-lo)/bins``.

    The range is a one-row aggregate fetched first (two numbers) and used as
    literals, so binning is a projection plus one grouped count -- no join.  Infinite values have no
    place on the axis and are not binned; a range wider than a double is halved before it is taken.
    """
    x = finite_or_null(num(df, c))
    vals = df.select(x.alias("x")).where(F.col("x").isNotNull())
    r = vals.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    # no values: any range gives the same (empty) result
    lo, hi = (float(r[e]) if r[e] is not None else 0.0 for e in ("lo", "hi"))
    wide = math.isinf(hi - lo)
    half = 0.5 if wide else 1.0
    w = hi * half - lo * half
    b = F.lit(0).cast("long") if lo == hi else F.least(F.floor((F.col("x") * half - lo * half) / w * bins).cast("long"), F.lit(bins - 1))

    def edge(i: Column) -> Column:
        return lo * (1 - i / bins) + hi * (i / bins) if wide else lo + F.lit(hi - lo) * i / bins

    return (vals.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
            .select("bin", edge(F.col("bin")).alias("bin_low"), edge(F.col("bin") + 1).alias("bin_high"), "count"))


# ---------------------------------------------------------------- A20 / C7 correlation
def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete Pearson for i <= j in one aggregate, mirrored to all pairs.

    ``try_divide`` gives NULL for a constant column (plain ``corr`` raises under ANSI).
    """
    df = nan_to_null(df)
    xs = {c: num(df, c) for c in cols}
    aggs, pairs = [], []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            xa = F.when(xs[b].isNotNull(), xs[a])
            xb = F.when(xs[a].isNotNull(), xs[b])
            k = len(pairs)
            aggs += [F.covar_samp(xa, xb).alias(f"c{k}"), F.stddev_samp(xa).alias(f"sa{k}"), F.stddev_samp(xb).alias(f"sb{k}")]
            pairs.append((a, b))
    row = df.agg(*aggs)
    entries = []
    for k, (a, b) in enumerate(pairs):
        v = F.try_divide(F.col(f"c{k}"), F.col(f"sa{k}") * F.col(f"sb{k}"))
        entries.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), v.alias("corr")))
        if a != b:
            entries.append(F.struct(F.lit(b).alias("x"), F.lit(a).alias("y"), v.alias("corr")))
    return row.select(F.inline(F.array(*entries)))


# ---------------------------------------------------------------- A19 / C5 box plot
def box_stats(df: DataFrame, y: str, by: str | None = None, multiplier: float = IQR_MULTIPLIER) -> DataFrame:
    """Five-number summary with 1.5 IQR whiskers and outlier counts, optionally per group.

    Quartiles come from refined histograms over the raw rows.  A null group is a box of its own, whatever the
    group column is called; values that are missing or not finite do not count.
    """
    key = F.col(quote(by)).cast("string") if by else F.lit("all")
    base = df.select(key.alias("_g"), finite_or_null(num(df, y)).alias("_x")).where(F.col("_x").isNotNull())
    q = stage(refined_quantiles(base, ["_g"], [0.25, 0.5, 0.75], "_x"), "quartiles")
    qs = quantile_columns(q, ["_g"], {0.25: "q1", 0.5: "median", 0.75: "q3"})
    iqr = F.col("q3") - F.col("q1")
    fences = qs.select("_g", "q1", "median", "q3", (F.col("q1") - multiplier * iqr).alias("low_fence"),
                       (F.col("q3") + multiplier * iqr).alias("high_fence"))
    x = F.col("r._x")
    inside = (x >= F.col("f.low_fence")) & (x <= F.col("f.high_fence"))
    found = base.alias("r").join(fences.alias("f"), F.col("r._g").eqNullSafe(F.col("f._g"))).groupBy(
        "f._g", "q1", "median", "q3", "low_fence", "high_fence").agg(
        F.count(F.lit(1)).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
        F.sum(F.when(~inside, 1).otherwise(0)).alias("n_outliers"))
    return found.select(*([F.col("_g").alias(by)] if by else []), "count", "min", "q1", "median", "q3", "max", "low_fence",
                        "high_fence", "whisker_low", "whisker_high", "n_outliers")


# ---------------------------------------------------------------- C1-C3, C6-C8
def line_chart(df: DataFrame, x: str, y: str, agg: str = "sum", grain: str = "month",
               group_by: list[str] | None = None, dayfirst: bool = False) -> DataFrame:
    """Measure over time at a grain (day/week/month/quarter/year), with optional columns ``series``, ``series_2`` ..."""
    t = F.date_trunc(grain, dt(df, x, dayfirst)).cast("timestamp_ntz")
    keys, names = [t], ["period"]
    for i, g in enumerate(group_by or [], 1):
        keys.append(F.col(quote(g)).cast("string"))
        names.append("series" if i == 1 else f"series_{i}")
    out = aggregate_by(df.where(dt(df, x, dayfirst).isNotNull()), keys, names, num(df, y), agg)
    return out.orderBy(*names)


def bar_chart(df: DataFrame, x: str, y: str | None, agg: str = "sum") -> DataFrame:
    """Measure per category (NULL category kept as its own bar)."""
    return aggregate_by(df, [F.col(quote(x)).cast("string")], ["category"], num(df, y) if y else None, agg)


def pie_chart(df: DataFrame, x: str, y: str | None, agg: str = "sum") -> DataFrame:
    """Bar values plus the share of the total (a one-row aggregate, used as a literal)."""
    # one row per category, staged so the total and the shares read it instead of re-scanning the table
    bars = stage(bar_chart(df, x, y, agg), "pie-bars")
    total = bars.agg(F.sum("value").alias("_total")).first()["_total"]  # one row
    t = F.lit(total) if total is not None else F.lit(None).cast("double")
    return bars.select("category", "value", F.try_divide(F.col("value"), t).alias("share"))


def scatter_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """Every (x, y) pair with both values present."""
    return nan_to_null(df.select(num(df, x).alias("x"), num(df, y).alias("y"))).dropna()


def scatter_binned(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """C6 for tables of any size: counts of all finite (x, y) pairs on a grid of ``bins`` x ``bins`` cells over their ranges.

    One row per cell that holds a pair, with its lower edges and the extent of its pairs; a range of one value is
    the cell 0.  Halves keep ranges beyond the largest double finite.
    """
    points = scatter_points(df, x, y).select(finite_or_null(F.col("x")).alias("x"), finite_or_null(F.col("y")).alias("y")).dropna()
    lo_x, hi_x, lo_y, hi_y = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()   # one row

    def cell(c: str, lo: float | None, hi: float | None) -> Column:
        if lo is None or lo == hi:
            return F.lit(0)
        share = (F.col(c) / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)
        return F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")

    def edge(c: str, lo: float | None, hi: float | None) -> Column:
        return F.lit(lo) if lo is None or lo == hi else F.lit(lo) + F.col(c) * F.lit((hi / 2 - lo / 2) / bins) * 2

    cells = points.groupBy(cell("x", lo_x, hi_x).alias("x_bin"), cell("y", lo_y, hi_y).alias("y_bin")).agg(
        F.count(F.lit(1)).alias("count"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    return cells.select("x_bin", "y_bin", edge("x_bin", lo_x, hi_x).cast("double").alias("x_edge"), edge("y_bin", lo_y, hi_y).cast("double").alias("y_edge"),
                        "count", "x_min", "x_max", "y_min", "y_max")


def heatmap(df: DataFrame, a: str, b: str, y: str | None, agg: str = "sum") -> DataFrame:
    """Dimension x dimension grid of an aggregated measure."""
    return aggregate_by(df, [F.col(quote(a)).cast("string"), F.col(quote(b)).cast("string")], ["row", "column"],
                        num(df, y) if y else None, agg)


def table_chart(df: DataFrame, cols: list[str], n: int = TABLE_ROWS) -> DataFrame:
    """The chosen columns of the table's first ``n`` rows in their own order (a page of a dashboard)."""
    picked = [F.col(quote(c)) for c in cols]
    return df.select(*picked).orderBy(*picked).limit(n)
