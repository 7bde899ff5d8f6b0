"""Exact quantiles by refinement of histograms: no value is shuffled or sorted, no group gathered into one task.

``refined_quantiles`` works on raw rows, ``weighted_quantiles`` on counted values (A0); ``approx_quantiles`` is the
sketch for callers who accept one (one pass).
"""

from __future__ import annotations

import math
import struct
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import quote, under_each_other
from ..session import drop_staged, stage


def _lerp(a, b, t):
    """numpy-style linear interpolation: a + (b-a)*t, or b - (b-a)*(1-t) when t >= 0.5."""
    d = b - a
    return F.when(t >= 0.5, b - d * (F.lit(1.0) - t)).otherwise(a + d * t)


def with_order_key(df: DataFrame, x: str, out: str) -> DataFrame:
    """``df`` with a long ``out`` in the order of ``x``: its magnitude's place among all doubles, with its sign.

    -0.0 and 0.0 share the key 0.  Powers of two are exact, so every step is; the logarithm only has to be right
    within one binary exponent.  The steps are columns of their own, so that each is evaluated once a row.
    """
    t = df.withColumn("_a", F.abs(x))
    t = t.withColumn("_e", F.greatest(F.least(F.floor(F.log2("_a")), F.lit(1023)), F.lit(-1022)).cast("long"))
    t = t.withColumn("_u", F.pow(F.lit(2.0), F.col("_e")))
    low, high = F.col("_a") < F.col("_u"), F.col("_a") / 2 >= F.col("_u")
    t = t.withColumn("_m", F.col("_a") / F.when(low, F.col("_u") / 2).when(high, F.col("_u") * 2).otherwise(F.col("_u")))
    exponent = F.col("_e") + F.when(low, -1).when(high, 1).otherwise(0) + 1022
    normal = exponent * F.lit(1 << 52) + (F.col("_m") * F.lit(2.0 ** 52)).cast("long")
    tiny = (F.col("_a") * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long")   # multiples of the least double
    t = t.withColumn(out, F.when(F.col("_a") == 0, F.lit(0).cast("long")).when(F.col("_a") == float("inf"), F.lit(0x7FF << 52))
                     .when(F.col("_a") < F.lit(2.0 ** -1022), tiny).otherwise(normal))
    return t.withColumn(out, F.when(F.col(x) < 0, -F.col(out)).otherwise(F.col(out))).drop("_a", "_e", "_u", "_m")


#: Buckets of a bracket in one round, about.
BUCKETS = 4096


def _brackets(ends: DataFrame) -> DataFrame:
    """Brackets ``a, b`` with the ``width`` of their buckets in keys; keys of both signs are halved before they are subtracted."""
    t = with_order_key(with_order_key(ends, "a", "lo"), "b", "hi")
    same_sign = (F.col("lo") >= 0) | (F.col("hi") < 0)
    part = lambda c: F.call_function("div", c, F.lit(BUCKETS))
    width = F.when(same_sign, part(F.col("hi") - F.when(same_sign, F.col("lo")).otherwise(F.lit(0)))).otherwise(part(F.col("hi")) - part(F.col("lo")))
    return t.withColumn("width", width + 1).drop("lo", "hi")


def refined_quantiles(rows: DataFrame, keys: list[str], qs: list[float], value: str = "x",
                      weight: str | None = None) -> DataFrame:
    """Exact quantiles per key group: ``(keys..., q, quantile)``, linear between ranks; no value is shuffled.

    A wanted rank is found by repeated histograms.  The first pass gives each group's least and greatest value and its
    number of rows; every further pass cuts the brackets in which wanted ranks lie into some ``BUCKETS`` buckets of
    the order key, counts them with a partial aggregate, and goes on with the bucket that holds the rank.  A bracket
    whose least and greatest value are equal is the answer.  Keys have 64 bits and a round takes about 12, whatever the
    values are, so there are at most six rounds and about log_4096 of the number of different values.

    What is shuffled is at most ``BUCKETS`` counts per bracket and task; a group of any size or a value with many
    repeats is a few rows.  Brackets (at most two per quantile and group) are joined to the rows as Spark sees fit
    by their size.  ``rows`` is read once a round: a table's columns, or a staged A0 with ``weight`` its counts.  Rows
    with a null or NaN value or without a positive weight do not count; a null key is a group like any other.
    """
    names = [f"_g{i}" for i in range(len(keys))] or ["_g0"]
    groups = [F.col(quote(k)) for k in keys] or [F.lit(0)]
    x = F.col(quote(value)).cast("double")
    base = rows.select(*[k.alias(n) for k, n in zip(groups, names, strict=True)], (x + F.lit(0.0)).alias("x"),
                       (F.lit(1) if weight is None else F.col(quote(weight))).cast("long").alias("c"))
    base = base.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.col("c") > 0))

    def inside(held: DataFrame) -> DataFrame:
        mine = [F.col(f"r.{n}").eqNullSafe(F.col(f"h.{n}")) for n in names]
        return base.alias("r").join(held.alias("h"), mine).where("r.x >= h.a AND r.x <= h.b").select(
            *[F.col(f"r.{n}").alias(n) for n in names], F.col("h.a").alias("from"), "x", "c", "width")

    found = stage(
        base.groupBy(*names).agg(F.sum("c").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
        .withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
        .withColumn("pos", F.col("q") * (F.col("n") - 1))
        .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))))
        .withColumn("below", F.lit(0).cast("long")), "brackets")
    while not (open_ := found.where("a <> b")).isEmpty():
        held = _brackets(open_.select(*names, "a", "b").distinct())
        mine = [F.col(f"r.{n}").eqNullSafe(F.col(f"h.{n}")) for n in names]
        inside = base.alias("r").join(held.alias("h"), mine).where("r.x >= h.a AND r.x <= h.b").select(
            *[F.col(f"r.{n}").alias(n) for n in names], F.col("h.a").alias("from"), "x", "c", "width")
        counts = (with_order_key(inside, "x", "_k").withColumn("bucket", F.call_function("div", F.col("_k"), F.col("width")))
                  .groupBy(*names, "from", "bucket").agg(F.sum("c").alias("c"), F.min("x").alias("a"), F.max("x").alias("b")))
        upto = F.sum("c").over(Window.partitionBy(*names, "from").orderBy("bucket"))
        counts = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("c"))
        there = [F.col(f"w.{n}").eqNullSafe(F.col(f"c.{n}")) for n in names] + [F.col("w.a") == F.col("c.from")]
        at = F.col("w.rank") - F.col("w.below")
        closer = open_.alias("w").join(counts.alias("c"), there).where((at >= F.col("c.before")) & (at < F.col("c.upto")))
        last, found = found, stage(found.where("a = b").unionByName(closer.select(
            *[F.col(f"w.{n}").alias(n) for n in names], "w.n", "c.a", "c.b", "w.q", "w.pos", "w.rank",
            (F.col("w.below") + F.col("c.before")).alias("below"))), "brackets")
        drop_staged(last)
    frac = F.col("pos") - F.floor("pos")
    out = found.groupBy(*names, "q", "pos").agg(F.min("a").alias("lower"), F.max("a").alias("upper")).select(
        *names, "q", _lerp(F.col("lower"), F.col("upper"), frac).alias("quantile"))
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=False)], "q", "quantile")


def _key(x: float) -> int:
    """The order key of one number."""
    size = int.from_bytes(struct.pack(">d", abs(x)), "big")
    return -size if x < 0 else size


def column_quantiles(df: DataFrame, cells: dict[str, Column], qs: list[float]) -> DataFrame:
    """``name, q, quantile`` of several columns of a table, as ``refined_quantiles``: ``cells`` are numbers by name.

    The first pass is one aggregate for all columns.  In the rounds every column is a scan of its own, so that a column
    is read alone and its brackets are plain filters that reach the scan.  The driver holds the brackets (at most two
    per quantile and column) and nothing else; columns without a number have no row.
    """
    spark, names = df.sparkSession, list(cells)
    wide = df.select(*[(cells[n].cast("double") + F.lit(0.0)).alias(f"x{i}") for i, n in enumerate(names)])
    valid = [F.when(~F.isnan(f"x{i}"), F.col(f"x{i}")) for i in range(len(names))]
    ends = wide.agg(*[f(v).alias(f"{t}{i}") for i, v in enumerate(valid) for t, f in (("n", F.count), ("a", F.min), ("b", F.max))]).first()
    # (column, rank) -> rows below the bracket, its least and greatest value
    place = {(i, rank): (0, ends[f"a{i}"], ends[f"b{i}"]) for i in range(len(names)) if ends[f"n{i}"]
             for q in qs for rank in (math.floor(q * (ends[f"n{i}"] - 1)), math.ceil(q * (ends[f"n{i}"] - 1)))}
    while True:
        brackets = sorted({(i, a, b) for (i, _), (_, a, b) in place.items() if a != b})
        if not brackets:
            break
        parts = []
        for i in sorted({i for i, _, _ in brackets}):
            x, start, width, within = F.col(f"x{i}"), F.lit(None), F.lit(None), F.lit(False)
            for _, a, b in (t for t in brackets if t[0] == i):
                here = (x >= a) & (x <= b)
                start = F.when(here, F.lit(a)).otherwise(start)
                width = F.when(here, F.lit((_key(b) - _key(a)) // BUCKETS + 1)).otherwise(width)
                within = within | here
            parts.append(wide.where(within & ~F.isnan(x)).select(
                F.lit(i).alias("i"), start.cast("double").alias("from"), x.alias("x"), width.cast("long").alias("width")))
        counts = (with_order_key(reduce(DataFrame.unionAll, parts), "x", "_k")
                  .withColumn("bucket", F.call_function("div", F.col("_k"), F.col("width")))
                  .groupBy("i", "from", "bucket").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("a"), F.max("x").alias("b")))
        upto = F.sum("c").over(Window.partitionBy("i", "from").orderBy("bucket"))
        ranks = spark.createDataFrame([(i, rank, a, rank - below) for (i, rank), (below, a, b) in place.items() if a != b],
                                      "i int, rank long, from double, at long")
        for r in (counts.withColumn("upto", upto).join(ranks, ["i", "from"])
                  .where("at < upto AND at >= upto - c").select("i", "rank", (F.col("upto") - F.col("c")).alias("before"), "a", "b").collect()):
            place[r["i"], r["rank"]] = (place[r["i"], r["rank"]][0] + r["before"], r["a"], r["b"])
    out = []
    for i, n in enumerate(names):
        for q in qs if ends[f"n{i}"] else []:
            pos = q * (ends[f"n{i}"] - 1)
            lower, upper, t = place[i, math.floor(pos)][1], place[i, math.ceil(pos)][1], pos - math.floor(pos)
            out.append((n, float(q), upper - (upper - lower) * (1.0 - t) if t >= 0.5 else lower + (upper - lower) * t))
    return spark.createDataFrame(out, "name string, q double, quantile double")


def weighted_quantiles(freq: DataFrame, keys: list[str], qs: list[float], value: str = "x", weight: str = "cnt") -> DataFrame:
    """``refined_quantiles`` of counted values (an A0), staged: keys x quantiles rows."""
    return stage(refined_quantiles(freq, keys, qs, value, weight), "quantiles")


def quantile_columns(qdf: DataFrame, keys: list[str], names: dict[float, str]) -> DataFrame:
    """Pivot ``(keys, q, quantile)`` into one column per requested q."""
    return qdf.groupBy(*keys).agg(*[
        F.max(F.when(F.col("q") == F.lit(float(q)), F.col("quantile"))).alias(n) for q, n in names.items()
    ])


def approx_quantiles(df: DataFrame, cols: list[str], qs: list[float], accuracy: int = 10000,
                     table: str = "t") -> DataFrame:
    """Scale mode: ``percentile_approx`` sketches for all columns in one aggregate."""
    sketches = [F.percentile_approx(F.col(quote(c)).cast("double"), [float(q) for q in qs], accuracy).alias(f"a{i}")
                for i, c in enumerate(cols)]
    long = under_each_other(df.agg(*sketches), {c: F.col(f"a{i}") for i, c in enumerate(cols)}, None, "qv")
    return long.select(F.lit(table).alias("table"), "name",
                       F.posexplode(F.arrays_zip(F.array(*[F.lit(float(q)) for q in qs]).alias("q"),
                                                 F.col("qv").alias("v"))).alias("i", "z")) \
        .select("table", "name", F.col("z.q").alias("q"), F.col("z.v").alias("quantile"))
