"""A20 for many columns: all pairwise correlations in one scan.

The counts and sums of every pair over the rows where both are present are matrix products of the block of values with
itself and with its mask of presence, so a partition is reduced to one row per pair (`mapInArrow`; the built-in
aggregates would be three expressions a pair, some 15,000 for 100 columns).  The rows of all partitions are then
merged by pair: what is shuffled is partitions x pairs, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import nan_to_null
from .charts import num

PARTIAL = "i int, j int, n long, infinite long, x0 double, y0 double, mx double, my double, cxx double, cyy double, cxy double"


class _Sums:
    """Sums of a partition over the rows where both columns of a pair are present, around a fixed shift per column."""

    def __init__(self, width: int):
        self.shift = np.full(width, np.nan)
        self.n, self.infinite, self.x, self.xx, self.xy = (np.zeros((width, width)) for _ in range(5))

    def add(self, v: np.ndarray) -> None:
        there = ~np.isnan(v)
        wild = np.isinf(v)
        if wild.any():
            a, w = there.astype(float), wild.astype(float)
            self.infinite += w.T @ a + a.T @ w - w.T @ w
            there &= ~wild
        v = np.where(there, v, 0.0)
        for c in np.flatnonzero(np.isnan(self.shift) & there.any(axis=0)):
            own = v[there[:, c], c]
            # the first value, moved to the mean: a column of one value is shifted to zero exactly
            self.shift[c] = own[0] + np.mean(own - own[0])
        v = np.where(there, v - np.nan_to_num(self.shift), 0.0)
        m = there.astype(float)
        self.n += m.T @ m
        self.x += v.T @ m
        self.xx += (v * v).T @ m
        self.xy += v.T @ v

    def rows(self) -> pa.RecordBatch:
        i, j = np.triu_indices(len(self.shift))
        n = self.n[i, j]
        some = np.maximum(n, 1)
        sx, sy = self.x[i, j], self.x[j, i]
        shift = np.nan_to_num(self.shift)
        cells = [i.astype("int32"), j.astype("int32"), n.astype("int64"), self.infinite[i, j].astype("int64"),
                 shift[i], shift[j], sx / some, sy / some, self.xx[i, j] - sx * sx / some, self.xx[j, i] - sy * sy / some,
                 self.xy[i, j] - sx * sy / some]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=[f.split()[0] for f in PARTIAL.split(", ")])


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = None
    for b in batches:
        sums = sums or _Sums(b.num_columns)
        if b.num_rows:
            sums.add(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]))
    if sums is not None:
        yield sums.rows()


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """``x, y, n, corr`` of all pairs of the numeric (or coerced) columns ``cols``, both ways, a column with itself included.

    Pearson's coefficient over the ``n`` rows where both are present; null for fewer than two such rows or a column that
    is constant on them, NaN where one of them holds an infinite value.  A table without rows gives every pair with 0 rows.
    """
    if not cols:
        return df.sparkSession.createDataFrame([], "x string, y string, n long, corr double")
    df = nan_to_null(df)
    wide = df.select(*[num(df, c).alias(f"c{i}") for i, c in enumerate(cols)])
    # every pair is there once, also where no partition has rows
    part = wide.mapInArrow(_reduced, PARTIAL).where("n > 0 or infinite > 0")
    pair = Window.partitionBy("i", "j")
    n = F.col("n")
    some = F.when(n > 0, F.lit(1))
    # means (a shift and what is beyond it) relative to the least shift: equal means differ by exactly zero, and far ones keep their last digits
    shifted = part.select("*", *[(F.col(f"{x}0") - F.min(some * F.col(f"{x}0")).over(pair) + F.col(f"m{x}")).alias(f"d{x}") for x in "xy"])

    def merged(c: str, a: str, b: str):
        s = F.sum(F.when(n > 0, F.col(c) + n * F.col(a) * F.col(b)))
        return s - F.try_divide(F.sum(n * F.col(a)) * F.sum(n * F.col(b)), F.sum(n))

    pairs = shifted.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("infinite").alias("infinite"),
                                          merged("cxx", "dx", "dx").alias("cxx"), merged("cyy", "dy", "dy").alias("cyy"), merged("cxy", "dx", "dy").alias("cxy"))
    corr = (F.when(F.col("infinite") > 0, F.lit(float("nan"))).when((n > 1) & (F.col("cxx") > 0) & (F.col("cyy") > 0),
            F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide("cxy", F.sqrt("cxx") * F.sqrt("cyy"))))))
    at = df.sparkSession.range(len(cols) ** 2).select((F.col("id") / len(cols)).cast("int").alias("a"), (F.col("id") % len(cols)).cast("int").alias("b"))
    both = at.join(F.broadcast(pairs), (F.least("a", "b") == F.col("i")) & (F.greatest("a", "b") == F.col("j")), "left")   # one row per pair
    names = F.array(*[F.lit(c) for c in cols])
    return both.select(F.get(names, F.col("a")).alias("x"), F.get(names, F.col("b")).alias("y"),
                       (F.coalesce("n", F.lit(0)) + F.coalesce("infinite", F.lit(0))).alias("n"), corr.alias("corr"))
