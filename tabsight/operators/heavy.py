"""A12 at scale: exact top values of columns without a shuffle of all distinct values.

One aggregate keeps a mergeable frequent-items summary of bounded size per column (a typed aggregate with map-side
partials), whose items are the candidates; a second pass counts the candidates exactly.  The answer is proved complete
where no value outside the candidates can reach the k-th count: its count is at most what the candidates leave uncovered,
and at most the summary's error, ``ERROR / tracked`` of the column's values.  Columns for which neither holds are answered
from A0, of those columns alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import nan_to_null, quote, under_each_other
from ..session import drop_staged, stage
from .freq import _as_text, value_frequencies

#: Values that a summary tracks, and its error: a value that it does not report has at most ``ERROR / TRACKED`` of all.
#: That is twice the summary's own bound of 3.5, as it reports only values that are surely above that.
TRACKED, ERROR = 8192, 7.0


def candidates(df: DataFrame, cols: list[str], tracked: int = TRACKED) -> DataFrame:
    """``name, value, n``: at most ``tracked`` frequent values per column, and the column's number of values.

    A column for which the summary has none, as where all values are rare, has one row with a null.
    """
    fields = {f.name: f for f in df.schema.fields}
    wide = df.select(*[_as_text(fields[c]).alias(f"v{i}") for i, c in enumerate(cols)])
    aggs = [a for i in range(len(cols)) for a in (
        F.expr(f"approx_top_k(v{i}, {tracked}, {tracked}) FILTER (WHERE v{i} IS NOT NULL)").alias(f"t{i}"), F.count(f"v{i}").alias(f"n{i}"))]
    each = [F.struct(F.lit(c).alias("name"), F.transform(f"t{i}", lambda x: x["item"]).alias("items"), F.col(f"n{i}").alias("n"))
            for i, c in enumerate(cols)]
    return wide.agg(*aggs).select(F.inline(F.array(*each))).select("name", F.explode_outer("items").alias("value"), "n")


def heavy_hitters(df: DataFrame, cols: list[str], k: int, table: str = "t", tracked: int = TRACKED) -> tuple[DataFrame, list[str]]:
    """``table, name, rank, value, count``: the ``k`` most frequent values per column, exactly, ties by value; and the
    columns that had to be answered from A0.

    Nulls do not count; a column without values has no rows.  Candidates (``tracked`` per column) are joined to the rows
    as Spark sees fit by their size.
    """
    df = nan_to_null(df)
    fields = {f.name: f for f in df.schema.fields}
    held = stage(candidates(df, cols, tracked), "candidates")
    rows = under_each_other(df, {c: _as_text(fields[c]) for c in cols})
    counted = stage(rows.join(held.select("name", "value"), ["name", "value"]).groupBy("name", "value")
                    .agg(F.count(F.lit(1)).alias("cnt")), "candidatecounts")
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("cnt"), "value"))
    ranked = counted.withColumn("rank", place)
    # one row per column: how much the candidates cover, and the k-th count (0 where there are fewer)
    ends = ranked.groupBy("name").agg(F.sum("cnt").alias("covered"), F.max(F.when(F.col("rank") == k, F.col("cnt"))).alias("kth"))
    sums = held.groupBy("name").agg(F.max("n").alias("n")).where("n > 0").join(ends, "name", "left").na.fill(0).collect()
    proved = [r["name"] for r in sums
              if r["covered"] == r["n"] or r["kth"] > min(r["n"] - r["covered"], ERROR / tracked * r["n"])]
    rest = [c for c in cols if c not in proved and c in {r["name"] for r in sums}]
    out = ranked.where((F.col("rank") <= k) & F.col("name").isin(proved)).select("name", "rank", "value", F.col("cnt").alias("count"))
    if rest:
        full = value_frequencies(df.select(*[F.col(quote(c)) for c in rest]), table).where(F.col("value").isNotNull())
        out = out.unionByName(full.withColumn("rank", place).where(F.col("rank") <= k).select("name", "rank", "value", F.col("cnt").alias("count")))
    out = stage(out, "heavyhitters")   # k rows per column
    drop_staged(held, counted)
    return out.select(F.lit(table).alias("table"), "name", "rank", "value", "count"), rest
