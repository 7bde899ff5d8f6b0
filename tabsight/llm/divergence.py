"""Source divergence audit: how far the word use of each source is from its language and from the other sources.

Every (lang, source) group and every lang has integer word shares ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))`` over
the V terms that at least ``min_docs`` documents of the lang use; N is the group's number of such words.  Two shares
differ by ``f = floor((p - q)^2 / (p + q))``.

Shares depend on a term only through its counts, so terms are ranked by count cells, not one by one: terms with the
same (group count, lang count) are one cell with a multiplicity, ``f`` is evaluated once per cell, cells of equal
value are merged and ranked by cumulative multiplicity, and only the cells that reach the last rank wanted are
expanded to their terms, in UTF-8 order.  Two sources are compared in the same way: cells of (count here, count
there) over the terms that both use, and for terms that one or neither uses the counts alone say how many there are.

Texts are tokenised and counted in the tasks that read them (whole texts, a batch at a time), so the shuffle carries
counts of (lang, source, term).  A kept term is one row with its count in every source that uses it: no more entries than
there are sources, and comparing all sources of a lang is what the audit is for.  All arithmetic is exact: longs, and decimals for the one product of a count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

#: Bytes that stand between terms: all of ASCII but letters.
BETWEEN = bytes([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: One pass over a text: separators become blanks, A-Z become a-z, all other bytes stay.
FOLD = bytes.maketrans(BETWEEN + bytes(range(0x41, 0x5B)), b" " * len(BETWEEN) + bytes(range(0x61, 0x7B)))
#: Entries that a task holds before it hands them on to the aggregate.
HELD = 400_000
COUNTS = "lang string, source string, term string, n long, docs long"


def terms_of(text: str | None) -> list[bytes]:
    """The terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a text, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of (lang, source, term); a null term stands for the group itself."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            size = len(n) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(lang, pa.string()), size), pa.repeat(pa.scalar(source, pa.string()), size),
                 pa.array([None, *n], pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()),
                 pa.array([0, *map(docs.__getitem__, n)], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found = terms_of(text)
            n.update(found)
            docs.update(set(found))
        if sum(len(n) + 1 for n, _ in held.values()) > HELD:
            yield from out()
    yield from out()


def term_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """``lang, term, whole, uses``: terms of ``min_docs`` documents of their lang, with the occurrences in each source.

    ``uses`` has an entry per source that uses the term.  A row without a term lists the sources of a lang.  One shuffle:
    rows dealt by (lang, term) stay where they are for both sums.
    """
    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    return (texts.mapInArrow(_count, COUNTS).repartition("lang", "term")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
            .groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("docs").alias("used"),
                                         F.collect_list(F.struct("source", "n")).alias("uses"))
            .where(F.col("term").isNull() | (F.col("used") >= min_docs)).select("lang", "term", "whole", "uses"))


def share(count: Column, total: Column, v: Column) -> Column:
    """``1 + floor(10^9 (count + 2) / (total + 2 v))``, exact for any long count."""
    top = (count.cast("decimal(20,0)") + F.lit(2)) * F.lit(1_000_000_000)
    below = total.cast("decimal(20,0)") + v.cast("decimal(20,0)") * F.lit(2)
    return F.lit(1) + F.floor((top - top % below) / below).cast("long")


def differ(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))``; shares are at most 10^9 + 1, so the square fits a long."""
    square = (p - q) * (p - q)
    return F.call_function("div", square, p + q)


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank`` over all ``docs`` (columns lang, source, text; others do not matter).

    Part ``pair``: every other source of the lang, with f summed over all kept terms (0 if there are none).  Part
    ``term``: the ``top`` terms that the group uses and prefers to its lang (p > q), by f, ties in UTF-8 order.
    A null text, lang or source counts as ''.  A group whose texts have no terms takes part with counts of 0; a
    source that is alone in its lang has no pairs; an empty table gives no rows.  Repeated documents count
    as often as they stand there.  Terms may be of any length.
    """
    found = stage(term_counts(docs, min_docs), "termcounts")
    kept = found.where(F.col("term").isNotNull())
    cells = stage(kept.select("lang", "whole", F.inline("uses"))
                  .groupBy("lang", "source", "n", "whole").agg(F.count(F.lit(1)).alias("terms")), "countcells")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("whole").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("total"))
    groups = stage(found.where(F.col("term").isNull()).select("lang", F.inline("uses")).select("lang", "source")
                   .join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
                   .na.fill(0, ["total", "v", "lang_total"]), "sourcegroups")
    return _terms(kept, cells, groups, top).unionByName(_pairs(kept, cells, groups))


def _terms(kept: DataFrame, cells: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    valued = stage(cells.join(groups, ["lang", "source"])
                   .withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
                   .withColumn("q", share(F.col("whole"), F.col("lang_total"), F.col("v")))
                   .where("p > q").withColumn("value", differ(F.col("p"), F.col("q")))
                   .select("lang", "source", "n", "whole", "terms", "value"), "valuedcells")
    of_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # a value has a term at least, so no more than ``top`` values are wanted; then their terms add up
    merged = (valued.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
              .withColumn("r", F.row_number().over(of_group)).where(F.col("r") <= top)
              .withColumn("before", F.sum("terms").over(of_group.rowsBetween(Window.unboundedPreceding, -1)))
              .na.fill(0, ["before"]).where(F.col("before") < top).select("lang", "source", "value", "before"))
    wanted = stage(valued.select("lang", "source", "n", "whole", "value").join(merged, ["lang", "source", "value"]), "wantedcells")
    in_order = Window.partitionBy("lang", "source", "value").orderBy("term")
    return (kept.select("lang", "term", "whole", F.inline("uses")).join(wanted, ["lang", "source", "n", "whole"])
            .withColumn("r", F.row_number().over(in_order)).where(F.col("r") <= top)
            .withColumn("rank", (F.col("before") + F.col("r")).cast("int")).where(F.col("rank") <= top)
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


def _pairs(kept: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    side = ("source", "total", "zero")
    g = groups.withColumn("zero", share(F.lit(0), F.col("total"), F.col("v"))).where("v > 0")
    mine = g.select("lang", "v", *(F.col(c).alias(f"a_{c}") for c in side))
    theirs = g.select("lang", *(F.col(c).alias(f"b_{c}") for c in side))
    nought = differ(F.col("a_zero"), F.col("b_zero"))

    # terms that neither uses differ by f of the two shares of 0; the other cells add what they have beyond that
    base = (groups.select("lang", "source", "v").join(groups.select("lang", F.col("source").alias("item")), "lang")
            .where("source < item").select("lang", "source", "item"))
    rest = mine.join(theirs, "lang").where("a_source < b_source").select(
        "lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), (F.col("v") * nought).alias("x"))

    # terms that one side uses, as if the other did not
    alone = cells.groupBy("lang", "source", "n").agg(F.sum("terms").alias("terms"))
    one = (alone.withColumnRenamed("source", "a_source").join(mine, ["lang", "a_source"]).join(theirs, "lang").where("a_source <> b_source")
           .withColumn("p", share(F.col("n"), F.col("a_total"), F.col("v")))
           .select("lang", F.least("a_source", "b_source").alias("source"), F.greatest("a_source", "b_source").alias("item"),
                   (F.col("terms") * (differ(F.col("p"), F.col("b_zero")) - nought)).alias("x")))

    # terms that both use: in place of the two one-sided values
    both = (kept.select("lang", "uses", F.inline("uses").alias("a_source", "a_n"))
            .select("lang", "a_source", "a_n", F.inline("uses").alias("b_source", "b_n"))
            .where("a_source < b_source").groupBy("lang", "a_source", "b_source", "a_n", "b_n")
            .agg(F.count(F.lit(1)).alias("terms"))
            .join(mine, ["lang", "a_source"]).join(theirs, ["lang", "b_source"])
            .withColumn("p", share(F.col("a_n"), F.col("a_total"), F.col("v")))
            .withColumn("q", share(F.col("b_n"), F.col("b_total"), F.col("v")))
            .select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"),
                    (F.col("terms") * (differ(F.col("p"), F.col("q")) - differ(F.col("p"), F.col("b_zero"))
                                       - differ(F.col("a_zero"), F.col("q")) + nought)).alias("x")))

    found = rest.unionByName(one).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("x").alias("value"))
    half = stage(base.join(found, ["lang", "source", "item"], "left").na.fill(0, ["value"]), "sourcepairs")
    each = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return each.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS whole FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.whole, count(t.doc) AS n FROM g JOIN k USING (lang)
      LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(whole) AS lang_total FROM k GROUP BY lang),
s AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p,
        1 + (1000000000::HUGEINT * (whole + 2)) // (lang_total + 2 * v) AS q FROM c JOIN l USING (lang)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
           coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN s x ON x.lang = a.lang AND x.source = a.source
         LEFT JOIN s y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
u AS (SELECT * FROM pair UNION ALL
      SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
  (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM u QUALIFY part = 'pair' OR rank <= 10
"""
