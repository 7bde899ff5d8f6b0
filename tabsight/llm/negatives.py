"""Hard negatives by a vertical scan of the vector columns (branch and bound over decomposed data).

Per block of rows the vectors are held by dimension.  An anchor reads the columns in falling order of its own
components' magnitude and adds each column's contribution to the sums of the rows that are still candidates.  What the
columns not yet read can still add lies between the sums of their least and greatest contributions (the column's
minimum and maximum times the anchor's component), so every sum has a lower and an upper end, and after every few
columns the candidate bitmap loses the rows that cannot matter any more:

* searching positives, rows whose upper end is below the n-th largest lower end;
* searching negatives, rows whose ends fit none of the anchor's windows, or, per window, lie below the n-th largest
  lower end of the rows that are surely inside.

When all columns are read the sums of the rows left are exact and the windows are filled from them.  Blocks report the
first rows they have for each positive, and the first of those reports are the answer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .blocks import as_long, matrices, meet, numbered, numbers

#: Columns read between two cuts of the bitmap.
COLUMNS = 8

Cut = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class Columns:
    """Vectors by dimension, with the least and greatest component of every dimension."""

    def __init__(self, x: np.ndarray):
        self.by_dim = np.ascontiguousarray(x.T)
        self.least, self.greatest = x.min(axis=0), x.max(axis=0)

    def scan(self, anchor: np.ndarray, candidates: np.ndarray, cut: Cut) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact scores of the candidates that ``cut(at, lower, upper)`` never took out."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * self.least, anchor * self.greatest])[:, order]
        # what the columns from the n-th of the order on can still add
        rest = [np.concatenate([np.cumsum(e[::-1])[::-1], [0]]) for e in (ends.min(axis=0), ends.max(axis=0))] if len(order) else [[0], [0]]
        at = np.flatnonzero(candidates)
        score = np.zeros(len(at), anchor.dtype)
        for n in range(0, len(order), COLUMNS):
            read = order[n:n + COLUMNS]
            for d in read:
                score = score + anchor[d] * self.by_dim[d][at]
            left = cut(at, score + rest[0][n + len(read)], score + rest[1][n + len(read)])
            at, score = at[left], score[left]
            if not len(at):
                break
        return at, score


def nth_largest(x: np.ndarray, n: int):
    """The n-th largest number, or None if there are fewer."""
    return np.partition(x, len(x) - n)[len(x) - n] if len(x) >= n else None


def best(n: int) -> Cut:
    """Keeps what may be among the ``n`` highest."""
    def cut(_at: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        floor = nth_largest(lower, n)
        return np.ones(len(lower), bool) if floor is None else upper >= floor
    return cut


def inside(score: np.ndarray, positive: int, low: int) -> np.ndarray:
    """``low * positive <= 100 * score <= 100 * positive``"""
    return (100 * score >= low * positive) & (score <= positive)


def windows(positives: list[int], low: int, n: int) -> Cut:
    """Keeps what may be among the ``n`` highest of the window below one of ``positives``."""
    def cut(_at: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        left = np.zeros(len(lower), bool)
        for p in positives:
            may = (100 * upper >= low * p) & (lower <= p)
            floor = nth_largest(lower[(100 * lower >= low * p) & (upper <= p)], n)
            left |= may if floor is None else may & (upper >= floor)
        return left
    return cut


def ordered(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Positions of the first n: by falling score, then by id."""
    return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i])) if score.dtype == object
                    else np.lexsort((ids, -score)), np.int64)[:n]


def hard_negatives(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: str | Column = "label",
                   every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, scale: float = 256.0,
                   **blocks: int) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``; scores are integer inner products of ``floor(scale * x)``.
    An anchor's positives are its first ``positives`` other rows of the same label (higher scores first, ties by
    smaller id), and for each the first ``negatives`` rows of another label are returned whose score lies between ``low``
    percent of the positive's and the positive's own.  A window without rows gives none, and so does a positive of
    negative score, whose window is empty.

    Rows with a null id, label or vector, or with a null or non-finite component take no part.  A shorter vector counts
    as if zeros followed.  Repeated ids and rows are anchors, positives and negatives each.  An empty table, or
    one of a single label, gives no rows.
    """
    rows = numbered(df, id_col, vector_col, scale, label=F.col(label) if isinstance(label, str) else label)
    rows = rows.where(F.col("label").isNotNull())
    anchors = rows.where(F.col("id") % every == 0).select("row", "label", "vector")
    if dict(rows.dtypes)["label"] != "bigint":   # labels are compared in the cells, as numbers
        raise ValueError("label has to be a long")

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        anchor, x = matrices(a.column("vector"), b.column("vector"), scale)
        columns, labels, ids, names = Columns(x), numbers(b, "label"), numbers(b, "id"), numbers(b, "row")
        out = []
        for row, lab, v in zip(numbers(a, "row"), numbers(a, "label"), anchor, strict=True):
            at, score = columns.scan(v, (labels == lab) & (names != row), best(positives))
            first = ordered(score, ids[at], positives)
            out.append((np.full(len(first), row), ids[at[first]], as_long(score[first])))
        row, found, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"row": row, "id": found, "score": score})

    def apart(a: pa.Table, b: pa.Table) -> pa.Table:
        anchor, x = matrices(a.column("vector"), b.column("vector"), scale)
        columns, labels, ids = Columns(x), numbers(b, "label"), numbers(b, "id")
        out = []
        for row, lab, v, wanted in zip(numbers(a, "row"), numbers(a, "label"), anchor, a.column("wanted").to_pylist(), strict=True):
            at, score = columns.scan(v, labels != lab, windows(wanted, low, negatives))
            for p in wanted:
                here = np.flatnonzero(inside(score, p, low))
                first = here[ordered(score[here], ids[at[here]], negatives)]
                out.append((np.full(len(first), row), np.full(len(first), p), ids[at[first]], as_long(score[first])))
        row, p, found, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"row": row, "positive_score": p, "negative_id": found, "negative_score": score})

    nth = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id"))
    chosen = stage(meet(anchors, rows.select("row", "id", "label", "vector"), near, "row bigint, id bigint, score bigint", **blocks)
                   .withColumn("nth", nth).where(F.col("nth") <= positives), "positives")
    # one window per anchor and score: positives of equal score share it
    wanted = chosen.where("score >= 0").groupBy("row").agg(F.sort_array(F.collect_set("score")).alias("wanted"))
    asked = stage(anchors.join(wanted, "row"), "windows")
    found = meet(asked, rows.select("row", "id", "label", "vector"), apart,
                 "row bigint, positive_score bigint, negative_id bigint, negative_score bigint", **blocks)
    rank = F.row_number().over(Window.partitionBy("row", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    first = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return (first.join(chosen.select("row", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "nth"),
                       ["row", "positive_score"])
            .join(rows.select("row", F.col("id").alias("anchor_id")), "row")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
                    "negative_score"))


def shifted_label(id_col: str = "vec_id", label_col: str = "label") -> Column:
    """The label, and where the id is divisible by 7, (label + 1) % 10."""
    label = F.col(label_col).cast("long")
    return F.when(F.col(id_col) % 7 == 0, (label + 1) % 10).otherwise(label)


NEGATIVES_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
        coalesce(list_sum(list_transform(list_zip(a.e, c.e), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0)::BIGINT AS score
      FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS nth FROM s WHERE same QUALIFY nth <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.ar, p.nth ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
