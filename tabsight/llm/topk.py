"""Exact top-k inner products by a three-phase uniform threshold.

The dimensions are cut into ``lists`` segments.  Each segment gives a score list: the inner products of a query with
the segment of every row; a row's score is the sum of its entries in all lists.

1. *Gather.*  Every block of rows reports, per query, the sums of the rows that stand among the first k of one of its
   lists.  The k-th largest of the reported sums is the safe cutoff: k rows reach it.
2. *Collect.*  The cutoff goes back to the blocks.  A row whose entries all lie below cutoff / lists stays below the
   cutoff, so only rows with one entry that reaches it are collected, with the sum of the entries that do.
3. *Resolve.*  What a row still lacks is below cutoff / lists per list: a row that cannot reach the cutoff, or the k-th
   of the sums already whole, goes.  The remaining entries of the others are looked up, and the best k are kept.

The cutoffs (one per query) travel with the query blocks; they are not broadcast.  Blocks report at most k rows a
query, so the shuffles after the two passes carry k rows per query and block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .blocks import STEP, as_long, at_least, matrices, meet, numbered, numbers

#: Score lists.  More lists mean a lower threshold for each of them, and more rows to collect.
LISTS = 2


def score_lists(q: np.ndarray, x: np.ndarray, own: np.ndarray, lists: int) -> list[np.ndarray]:
    """Per segment the (queries, rows) inner products; -inf where the row is the query's own."""
    cuts = np.linspace(0, q.shape[1], lists + 1).astype(int)
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = q[:, a:b] @ x[:, a:b].T if b > a else np.zeros((len(q), len(x)), q.dtype)
        part[own] = -np.inf
        out.append(part)
    return out


def blocks_of(a: pa.Table, b: pa.Table, scale: float):
    """Queries in steps against the rows: positions, query and row matrices, and which row is a query's own."""
    qs, xs = matrices(a.column("vector"), b.column("vector"), scale)
    q_row, x_row = numbers(a, "row"), numbers(b, "row")
    for at in range(0, len(qs), STEP):
        here = slice(at, at + STEP)
        yield here, qs[here], xs, q_row[here, None] == x_row[None, :]


def gathered(lists: list[np.ndarray], k: int) -> np.ndarray:
    """Per query the largest k sums of rows that are among the first k of a list; -inf fills up."""
    first = np.logical_or.reduce([s >= at_least(s, k)[:, None] for s in lists])
    sums = np.where(first, sum(lists), -np.inf)
    edge = sums.shape[1] - min(k, sums.shape[1])
    return np.partition(sums, edge, axis=1)[:, edge:]


def resolved(lists: list[np.ndarray], cutoff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query and row positions of the rows that may be among the first k, and their scores."""
    m, cut = len(lists), cutoff[:, None]
    enough = [s * m >= cut for s in lists]
    known = sum(np.where(e, s, 0) for e, s in zip(enough, lists, strict=True))
    lacking = sum((~e).astype(np.int8) for e in enough)
    whole = np.where(lacking == 0, known, -np.inf)
    floor = np.maximum(cutoff, at_least(whole, k) if whole.shape[1] >= k else -np.inf)[:, None]
    with np.errstate(invalid="ignore"):
        alive = (lacking < m) & ((lacking == 0) | (known * m + lacking * cut >= floor * m)) & (known > -np.inf)
    i, j = np.nonzero(alive)
    score = known[i, j] + sum(np.where(e[i, j], 0, s[i, j]) for e, s in zip(enough, lists, strict=True))
    reach = score >= floor[i, 0]
    return i[reach], j[reach], score[reach]


def first_of(i: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k entries of every i: by falling score, then by id."""
    order = np.lexsort((ids, -score, i)) if score.dtype != object else np.array(
        sorted(range(len(i)), key=lambda n: (i[n], -score[n], ids[n])), np.int64)
    at = i[order]
    return order[np.arange(len(order)) - np.searchsorted(at, at) < k] if len(order) else order


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20,
          scale: float = 64.0, lists: int = LISTS, **blocks: int) -> DataFrame:
    """``query_id, rank, id_col, score``: exactly the ``k`` largest integer inner products of each query.

    Components become ``floor(scale * x)``.  Queries are the rows whose id is divisible by ``every``, candidates all rows
    but the query's own; ties go to the smaller id.  Rows with a null id, a null vector, or a null or non-finite
    component take no part; zero and empty vectors do.  A shorter vector counts as if zeros followed.  Repeated ids and
    rows are candidates and queries each.  An empty table, one without queries or with one vector gives no rows.
    """
    rows = numbered(df, id_col, vector_col, scale)
    queries = rows.where(F.col("id") % every == 0).select("row", "vector")

    def gather(a: pa.Table, b: pa.Table) -> pa.Table:
        sums, names = [], numbers(a, "row")
        for _, q, x, own in blocks_of(a, b, scale):
            sums += [as_long(line[line > -np.inf]) for line in gathered(score_lists(q, x, own, lists), k)]
        return pa.table({"row": names, "sums": pa.array(sums, pa.list_(pa.int64()))})

    def collect(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, names, out = numbers(b, "id"), numbers(a, "row"), []
        cut = a.column("cutoff").to_pandas().astype(float).fillna(-np.inf).to_numpy() if a.column("cutoff").null_count \
            else numbers(a, "cutoff").astype(np.float64)
        for here, q, x, own in blocks_of(a, b, scale):
            i, j, score = resolved(score_lists(q, x, own, lists), cut[here], k)
            at = first_of(i, score, ids[j], k)
            out.append((names[here][i[at]], ids[j[at]], as_long(score[at])))
        row, found, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"row": row, "id": found, "score": score})

    best = Window.partitionBy("row").orderBy(F.desc("score"))
    seen = (meet(queries, rows.select("row", "vector"), gather, "row bigint, sums array<bigint>", **blocks)
            .select("row", F.explode("sums").alias("score")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k))
    cutoffs = seen.groupBy("row").agg(F.min("score").alias("cutoff"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    asked = stage(queries.join(cutoffs.select("row", "cutoff"), "row", "left"), "cutoffs")
    found = meet(asked, rows.select("row", "id", "vector"), collect, "row bigint, id bigint, score bigint", **blocks)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .join(rows.select("row", F.col("id").alias("query_id")), "row")
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"))


TOP_K_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.e, c.e),
        lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0)::BIGINT AS score
      FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM n WHERE rank <= 20
"""
