"""Approximate nearest neighbours: a forest of random-projection trees.

Every tree has one random direction per level; a node sends a vector left or right of the median of the
sample vectors in it.  Where a node has too few sample vectors for a median, it divides at the mean of
the last ones it had, so trees go as deep as the number of vectors asks, whatever the sample.  Trees are
fitted on a bounded sample and every vector is put into one leaf of each tree.

A query searches all trees through one priority queue, in which a branch stands with the sum of the margins
by which the query lies on the other side of the splits above it: the leaves nearest to the query come first,
whichever tree they are in.  Queries meet the vectors of their leaves leaf by leaf, inner products are
computed exactly on the original vectors, and the best of all leaves are kept.

How many leaves a query opens is calibrated: sample queries are answered by brute force within the sample,
and the share of leaves is taken that finds ``RECALL`` of those answers.  In clustered vectors that is a few
leaves; vectors without any structure need most of them, and no index can help it.

A leaf reports the best of its vectors for a query: always those of the query's own leaf in each tree, and of
other leaves what reaches the query's floor, a score that some ``FLOOR`` times k vectors of the sample reach.  So the
number of reports follows the number of answers, not that of the leaves.

Equal vectors are one class: a class is indexed and searched once, with the least of its ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

SAMPLE = 20_000
TREES = 4
LEAF = 1024
MEDIAN_OF = 8
RECALL = 0.96
CALIBRATED_ON = 200
FLOOR = 4


class Forest:
    """Directions (dim, trees * depth) and thresholds: per tree and level one number for each node."""

    def __init__(self, sample: np.ndarray, rows: int, dim: int, trees: int = TREES, leaf: int = LEAF, seed: int = 11):
        rnd = np.random.default_rng(seed)
        self.trees, self.depth = trees, max(0, int(np.ceil(np.log2(max(1, rows) / leaf))))
        # levels beyond what the sample can tell keep the thresholds of their last ancestor: one table of
        # FIT levels is enough, and the driver holds no more nodes than sample vectors
        self.fit = min(self.depth, max(0, int(np.ceil(np.log2(max(1, len(sample)) / MEDIAN_OF)))))
        # the directions of a tree are orthogonal, as far as there are dimensions
        blocks = [np.linalg.qr(rnd.standard_normal((dim, min(dim, self.depth - at))))[0]
                  for _ in range(trees) for at in range(0, self.depth, dim)]
        self.directions = np.hstack(blocks) if blocks else np.zeros((dim, 0))
        proj = sample @ self.directions
        self.thresholds = [[np.zeros(1 << min(level, self.fit)) for level in range(self.depth)] for _ in range(trees)]
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for level in range(self.depth):
                p, table = proj[:, t * self.depth + level], self.thresholds[t][level]
                order = np.lexsort((p, node))
                nodes, first, count = np.unique(node[order], return_index=True, return_counts=True)
                lo, hi = p[order][first + (count - 1) // 2], p[order][first + count // 2]
                table[nodes] = (lo + hi) / 2
                if level < self.fit:
                    node = 2 * node + (p > table[node])

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.directions

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree: (rows, trees)."""
        proj, out = self.project(x), np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            for level in range(self.depth):
                at = out[:, t] >> max(0, level - self.fit)
                out[:, t] = 2 * out[:, t] + (proj[:, t * self.depth + level] > self.thresholds[t][level][at])
        return out

    def search(self, proj: np.ndarray, probes: int) -> list[tuple[int, int]]:
        """The ``probes`` leaves nearest to a query by its projections: (tree, leaf) in order of margin."""
        queue = [(0.0, t, 0, 0) for t in range(self.trees)]
        found: list[tuple[int, int]] = []
        rows = [proj[t * self.depth:(t + 1) * self.depth].tolist() for t in range(self.trees)]
        while queue and len(found) < probes:
            margin, t, level, node = heapq.heappop(queue)
            while level < self.depth:
                away = rows[t][level] - self.thresholds[t][level][node >> max(0, level - self.fit)]
                right = away > 0
                heapq.heappush(queue, (margin + abs(away), t, level + 1, 2 * node + (not right)))
                level, node = level + 1, 2 * node + right
            found.append((t, node))
        return found


def calibrated(forest: Forest, sample: np.ndarray, k: int, recall: float = RECALL) -> int:
    """Leaves to open for ``recall`` of the ``k`` nearest, as measured on queries and answers from the sample."""
    every = forest.trees << forest.depth
    asked = sample[:CALIBRATED_ON]
    if len(sample) <= k + 1 or not forest.depth:
        return every
    scores = asked @ sample.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    at, proj, ranks = forest.leaves(sample), forest.project(asked), []
    for i in range(len(asked)):
        place = {x: r for r, x in enumerate(forest.search(proj[i], every))}
        ranks += [min(place[t, v] for t, v in enumerate(at[j])) for j in true[i].tolist()]
    return int(np.quantile(ranks, recall)) + 1


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.empty((0, 1))


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector``: rows without null, non-finite or all-zero vectors, of the most common length; equal rows once."""
    x = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(
        F.col("vector").isNotNull() & F.col("id").isNotNull()
        & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        & F.exists("vector", lambda v: v != 0))
    size = x.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    return x.where(F.size("vector") == F.lit(size["n"] if size else 0)).distinct()


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20,
            trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, id_col, score``: the ``k`` largest inner products found for each id divisible by ``every``.

    Candidates are all rows but the query's own; ties go to the smaller id.  Vectors that are null, zero,
    or hold null or non-finite components, and those of another length than most, take no part; a table
    without queries or with one vector gives no rows.  An id with several vectors is as many candidates
    and queries.  A table of up to ``leaf`` vectors is one leaf, so all its candidates are seen.
    """
    spark = df.sparkSession
    rows = valid(df, id_col, vector_col).withColumn("class", F.xxhash64("vector"))
    # the k + 1 least ids of a class are all that any answer can hold
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("class", "vector").orderBy("id")))
    least = stage(placed.where(F.col("place") <= k + 1), "leastids")
    classes = stage(least.where("place = 1").select("class", "id", "vector"), "classes")
    asked = stage(rows.where(F.col("id") % every == 0).select("id", "class", "vector"), "asked")
    n = classes.count()
    picked = classes.orderBy(F.xxhash64("class"), "class").limit(sample).select("vector").collect()
    if not picked:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    vectors = np.array([r["vector"] for r in picked], np.float64)
    grown = Forest(vectors, n, vectors.shape[1], trees, leaf)
    probes = calibrated(grown, vectors, k, recall)
    forest = spark.sparkContext.broadcast(grown)
    held = spark.sparkContext.broadcast(vectors)   # at most ``sample`` vectors

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                at = forest.value.leaves(_matrix(b["vector"]))
                m = at.shape[1]
                yield pd.DataFrame({"tree": np.tile(np.arange(m, dtype=np.int32), len(b)), "leaf": at.ravel(),
                                    "class": np.repeat(b["class"].to_numpy(), m), "least": b["id"].repeat(m).to_numpy(), "vector": b["vector"].repeat(m).to_numpy()})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 128):
                part = b.iloc[at:at + 128]
                x, n = _matrix(part["vector"]), FLOOR * (k + 2)
                floors = np.full(len(x), -np.inf)
                if len(held.value) > n:
                    floors = -np.partition(-(x @ held.value.T), n, axis=1)[:, n] - 1e-9
                found = [(t, v, c, q, -np.inf if i < trees else low)   # the first leaves are the query's own
                         for c, q, p, low in zip(part["class"], part["vector"], forest.value.project(x), floors, strict=True)
                         for i, (t, v) in enumerate(forest.value.search(p, probes))]
                yield pd.DataFrame(found, columns=["tree", "leaf", "class", "vector", "floor"])

    where = "tree int, leaf long, class long, vector array<double>"
    wide = F.col("vector").cast("array<double>").alias("vector")
    least_id = classes.schema["id"].dataType.simpleString()
    indexed = classes.select("class", "id", wide).mapInPandas(put, f"tree int, leaf long, class long, least {least_id}, vector array<double>")
    # a number of tasks of its own: the rows are few and short, the search of each is not
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    queries = asked.select("class", "vector").repartition(tasks, "class").distinct().select("class", wide).mapInPandas(ask, f"{where}, floor double")

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query": [], "class": [], "least": [], "score": []})
        xs, ids, least, out = _matrix(x["vector"]), x["class"].to_numpy(), x["least"].to_numpy(), []
        place = np.empty(len(ids), np.int64)   # by least id
        place[np.lexsort((ids, np.unique(least, return_inverse=True)[1]))] = np.arange(len(ids))
        keep = min(len(xs), k + 1)
        for at in range(0, len(q), 512):
            part = q.iloc[at:at + 512]
            qs, floors, asks = _matrix(part["vector"]), part["floor"].to_numpy(), part["class"].to_numpy()
            rough = qs @ xs.T
            edge = -np.partition(-rough, keep - 1, axis=1)[:, keep - 1]
            row, col = np.nonzero(rough >= np.maximum(edge - 1e-9 * np.maximum(1, np.abs(edge)), floors - 1e-9)[:, None])   # all that tie at the edge
            exact = np.concatenate([np.empty(0), *[(qs[row[i:i + 65536]] * xs[col[i:i + 65536]]).sum(axis=1) for i in range(0, len(row), 65536)]])
            order = np.lexsort((place[col], -exact, row))
            row, col, exact = row[order], col[order], exact[order]
            seen = (np.arange(len(row)) - np.searchsorted(row, row) < keep) & (exact >= floors[row])
            out.append(pd.DataFrame({"query": asks[row[seen]], "class": ids[col[seen]], "least": least[col[seen]], "score": exact[seen]}))
        return pd.concat(out)

    met = (queries.groupBy("tree", "leaf").cogroup(indexed.groupBy("tree", "leaf"))
           .applyInPandas(meet, f"query long, class long, least {least_id}, score double"))
    best = (met.groupBy("query", "class").agg(F.max("score").alias("score"), F.min("least").alias("least"))
            .withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least", "class"))).where(F.col("r") <= k + 1))
    # a class, so far placed by its least id, stands for its k + 1 least ones
    named = best.join(least.select("class", F.col("id").alias("found")), "class").select("query", "found", "score")
    per_class = named.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "found"))).where(F.col("r") <= k + 1)
    answers = asked.select(F.col("id").alias("query_id"), F.col("class").alias("query")).join(per_class, "query").where("found <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "found"))
    return (answers.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias(id_col), "score"))
