"""A stated set of query rows against all rows of a vector table, in blocks of bounded size.

Queries and rows are dealt into blocks by a hash of their number; every (query block, row block) is one cell and
one call of a function on two Arrow tables.  Nothing is broadcast, and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

#: Rows of a block, about; a cell of these sizes and 64 dimensions holds 4 and 16 MB.
QUERY_BLOCK, ROW_BLOCK = 8_192, 32_768
#: Queries whose scores against a row block are held at once.
STEP = 128


def numbered(df: DataFrame, id_col: str, vector_col: str, scale: float, **extra: Column) -> DataFrame:
    """``row, id, vector, *extra``, staged: the rows that take part, each with a number of its own.

    Left out are rows without an id (no answer could name them), without a vector, or with a component that is null
    or not finite, also when multiplied by ``scale``.  Repeated rows are rows of their own.
    """
    kind = df.schema[vector_col].dataType.simpleString()
    wide = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    x = df.select(F.col(id_col).cast("long").alias("id"), wide.alias("vector"), *(c.alias(n) for n, c in extra.items()))
    x = x.where(F.col("id").isNotNull() & F.col("vector").isNotNull()
                & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double") * scale) == float("inf"))))
    return stage(x.withColumn("row", F.monotonically_increasing_id()), "numbered")


def meet(queries: DataFrame, rows: DataFrame, cell: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
         query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """``cell(queries, rows)`` for every pair of a query block and a row block; both frames have a column ``row``."""
    n_q, n_r = (max(1, -(-df.count() // size)) for df, size in ((queries, query_block), (rows, row_block)))

    def dealt(df: DataFrame, mine: str, n_mine: int, other: str, n_other: int) -> DataFrame:
        return (df.withColumn(mine, F.pmod(F.xxhash64("row"), F.lit(n_mine)))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))))

    q = dealt(queries, "q_block", n_q, "r_block", n_r).withColumn("r_block", F.col("r_block").cast("long"))
    r = dealt(rows, "r_block", n_r, "q_block", n_q).withColumn("q_block", F.col("q_block").cast("long"))
    out = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in _fields(schema)])

    def call(a: pa.Table, b: pa.Table) -> pa.Table:
        return cell(a, b) if len(a) and len(b) else out.empty_table()

    return q.groupBy("q_block", "r_block").cogroup(r.groupBy("q_block", "r_block")).applyInArrow(call, schema)


def _fields(schema: str) -> list:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64())}[kind]


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def matrix(column: pa.ChunkedArray, scale: float, dim: int) -> np.ndarray:
    """``floor(scale * x)`` of every component, as doubles; a shorter vector stands with zeros behind it."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dim))
    out[np.arange(dim) < size[:, None]] = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    return out


def matrices(a: pa.ChunkedArray, b: pa.ChunkedArray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Both sides as integers of one width, in a number type in which every inner product of them is exact.

    That is double as long as no sum can reach 2^53, else Python's integers.
    """
    dim = max(int(np.diff(c.offsets.to_numpy()).max(initial=0)) for x in (a, b) for c in x.chunks) if len(a) and len(b) else 0
    x, y = matrix(a, scale, dim), matrix(b, scale, dim)
    bound = np.abs(x).sum(axis=1).max(initial=0) * max(1.0, np.abs(y).max(initial=0))
    if bound < 2.0 ** 52:
        return x, y
    whole = np.frompyfunc(int, 1, 1)
    return whole(x), whole(y)


def as_long(score: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; what lies beyond them stands at their ends."""
    if score.dtype != object:
        return score.astype(np.int64)
    return np.array([max(-2**63, min(2**63 - 1, int(s))) for s in score.ravel()], np.int64).reshape(score.shape)


def at_least(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest number of every line of ``scores``; of shorter lines the least."""
    k = min(k, scores.shape[1])
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
