"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  Bytes are embedded, learned
filters of WIDTH bytes move over a chunk in steps of STRIDE, and the largest response of each filter is
kept.  A linear layer turns those into the chunk's log-odds, and their mean over the text's chunks into
one probability, so a long text is not scored higher for its length alone.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import labelled_sample

EMBED, WIDTH, STRIDE, FILTERS = 8, 8, 4, 24
CHUNK, STEP = 512, 448
MAX_LABELLED, CHUNKS_EACH = 4_000, 3
THRESHOLD = 0.3
PAD = 256


class Network(NamedTuple):
    embed: np.ndarray     # (257, EMBED): the last row is padding
    first: np.ndarray     # (STRIDE * EMBED, FILTERS): the first half of each filter's window
    second: np.ndarray
    bias: np.ndarray
    out: np.ndarray       # (FILTERS,)
    shift: np.ndarray     # (1,)


def chunks(text: str | None) -> np.ndarray:
    """(n, CHUNK) byte values: chunks that overlap by CHUNK - STEP and cover the text; one of padding if it is empty."""
    b = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = 1 + max(0, -(-(len(b) - CHUNK) // STEP))
    padded = np.full((n - 1) * STEP + CHUNK, PAD, np.uint16)
    padded[:len(b)] = b
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (STEP * 2, 2))


def _responses(net: Network, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filters' responses at every position, (n, positions, FILTERS), and the embedded halves of the windows."""
    halves = net.embed[x].reshape(len(x), CHUNK // STRIDE, STRIDE * EMBED)
    return halves[:, :-1] @ net.first + halves[:, 1:] @ net.second, halves


def log_odds(net: Network, x: np.ndarray) -> np.ndarray:
    """One number per chunk, computed in groups of bounded size."""
    out = np.empty(len(x), np.float64)
    for at in range(0, len(x), 128):
        r, _ = _responses(net, x[at:at + 128])
        out[at:at + 128] = np.maximum(r.max(axis=1) + net.bias, 0) @ net.out + net.shift
    return out


def score(net: Network, text: str | None) -> float:
    return float(1 / (1 + np.exp(-np.clip(log_odds(net, chunks(text)).mean(), -30, 30))))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 14, rate: float = 4e-3, seed: int = 5) -> Network:
    """Adam on the log-loss of single chunks; without both labels the network is constant at the share of label 1
    (one half without labels)."""
    rnd = np.random.default_rng(seed)
    net = Network(*[np.asarray(a, np.float32) for a in (
        rnd.normal(0, 0.5, (PAD + 1, EMBED)), rnd.normal(0, 0.12, (STRIDE * EMBED, FILTERS)), rnd.normal(0, 0.12, (STRIDE * EMBED, FILTERS)),
        np.zeros(FILTERS), rnd.normal(0, 0.2, FILTERS), np.zeros(1))])
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return net._replace(out=np.zeros(FILTERS, np.float32), shift=np.array([np.log(p / (1 - p))], np.float32))
    m = [np.zeros_like(a) for a in net]
    v = [np.zeros_like(a) for a in net]
    t = 0
    for epoch in range(epochs):
        order = rnd.permutation(len(y))
        for at in range(0, len(y), 64):
            i = order[at:at + 64]
            r, halves = _responses(net, x[i])
            where = r.argmax(axis=1)                                  # (n, FILTERS): only the largest response learns
            top = np.take_along_axis(r, where[:, None], 1)[:, 0] + net.bias
            pooled = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.shift, -30, 30)))
            d = ((p - y[i]) / len(i)).astype(np.float32)
            dtop = d[:, None] * net.out * (top > 0)
            n = np.arange(len(i))[:, None]
            a, b = halves[n, where], halves[n, where + 1]             # (n, FILTERS, STRIDE * EMBED)
            dembed = np.zeros_like(net.embed)
            for half, weights, shift in ((a, net.first, 0), (b, net.second, 1)):
                back = (dtop[:, :, None] * weights.T).reshape(len(i), FILTERS, STRIDE, EMBED)
                bytes_at = x[i][n[:, :, None], (where + shift)[:, :, None] * STRIDE + np.arange(STRIDE)]
                np.add.at(dembed, bytes_at, back)
            grads = [dembed, np.einsum("nf,nfk->kf", dtop, a), np.einsum("nf,nfk->kf", dtop, b), dtop.sum(0),
                     pooled.T @ d + 1e-4 * net.out, np.array([d.sum()])]
            t += 1
            new = []
            for j, (w, g) in enumerate(zip(net, grads, strict=True)):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                new.append((w - rate * (1 - epoch / epochs) * (m[j] / (1 - 0.9 ** t)) / (np.sqrt(v[j] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32))
            net = Network(*new)
    return net


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text divides by 5; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Network:
    """A network from at most ``max_labelled`` labelled texts that are not held out, the first by the hash of their id.

    From a text come up to ``CHUNKS_EACH`` of its chunks, evenly spread from the first to the last.
    """
    ids = labelled_sample(labels.where(~held_out(F.col("doc_id"))), max_labelled)

    @F.pandas_udf("array<binary>")
    def some(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            c = chunks(t)
            out.append([c[i].tobytes() for i in sorted({round(k * (len(c) - 1) / (CHUNKS_EACH - 1)) for k in range(CHUNKS_EACH)})])
        return pd.Series(out)

    rows = (df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id")
            .select("doc_id", "quality", some("text").alias("c")).orderBy("doc_id", F.xxhash64("c")).limit(2 * max_labelled).collect())
    x = np.array([np.frombuffer(c, np.uint16) for r in rows for c in r["c"]]).reshape(-1, CHUNK)
    y = np.array([float(r["quality"]) for r in rows for _ in r["c"]])
    return train(x, y)


def score_documents(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``id_col, held_out, score, predicted`` of every row, from its whole text alone.

    A null text scores as an empty one.  Ids may be null (then held out) or repeat.  Labels of one id that
    disagree are not learned from.  Other columns are not read; an empty table gives no rows.
    """
    net = df.sparkSession.sparkContext.broadcast(learn(df, labels, id_col, text_col, max_labelled))

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series([score(net.value, t) for t in texts], dtype="float64")

    out = df.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), scores(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
