"""Mixing sources to target weights [native].

The token share of a source is raised to an exponent between 1 (as found) and 0 (all sources
alike).  The exponent is bisected until the entropy of the weights meets a target, or until no
source is repeated more often than a limit.  The weights are then realised under a token budget:
each source is dealt by hash into about sqrt(n) blocks of about sqrt(n) rows, every epoch is a
fresh permutation of its blocks, and blocks are taken until the source's share of the budget is used
up; only the block at that edge is cut between rows.  So the work on a hot source is spread over its
blocks, and no text is sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import words

POINTS, PASSES = 32, 8


def source_tokens(df: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``source, rows, tokens``: a row counts its words and an end token."""
    return (df.select(F.col(source_col).alias("source"), (F.size(words(F.col(text_col))) + 1).cast("long").alias("tokens"))
            .groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("tokens")))


def _at(sources: DataFrame, total: int, lo: float, hi: float, points: int) -> list[tuple[float, float]]:
    """For ``points`` + 1 exponents from ``lo`` to ``hi``: the entropy of the weights, and how often the most
    repeated source is used while the least repeated is used once.

    With p the share and z = sum p^a, the entropy is ln z - a * sum(p^a ln p) / z; the repeats of a source are
    in proportion to p^(a-1).
    """
    p, a = F.col("tokens") / F.lit(float(total)), F.col("a")
    power, rate = F.pow(p, a), F.pow(p, a - 1)
    i = F.explode(F.sequence(F.lit(0), F.lit(points))).alias("i")
    rows = (sources.select("tokens", i).withColumn("a", F.lit(lo) + F.lit(hi - lo) * F.col("i") / F.lit(points))
            .groupBy("i", "a").agg(F.sum(power).alias("z"), F.sum(power * F.log(p)).alias("s"), (F.max(rate) / F.min(rate)).alias("r"))
            .orderBy("i").collect())
    return [(math.log(r["z"]) - r["a"] * r["s"] / r["z"], r["r"]) for r in rows]


def _bisect(sources: DataFrame, total: int, reached) -> float:
    """The greatest exponent in [0, 1] at which ``reached`` holds, 0 if none; it holds below one that it holds at.

    Each pass is one aggregate that evaluates all midpoints of the next halvings.
    """
    lo, hi = 0.0, 1.0
    for _ in range(PASSES):
        held = [reached(*x) for x in _at(sources, total, lo, hi, POINTS)]
        if held[-1]:
            return hi
        if not held[0]:
            return lo
        a, b = 0, POINTS
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (mid, b) if held[mid] else (a, mid)
        lo, hi = lo + (hi - lo) * a / POINTS, lo + (hi - lo) * b / POINTS
    return lo


def temperature(sources: DataFrame, entropy_share: float | None = None, max_repeats: float | None = None) -> float:
    """The exponent for ``source, tokens``: the greatest whose entropy is at least ``entropy_share`` of its maximum
    (the logarithm of the number of sources), raised where ``max_repeats`` asks for it.  With a limit alone, the
    least exponent within it; with neither, 1.
    """
    r = sources.agg(F.count(F.lit(1)).alias("k"), F.sum("tokens").alias("n")).first()
    if not r["k"] or entropy_share is None and max_repeats is None:
        return 1.0
    exponent = 0.0
    if entropy_share is not None:
        want = entropy_share * math.log(r["k"]) - 1e-12
        exponent = _bisect(sources, r["n"], lambda entropy, repeats: entropy >= want)
    if max_repeats is not None and _at(sources, r["n"], exponent, exponent, 1)[0][1] > max_repeats:
        # repeats fall as the exponent rises: the least one within the limit is a hair above the greatest beyond it
        over = _bisect(sources, r["n"], lambda entropy, repeats: repeats > max_repeats)
        exponent = min(1.0, over + 1 / POINTS ** PASSES)
    return exponent


def mixture(sources: DataFrame, exponent: float, budget: float | None = None) -> DataFrame:
    """``source, rows, tokens, weight, quota``: weights that sum to one, and the tokens each source gives.

    Without a budget it is the least at which every source is used at least once.
    """
    r = sources.agg(F.sum("tokens").alias("n")).first()
    total = float(r["n"] or 1)
    power = F.pow(F.col("tokens") / total, F.lit(exponent))
    z, least = sources.agg(F.sum(power).alias("z"), F.max(F.col("tokens") / power).alias("least")).first()
    budget = float(budget) if budget is not None else (least or 0.0) * (z or 0.0)
    return sources.select("source", "rows", "tokens", (power / F.lit(z or 1.0)).alias("weight")).withColumn(
        # a quota within rounding of whole epochs is whole
        "quota", F.when(F.abs(F.col("weight") * budget / F.col("tokens") - F.round(F.col("weight") * budget / F.col("tokens"))) < 1e-9,
                        F.round(F.col("weight") * budget / F.col("tokens")) * F.col("tokens")).otherwise(F.col("weight") * budget))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        entropy_share: float | None = 0.95, max_repeats: float | None = 4.0, budget: float | None = None) -> DataFrame:
    """The draws of the mixture: ``row`` (the input row as a struct), ``tokens, weight, epoch, position``.

    A row is drawn once per epoch in which its block is reached; ``position`` in [0, 1) is its place in its
    source's stream, so sorting by it interleaves the sources in proportion.  A null source is a source of
    its own, a null or blank text is one token, repeated rows are drawn separately (they share a block), an
    empty table gives no draws.  Tokens drawn of a source exceed its quota by less than one row.
    """
    sources = stage(source_tokens(df, source_col, text_col), "sources")
    mixed = stage(mixture(sources, temperature(sources, entropy_share, max_repeats), budget), "mixture")
    plan = mixed.select("source", "weight", "quota", F.col("tokens").alias("epoch_tokens"),
                        F.ceil(F.sqrt("rows")).cast("long").alias("blocks"))
    rows = df.select(F.struct("*").alias("row")).select(
        "row", F.col("row")[source_col].alias("source"), F.col("row")[id_col].alias("id"),
        (F.size(words(F.col("row")[text_col])) + 1).cast("long").alias("tokens"))
    key = F.xxhash64("id", "source")

    def with_plan(x: DataFrame, *cols: str) -> DataFrame:
        p = plan.withColumnRenamed("source", "of")
        return x.join(p, x["source"].eqNullSafe(p["of"])).select(*cols, "weight", "quota", "epoch_tokens",
                                                                 F.pmod(key, F.col("blocks")).alias("block"))

    sizes = (with_plan(rows.select("source", "id", "tokens"), "source", "tokens").groupBy("source", "block", "weight", "quota", "epoch_tokens")
             .agg(F.sum("tokens").alias("block_tokens")))
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("quota") / F.col("epoch_tokens")).cast("long") - 1, F.lit(0))))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("epoch", "block"), "block").rowsBetween(Window.unboundedPreceding, 0)
    taken = stage(
        sizes.withColumn("epoch", epochs)
        .withColumn("begin", F.col("epoch") * F.col("epoch_tokens") + F.sum("block_tokens").over(order) - F.col("block_tokens"))
        .where("begin < quota")
        .withColumn("left", F.col("quota") - F.col("begin"))
        .groupBy("source", "block").agg(F.collect_list(F.struct("epoch", "begin", "left", "block_tokens")).alias("draws")), "blocks")
    t = taken.select(F.col("source").alias("of"), F.col("block").alias("b"), "draws")
    dealt = with_plan(rows, "row", "id", "source", "tokens")
    drawn = dealt.join(t, dealt["source"].eqNullSafe(t["of"]) & (dealt["block"] == t["b"])).select(
        "row", "id", "source", "tokens", "weight", "quota", "block", F.explode("draws").alias("d"))
    within = F.pmod(F.xxhash64("d.epoch", "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    place = ((F.col("d.begin") + within * F.least("d.left", F.col("d.block_tokens").cast("double"))) / F.col("quota")).alias("position")
    whole = drawn.where("d.left >= d.block_tokens").select("row", "tokens", "weight", "d.epoch", place)
    before = F.sum("tokens").over(Window.partitionBy("source", "block", "d.epoch").orderBy(F.xxhash64("d.epoch", "id"), "id", "tokens")
                                  .rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    edge = (drawn.where("d.left < d.block_tokens").withColumn("before", before).where("before < d.left")
            .select("row", "tokens", "weight", "d.epoch", place))
    return whole.unionByName(edge)
