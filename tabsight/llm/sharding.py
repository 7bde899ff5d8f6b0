"""Sharding by minimax contiguous partition [native].

Equal texts form an atomic group; groups are ordered by the 64-bit hash of their text.  The
smallest shard capacity that a greedy left-to-right filling can meet is found by binary search,
and the ordered groups are cut there.

The search needs prefix sums of the group sizes, of which there may be billions.  It works on
*segments* of the key order instead: one aggregate gives the size of 2^10 key ranges, the search
runs once as if every segment could be cut anywhere (a lower bound of the capacity) and once as
if none could (an upper bound), and only the segments in which a cut can still fall are split
further, by the next ten key bits, until both bounds meet.  The driver holds at most some
``shards^2 * 2^10`` segment sizes, whatever the input, and the result is the exact minimum.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

BITS = 10
SLOT_BLOCK = 20_000


class Segment(NamedTuple):
    first: int   # smallest and largest group key in it
    last: int
    size: int
    rows: int
    bits: int    # its key prefix: the first ``bits`` bits
    prefix: int

    @property
    def atomic(self) -> bool:
        return self.first == self.last


def _segments(keyed: DataFrame, bits: int, parents: list[int] | None = None, parent_bits: int = 0) -> list[Segment]:
    if parents is not None:
        keyed = keyed.where(F.shiftright("gkey", 64 - parent_bits).isin(parents))
    prefix = F.shiftright("gkey", 64 - bits) if bits < 64 else F.col("gkey")
    rows = (keyed.groupBy(prefix.alias("prefix"))
            .agg(F.min("gkey").alias("first"), F.max("gkey").alias("last"), F.sum("size").alias("size"),
                 F.count(F.lit(1)).alias("n")).collect())
    return [Segment(r["first"], r["last"], r["size"], r["n"], bits, r["prefix"]) for r in rows]


def _prefix_sums(segs: list[Segment]) -> list[int]:
    p = [0]
    for s in segs:
        p.append(p[-1] + s.size)
    return p


def _whole_cuts(p: list[int], cap: int, shards: int) -> list[int]:
    """Positions that a greedy filling reaches when no segment is divided."""
    at, out = 0, []
    for _ in range(shards):
        at = p[bisect_right(p, at + cap) - 1]
        out.append(at)
    return out


def _free_cuts(p: list[int], segs: list[Segment], cap: int, shards: int) -> list[int]:
    """The same when every segment of several groups may be divided anywhere."""
    at, out = 0, []
    for _ in range(shards):
        at = min(at + cap, p[-1])
        i = bisect_right(p, at) - 1
        if i < len(segs) and segs[i].atomic:
            at = p[i]
        out.append(at)
    return out


def _least(feasible, lo: int, hi: int) -> int:
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if feasible(mid) else (mid + 1, hi)
    return lo


def minimax_cuts(keyed: DataFrame, shards: int) -> tuple[int, list[int], int]:
    """The smallest capacity, the keys at which a shard begins (all but the first), and the row count.

    ``keyed`` has ``gkey`` long and ``size`` long > 0, one row per document.  Within the capacity
    each cut is the feasible one nearest to an equal share of what is left, so that one group
    larger than a fair share does not leave other shards empty.
    """
    segs = sorted(_segments(keyed, BITS))
    if not segs:
        return 0, [], 0
    while True:
        p = _prefix_sums(segs)
        total = p[-1]
        least = max([-(-total // shards), *(s.size for s in segs if s.atomic)])
        lo = _least(lambda c: _free_cuts(p, segs, c, shards)[-1] >= total, least, total)
        cap = _least(lambda c: _whole_cuts(p, c, shards)[-1] >= total, lo, total)
        if lo == cap:
            break
        split: set[int] = set()
        for a, b in zip(_whole_cuts(p, lo, shards), _free_cuts(p, segs, cap, shards), strict=True):
            split.update(i for i in range(max(0, bisect_right(p, a) - 1), bisect_left(p, b)) if not segs[i].atomic)
        keep = [s for i, s in enumerate(segs) if i not in split]
        for bits in sorted({segs[i].bits for i in split}):
            keep += _segments(keyed, min(64, bits + BITS), [segs[i].prefix for i in split if segs[i].bits == bits], bits)
        segs = sorted(keep)
    # the earliest start of each shard from which the rest still fits
    starts = [len(segs)]
    for _ in range(shards):
        starts.append(bisect_left(p, p[starts[-1]] - cap))
    cuts, at = [], 0
    for j in range(shards - 1):
        later = shards - 1 - j   # each shard takes a segment while there are enough
        lo_i = max(min(at + 1, len(segs)), starts[later])
        hi_i = max(lo_i, min(bisect_right(p, p[at] + cap) - 1, len(segs) - later))
        share = p[at] + (total - p[at]) / (shards - j)
        i = bisect_left(p, share)
        at = min((x for x in {min(max(y, lo_i), hi_i) for y in (i - 1, i)}), key=lambda x: abs(p[x] - share))
        if at < len(segs):
            cuts.append(segs[at].first)
    return cap, cuts, sum(s.rows for s in segs)


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """One row per input row: ``id_col, size, text_crc32, group_key, shard, slot``.

    ``size`` is the UTF-8 bytes of the text plus 1 (a null text: 1, with crc 0).  Rows of equal
    text (all nulls are equal) share a shard; two texts with the same 64-bit key, should they
    occur, share one too.  Slots count from 0 in each shard without gaps; repeated rows get a slot
    each.  An empty table gives an empty result; fewer groups than shards leave shards empty.
    Other input columns are not read.
    """
    t = F.col(text_col)
    keyed = stage(df.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(t), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(t).alias("gkey")), "shardkeys")
    _, cuts, rows = minimax_cuts(keyed, shards)
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("gkey") >= F.lit(c)).cast("int")
    # slots: rows are dealt by hash into blocks of about SLOT_BLOCK rows, counted, and numbered from the block's offset
    blocks = max(1, -(-rows // (SLOT_BLOCK * shards)))
    dealt = (keyed.withColumn("shard", number)
             .withColumn("block", F.pmod(F.xxhash64("gkey", "id"), F.lit(blocks)).cast("int")))
    offsets = (dealt.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
               .select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before")))
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("gkey", "id")) - 1
    return (dealt.withColumn("place", place).join(offsets, ["shard", "block"])
            .select(F.col("id").alias(id_col), "size", "text_crc32", F.col("gkey").alias("group_key"), "shard",
                    (F.col("before") + F.col("place")).cast("long").alias("slot")))
