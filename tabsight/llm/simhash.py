"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments.  The Manhattan
distance of two such vectors is a lower bound of the bit distance of the fingerprints, so links lie
among vectors within distance ``max_bits``.  Those are found by a grid range-join: the segments
are dealt into blocks, a distance of at most ``max_bits`` leaves all but ``max_bits`` blocks
without any difference, and each choice of the untouched blocks is a grid whose cells are the
counts there.  Inside a cell the Manhattan bound is tested first and the fingerprints then
decide exactly.

The counts are kept as a thermometer code (0, 1, 2 -> 00, 01, 11) in one long, so the Manhattan
distance of two vectors is the bit count of an exclusive or.

A cell may hold millions of fingerprints that all lie near each other.  Members of cells above
``CELL`` fingerprints are linked through centres instead of pairs: each goes to the 65 points
within one bit of it.  Two fingerprints are within two bits exactly if they meet in a point, at most
65 can meet in one, and those are chained to their least: every link is kept as a path, without pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_staged, stage
from .components import connected_components

CELL = 64
EVEN = 0x5555555555555555
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """SimHash of a text as a signed 64-bit number: XXH64 (seed 42) of its word shingles, majority by bit."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    k = min(shingle_words, len(w))
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:len(w) - k + 1].tolist()
    ends = ends[k - 1:].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:at + CHUNK], ends[at:at + CHUNK], strict=True)], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts)).view(">i8")[0])


def fingerprints(text: Column, shingle_words: int = 3) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle_words) for t in texts], dtype="int64")

    return of(text)


def thermometer(fp: Column) -> Column:
    """The counts of the 32 two-bit segments, each as 00, 01 or 11."""
    up = F.shiftrightunsigned(fp, 1)
    either = fp.bitwiseOR(up).bitwiseAND(F.lit(EVEN))
    both = fp.bitwiseAND(up).bitwiseAND(F.lit(EVEN))
    return either.bitwiseOR(F.shiftleft(both, 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _cells(fps: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """``grid, cell, fp``: each fingerprint in its cell of every grid."""
    width = 64 // blocks
    grids = []
    for g, keep in enumerate(combinations(range(blocks), blocks - max_bits)):
        mask = sum(((1 << width) - 1) << (width * b) for b in keep)
        grids.append(F.struct(F.lit(g).alias("grid"), F.col("t").bitwiseAND(F.lit(_signed(mask))).alias("cell")))
    return (fps.select("fp", thermometer(F.col("fp")).alias("t"))
            .select("fp", F.explode(F.array(*grids)).alias("c")).select("c.grid", "c.cell", "fp"))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_pairs(fps: DataFrame, max_bits: int = 2, blocks: int | None = None, cell: int = CELL) -> DataFrame:
    """Links ``a, b`` that connect exactly the fingerprints (column ``fp``, distinct longs) within ``max_bits`` bits.

    Cells of up to ``cell`` fingerprints give all their links; members of larger ones are linked through
    centres, which for the distances 1 and 2 joins the same fingerprints.  ``blocks`` is 4, or 8 beyond
    2^25 fingerprints: the same links, with more copies of each and fewer chance meetings.
    """
    if max_bits not in (1, 2):
        raise ValueError("max_bits must be 1 or 2")
    if blocks is None:
        blocks = 4 if fps.count() <= 1 << 25 else 8
    cells = _cells(fps, max_bits, blocks)
    counts = cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = stage(cells.join(counts, ["grid", "cell"]), "cells")

    def linked(members):
        return F.flatten(F.transform(members, lambda x: F.transform(F.filter(
            members, lambda y: (y["fp"] > x["fp"]) & (_distance(x["t"], y["t"]) <= max_bits)
            & (_distance(x["fp"], y["fp"]) <= max_bits)),
            lambda y: F.struct(x["fp"].alias("a"), y["fp"].alias("b")))))

    few = (crowded.where(F.col("n") <= cell).groupBy("grid", "cell")
           .agg(F.collect_list(F.struct("fp", thermometer(F.col("fp")).alias("t"))).alias("m"))
           .select(F.explode(linked(F.col("m"))).alias("p")).select("p.a", "p.b"))
    # centres: the points within one bit (for max_bits 1: pairs meet in a point that is one of them)
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)]
    meet = (crowded.where(F.col("n") > cell).select("fp").distinct()
            .select("fp", F.explode(F.array(*flips)).alias("point"))
            .groupBy("point").agg(F.collect_list("fp").alias("m")).where(F.size("m") > 1))
    near = F.filter("m", lambda x: (x != F.array_min("m")) & (_distance(x, F.array_min("m")) <= max_bits))
    many = meet.select(F.array_min("m").alias("a"), F.explode(near).alias("b")) if max_bits == 2 else (
        meet.where(F.array_contains("m", F.col("point")))
        .select(F.col("point").alias("a"), F.explode(F.filter("m", lambda x: x != F.col("point"))).alias("b")))
    return few.unionByName(many).distinct()


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                       max_bits: int = 2, blocks: int | None = None, cell: int = CELL) -> DataFrame:
    """One row per input row: ``id_col, text_key, fingerprint`` (longs) and ``component_id``, the least id reachable.

    Texts are lower-cased in A-Z and cut at ASCII white space; fewer words than a shingle make one shingle, a
    null or blank text has the fingerprint zero and is linked like any other.  Links are between
    fingerprints, so repeated rows and ids need no pairs; null ids are ignored for the least id, which is
    null only if all are.  Other columns are not read; an empty table gives no rows.
    """
    docs = stage(df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"),
                           fingerprints(F.col(text_col), shingle_words).alias("fp")), "fingerprints")
    classes = stage(docs.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    linked = connected_components(near_pairs(classes.select("fp"), max_bits, blocks, cell))
    named = classes.join(linked, classes["fp"] == linked["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(roots, "root").select("fp", "component_id")
    return docs.join(of_class, "fp").select(F.col("id").alias(id_col), "text_key", F.col("fp").alias("fingerprint"), "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``df`` with one row of each component: the one of the least id (then of the least text key).

    All columns stay.  Of rows equal in id and text one stays, the least by its other columns as JSON.
    """
    found = stage(simhash_components(df, id_col, text_col, **how).withColumnRenamed(id_col, "id"), "components")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("f")
    rooted = found.groupBy("component_id").agg(first)
    # components without any id have a null component_id: one row of each of their fingerprint classes stays
    loose = found.where("component_id is null").groupBy("fingerprint").agg(first)
    keepers = (rooted.where("component_id is not null").select("f.id", "f.text_key")
               .unionByName(loose.select("f.id", "f.text_key")).distinct())
    repeated = found.groupBy("id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "text_key")
    keepers = keepers.join(repeated.withColumn("again", F.lit(True)),
                           keepers["id"].eqNullSafe(repeated["id"]) & (keepers["text_key"] == repeated["text_key"]),
                           "left").select(keepers["id"], keepers["text_key"], F.coalesce("again", F.lit(False)).alias("again"))
    rows = df.select(F.struct("*").alias("row")).select(
        "row", F.col("row")[id_col].alias("id"), F.xxhash64(F.col("row")[text_col]).alias("text_key"))
    kept = rows.join(keepers, rows["id"].eqNullSafe(keepers["id"]) & (rows["text_key"] == keepers["text_key"])).select(
        "row", rows["id"], rows["text_key"], "again")
    from pyspark.sql import Window
    nth = F.row_number().over(Window.partitionBy("id", "text_key").orderBy(F.to_json("row")))
    once = kept.where("again").withColumn("nth", nth).where("nth = 1").select("row")
    return kept.where("not again").select("row").unionByName(once).select("row.*")
