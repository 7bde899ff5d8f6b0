import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabsight.llm.queries import op2_sharding
from tabsight.llm.sharding import minimax_cuts, shard

SF = "/root/testdata/sf0.01"


def least_capacity(sizes, shards):
    """Brute force over the ordered group sizes."""
    def fits(cap):
        used, room = 1, cap
        for s in sizes:
            if s > cap:
                return False
            if s > room:
                used, room = used + 1, cap
            room -= s
        return used <= shards
    lo, hi = 1, sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("case", ["even", "hot", "few", "close"])
def test_capacity_is_the_least(spark, case):
    rnd = random.Random(case)
    keys = {"even": [rnd.getrandbits(64) - (1 << 63) for _ in range(3000)], "hot": [rnd.getrandbits(64) - (1 << 63) for _ in range(500)],
            "few": [-5, 0, 7], "close": list(range(2000))}[case]
    rows = [(k, rnd.randint(1, 900)) for k in keys for _ in range(rnd.randint(1, 3))]
    if case == "hot":
        rows += [(keys[100], 5000)] * 60
    cap, cuts, n = minimax_cuts(spark.createDataFrame(rows, "gkey long, size long"), 8)
    groups = defaultdict(int)
    for k, s in rows:
        groups[k] += s
    assert n == len(rows) and cap == least_capacity([groups[k] for k in sorted(groups)], 8)
    load = defaultdict(int)
    for k, s in rows:
        load[sum(k >= c for c in cuts)] += s
    assert max(load.values()) == cap or max(load.values()) <= cap
    if case in ("even", "hot", "close"):
        assert len(load) == 8


def check(rows, out):
    assert len(out) == len(rows)
    size = defaultdict(list)
    for i, t in rows:
        size[i].append((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    for r in out:
        assert (r["size"], r["text_crc32"]) in size[r["doc_id"]]
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
        assert 0 <= s < 8


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = op2_sharding(spark, SF).collect()
    check(rows, out)
    text = dict(rows)
    place = defaultdict(set)
    for r in out:
        place[text[r["doc_id"]]].add(r["shard"])
    assert all(len(x) == 1 for x in place.values())
    load = [sum(r["size"] for r in out if r["shard"] == s) for s in range(8)]
    assert max(load) - min(load) < 0.03 * max(load)


def test_nulls_repeats_empty_table_and_extra_columns(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "x"), (3, "é" * 5000), (4, None), (5, "x"), (6, "y"), (6, "z")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, size int, shard int, slot int, gkey int")
    out = shard(df)
    check(rows, out.collect())
    by = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in out.collect()}
    assert by[None, zlib.crc32(b"x")] == by[5, zlib.crc32(b"x")]
    assert out.where("size = 1").select("shard").distinct().count() <= 2   # null texts together, empty texts together
    assert shard(df.limit(0)).count() == 0
    assert shard(df, shards=1).select(F.max("shard")).first()[0] == 0
