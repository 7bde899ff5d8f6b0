import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tabsight.llm.components import connected_components
from tabsight.llm.queries import op10_simhash_dedup
from tabsight.llm.simhash import hex16, keep_one, near_pairs, simhash_components

SF = "/root/testdata/sf0.01"


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if x]
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_roots(keys, linked):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    keys = sorted(keys)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def check(rows, got):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    root = brute_roots({f for _, f in fps}, lambda a, b: bin(a ^ b).count("1") <= 2)
    least = defaultdict(list)
    for i, f in fps:
        if i is not None:
            least[root[f]].append(i)
    want = [(i, f"{f:016x}", min(least[root[f]], default=None)) for i, f in fps]
    assert sorted(map(repr, want)) == sorted(map(repr, map(tuple, got)))


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check([tuple(r) for r in docs], op10_simhash_dedup(spark, SF).collect())


def test_nulls_ties_repeats_long_texts_and_extra_columns(spark):
    words = [f"w{i}" for i in range(3000)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (4, "One two"), (5, "ONE two"), (None, "one two three"), (6, " ".join(words)),
            (7, " ".join(words[:-1])), (8, "ÀB c d e"), (None, None), (9, "x")]
    df = spark.createDataFrame([(*r, 7, "z", 1) for r in rows], "doc_id long, text string, fp int, id string, n int")
    out = simhash_components(df)
    check(rows, out.select("doc_id", hex16(F.col("fingerprint")).alias("f"), "component_id").collect())
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert kept.count() == out.select("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("f")).distinct().count()
    assert simhash_components(df.limit(0)).count() == 0 and keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [4, 8])
@pytest.mark.parametrize("cell", [1, 3, 64])
@pytest.mark.parametrize("bits", [1, 2])
def test_links_connect_as_all_pairs_do(spark, blocks, cell, bits):
    rnd = random.Random(blocks * cell)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    for c in list(fps)[:4]:  # crowds
        fps |= {c ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(40)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = brute_roots(signed, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= bits)
    pairs = near_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"), bits, blocks, cell)
    assert all(bin((p.a ^ p.b) & (1 << 64) - 1).count("1") <= bits for p in pairs.collect())
    got = {r.node: r.component for r in connected_components(pairs).collect()}
    assert {k: got.get(k, k) for k in signed} == want


def test_components_of_chains_stars_and_noise(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000), (None, 3), (1399, 1400), (7, 6)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1401)}}
    assert connected_components(spark.createDataFrame([], "x long, y long")).count() == 0
