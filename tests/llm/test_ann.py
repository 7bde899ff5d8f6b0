import numpy as np
from pyspark.sql import functions as F

from tabsight.llm.ann import Forest, calibrated, nearest
from tabsight.llm.queries import op6_ann_forest

SF = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>, rank int, class long, vector string"


def brute(rows, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for n in np.flatnonzero(ids % 20 == 0):
        s = x @ x[n]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if j != n][:k]
        out[int(ids[n])] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_recall_and_scores_on_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows)
    got = {}
    for r in op6_ann_forest(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    vec = {i: np.array(v, np.float64) for i, v in rows}
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [r for r, *_ in found] == list(range(1, 21))
        assert all(abs(s - vec[q] @ vec[v]) < 1e-9 for _, v, s in found)
        assert [s for *_, s in found] == sorted((s for *_, s in found), reverse=True)
    hit = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 20 * len(want)


def test_forest_goes_beyond_its_sample_and_finds_clusters():
    rnd = np.random.default_rng(0)
    centres = rnd.standard_normal((60, 16)) * 4
    x = centres[rnd.integers(0, 60, 12000)] + rnd.standard_normal((12000, 16)) * 0.3
    f = Forest(x[:500], len(x), 16, trees=4, leaf=64)
    assert f.depth > f.fit and f.leaves(x[:10]).shape == (10, 4)
    at, probes = f.leaves(x), calibrated(f, x[:500], 10)
    assert probes < 0.5 * (4 << f.depth)
    hit = 0
    for q in range(100):
        s = x @ x[q]
        s[q] = -np.inf
        opened = set(f.search(f.project(x[q:q + 1])[0], probes))
        hit += sum(any((t, at[j, t]) in opened for t in range(4)) for j in np.argsort(-s)[:10])
    assert hit >= 900


def test_ties_equal_vectors_and_invalid_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 0.0]) for i in range(100)]
    other = [(200, [0.5, 0.5]), (220, [0.0, 1.0]), (220, [0.0, 1.0]), (240, [0.0, 0.0]), (260, None), (280, [nan, 1.0]), (300, [inf, 1.0]),
             (320, [None, 1.0]), (340, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in same + other], SCHEMA)
    got = {}
    for r in nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got.keys() == {0, 20, 40, 60, 80, 200, 220}
    assert got[0] == list(range(1, 21)) and got[20] == [*range(20)] and got[40] == list(range(20)) and got[200][:3] == [0, 1, 2]
    assert got[220] == [200, *range(19)]
    few = nearest(df.where("vec_id in (20, 200, 220)"))
    assert few.where("query_id = 20").count() == 2
    assert nearest(df.limit(0)).count() == 0 and nearest(df.where("vec_id = 20")).count() == 0
    assert few.select(F.max("rank")).first()[0] == 2


def test_more_ties_than_answers_go_to_the_smaller_ids(spark):
    """Vectors of signs: far more than k + 1 different ones tie in score, in one leaf and over several."""
    rnd = np.random.default_rng(5)
    x = np.unique(rnd.choice([-1.0, 1.0], (400, 10)), axis=0)
    ids = rnd.permutation(len(x))
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], SCHEMA)
    want = {q: [i for i, _ in found] for q, found in brute(rows, 5).items()}
    for leaf in (1024, 64):
        got = {}
        for r in nearest(df, k=5, leaf=leaf, recall=1.0).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert got == want
