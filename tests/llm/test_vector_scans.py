import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.llm.negatives import NEGATIVES_SQL, Columns, best, hard_negatives, windows
from tabsight.llm.queries import op12_hard_negatives, op13_top_k
from tabsight.llm.topk import TOP_K_SQL, gathered, resolved, score_lists, top_k

SF = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>, label int, row string, vector int, rank double"


def table(spark, rows):
    """Vectors with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], SCHEMA)


def sql(query, columns):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    return sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({query})").fetchall())


def valid(rows, scale):
    out = []
    for i, v, label in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            out.append((i, [int(np.floor(scale * float(np.float32(x)))) for x in v], label))
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def brute_top(rows, k=20, every=20):
    x, out = valid(rows, 64), []
    for n, (i, v, _) in enumerate(x):
        if i % every == 0:
            scores = sorted((-dot(v, w), j) for m, (j, w, _) in enumerate(x) if m != n)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return sorted(out)


def brute_negatives(rows, every=100):
    x, out = [r for r in valid(rows, 256) if r[2] is not None], []
    for n, (i, v, label) in enumerate(x):
        if i % every == 0:
            scored = sorted((-dot(v, w), j, lab) for m, (j, w, lab) in enumerate(x) if m != n)
            for s, p, _ in [t for t in scored if t[2] == label][:5]:
                found = [(-t, j) for t, j, lab in scored if lab != label and 80 * -s <= -100 * t <= -100 * s][:5]
                out += [(i, p, r, j, -s, t) for r, (t, j) in enumerate(found, 1)]
    return sorted(out)


def odd_rows(n=400, dim=6, seed=3):
    rnd = np.random.default_rng(seed)
    x = rnd.integers(-2, 3, (n, dim)).astype(float) / 64   # many ties
    rows = [(i, x[i].tolist(), int(i % 4)) for i in range(n)]
    rows += [(500, [0.5] * dim, 1)] * 3 + [(500, [0.25] * dim, 2), (520, [0.5] * dim, 1)]   # repeated rows and ids
    rows += [(600 + i, [0.5] * dim, i % 2) for i in range(60)]                              # copies
    rows += [(None, [1.0] * dim, 1), (700, None, 1), (720, [None, 1.0], 1), (740, [float("nan")] * dim, 1),
             (760, [float("inf")] * dim, 1), (800, [0.0] * dim, None), (900, [0.5, 0.5], 3), (1000, [], 0)]
    return rows


def test_top_k_equals_sql(spark):
    columns = ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in op13_top_k(spark, SF).select(*columns).collect()) == sql(TOP_K_SQL, columns)


def test_hard_negatives_equal_sql(spark):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(tuple(r) for r in op12_hard_negatives(spark, SF).select(*columns).collect())
    assert got == sql(NEGATIVES_SQL, columns) and got


@pytest.mark.parametrize("blocks", [{}, {"query_block": 5, "row_block": 40}])
@pytest.mark.parametrize("lists", [1, 2, 5, 9])
def test_top_k_with_ties_repeats_and_broken_rows(spark, blocks, lists):
    rows = odd_rows()
    got = top_k(table(spark, rows), lists=lists, **blocks).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows)


@pytest.mark.parametrize("blocks", [{}, {"query_block": 2, "row_block": 40}])
def test_negatives_with_ties_repeats_and_broken_rows(spark, blocks):
    rows = odd_rows()
    df = table(spark, rows)
    got = hard_negatives(df, label=F.col("label").cast("long"), every=20, **blocks).collect()
    want = brute_negatives(rows, every=20)
    assert sorted(tuple(r) for r in got) == want and want


def test_few_rows_and_empty_tables(spark):
    for rows in ([], [(20, [1.0], 1)], [(3, [1.0], 1), (4, [1.0], 2)], [(0, [1.0], 1), (40, [-1.0], 2)]):
        df = table(spark, rows)
        assert sorted(tuple(r) for r in top_k(df).collect()) == brute_top(rows)
        assert hard_negatives(df, label=F.col("label").cast("long")).collect() == []


def test_numbers_beyond_a_double_are_exact(spark):
    big = float(2 ** 40)
    rows = [(20, [big, 1.0, big], 1), (21, [big, 1.0, -big], 1), (22, [1.0, 3.0, 0.0], 2), (23, [big, 2.0, -big], 1)]
    assert sorted(tuple(r) for r in top_k(table(spark, rows)).collect()) == brute_top(rows)


def test_threshold_collects_less_and_loses_nothing():
    rnd = np.random.default_rng(0)
    q, x = (np.floor(rnd.standard_normal((n, 16)) * 10) for n in (30, 3000))
    lists = score_lists(q, x, np.zeros((30, 3000), bool), 2)
    true = np.sort(q @ x.T, axis=1)[:, ::-1][:, :20]
    cut = gathered(lists, 20)[:, 0]
    assert (cut <= true[:, 19]).all()
    i, j, score = resolved(lists, cut, 20)
    assert (score == (q @ x.T)[i, j]).all() and len(i) < 30 * 3000 / 4
    for n in range(30):
        assert (np.sort(score[i == n])[::-1][:20] == true[n]).all()


def test_scan_shrinks_the_bitmap_and_ends_exact():
    rnd = np.random.default_rng(1)
    x = np.floor(rnd.standard_normal((2000, 32)) * 50) * (0.7 ** np.arange(32))   # columns of falling weight
    x, seen = np.floor(x), []
    anchor = x[7].copy()
    want = x @ anchor

    def watched(cut):
        def call(at, lower, upper):
            assert (lower <= want[at]).all() and (want[at] <= upper).all()
            left = cut(at, lower, upper)
            seen.append(int(left.sum()))
            return left
        return call
    at, score = Columns(x).scan(anchor, np.arange(2000) != 7, watched(best(5)))
    assert (score == want[at]).all() and seen[0] < 1999 and seen == sorted(seen, reverse=True)
    assert set(np.argsort(-np.where(np.arange(2000) == 7, -np.inf, want))[:5]) <= set(at)
    p = int(np.sort(want)[-10])
    at, score = Columns(x).scan(anchor, np.ones(2000, bool), watched(windows([p], 80, 5)))
    fits = np.sort(want[(100 * want >= 80 * p) & (want <= p)])[::-1][:5]
    inside = np.sort(score[(100 * score >= 80 * p) & (score <= p)])[::-1][:5]
    assert (fits == inside).all()
