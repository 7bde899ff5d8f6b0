import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tabsight.llm.mixing import mix, mixture, source_tokens, temperature

ROWS = [(i, " ".join(["w"] * (i % 7 + 1)), "big" if i % 3 else f"s{i % 4}") for i in range(600)]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, s, 1, 2.0, 3) for i, t, s in rows], "doc_id long, text string, source string, tokens int, weight double, block int")


def shares(rows):
    n = Counter()
    for _, t, s in rows:
        n[s] += len((t or "").split()) + 1
    return n


def weights(n, a):
    p = {s: (x / sum(n.values())) ** a for s, x in n.items()}
    return {s: x / sum(p.values()) for s, x in p.items()}


def entropy(w):
    return -sum(x * math.log(x) for x in w.values())


def test_exponent_meets_the_entropy_and_the_repeats(spark):
    s, n = source_tokens(docs(spark)), shares(ROWS)
    a = temperature(s, entropy_share=0.9)
    assert entropy(weights(n, a)) == pytest.approx(0.9 * math.log(len(n)), abs=1e-6)
    assert temperature(s, entropy_share=0.1) == 1.0 and temperature(s) == 1.0
    b = temperature(s, max_repeats=1.5)
    w = weights(n, b)
    rate = {k: w[k] / n[k] for k in n}
    assert max(rate.values()) / min(rate.values()) == pytest.approx(1.5, abs=1e-6) and a < b < 1
    assert temperature(s, entropy_share=0.9, max_repeats=1.5) == b
    assert temperature(s, max_repeats=100.0) == 0.0


def test_weights_and_draws_against_brute_force(spark):
    n = shares(ROWS)
    out = [r.asDict(True) for r in mix(docs(spark), entropy_share=0.9, max_repeats=None).collect()]
    w = weights(n, temperature(source_tokens(docs(spark)), 0.9))
    budget = max(n[s] / w[s] for s in n)
    drawn, times = Counter(), defaultdict(Counter)
    for r in out:
        s = r["row"]["source"]
        assert r["weight"] == pytest.approx(w[s]) and 0 <= r["position"] < 1 and r["tokens"] == len(r["row"]["text"].split()) + 1
        drawn[s] += r["tokens"]
        times[s][r["row"]["doc_id"], r["epoch"]] += 1
    for s in n:
        assert 0 <= drawn[s] - w[s] * budget < 8 + 1e-6                      # less than one row beyond the quota
        assert set(times[s].values()) == {1}
        whole = int(w[s] * budget / n[s] + 1e-9)
        for e in range(whole):                                              # whole epochs hold every row once
            assert sum(1 for (_, x) in times[s] if x == e) == sum(r[2] == s for r in ROWS)
        assert max(e for _, e in times[s]) <= whole
    orders = {e: [k[0] for r in sorted(out, key=lambda r: r["position"]) if r["row"]["source"] == "s0" and r["epoch"] == e
                  for k in [(r["row"]["doc_id"],)]] for e in (0, 1)}
    assert orders[0][:20] != orders[1][:20]


def test_a_budget_cuts_within_a_row(spark):
    out = mix(docs(spark), entropy_share=None, max_repeats=None, budget=500.0)
    got = {r["s"]: r["t"] for r in out.groupBy(F.col("row.source").alias("s")).agg(F.sum("tokens").alias("t")).collect()}
    n = shares(ROWS)
    for s in n:
        assert 0 <= got.get(s, 0) - 500 * n[s] / sum(n.values()) < 8


def test_nulls_empty_repeats_and_hot_source(spark):
    rows = [(1, None, None), (1, None, None), (None, "a b", "x"), (2, "", "x"), (3, "long " * 5000, "y"), (3, "long " * 5000, "y")]
    out = mix(docs(spark, rows), entropy_share=None, max_repeats=None).collect()
    assert Counter(r["row"]["doc_id"] for r in out) == Counter(i for i, _, _ in rows)
    assert mix(docs(spark, rows).limit(0)).count() == 0
    assert mixture(source_tokens(docs(spark, rows)), 1.0).agg(F.sum("weight")).first()[0] == pytest.approx(1)
    assert mix(docs(spark, rows)).select("row.*").columns == docs(spark, rows).columns
