import math
import random

import numpy as np
import pytest

from tabsight.operators.comoments import correlations


def brute(a, b):
    both = [(x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None and not math.isnan(x) and not math.isnan(y)]
    if any(math.isinf(v) for p in both for v in p):
        return len(both), "nan"
    if len(both) < 2 or len({x for x, _ in both}) == 1 or len({y for _, y in both}) == 1:
        return len(both), None
    return len(both), np.corrcoef(np.array(both).T)[0, 1]


def held(got, cols, data):
    found = {(r["x"], r["y"]): (r["n"], r["corr"]) for r in got.collect()}
    assert len(found) == len(cols) ** 2
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            n, c = brute([r[i] for r in data], [r[j] for r in data])
            gn, gc = found[a, b]
            assert gn == n, (a, b)
            assert (gc is None if c is None else math.isnan(gc) if c == "nan" else gc == pytest.approx(c, abs=1e-9)), (a, b, gc, c)


def test_masks_constants_infinities_and_far_means(spark):
    r = random.Random(4)
    data = []
    for i in range(700):
        x = r.gauss(0, 1)
        data.append((x, 1e9 + x + r.gauss(0, 1), None if r.random() < 0.4 else x * 2 + r.gauss(0, 3), 0.1, float("nan") if r.random() < 0.5 else r.random(),
                     float("inf") if i == 5 else x, None, 3.0 if i == 9 else None, float(i // 350)))
    cols = ["a.b", "far", "masked", "same", "with nan", "i", "none", "`once", "step"]
    df = spark.createDataFrame(data, ", ".join(f"`{c.replace('`', '``')}` double" for c in cols)).repartition(6)
    held(correlations(df, cols), cols, data)
    ordered = spark.createDataFrame(data, df.schema).coalesce(2)   # "step" is constant in each of two partitions
    held(correlations(ordered, cols), cols, data)


def test_a_hundred_columns_in_one_scan(spark):
    g = np.random.default_rng(1)
    m = g.normal(size=(300, 100)) @ g.normal(size=(100, 100))
    cols = [f"c{i}" for i in range(100)]
    df = spark.createDataFrame([tuple(map(float, row)) for row in m], ", ".join(f"{c} double" for c in cols)).repartition(5)
    got = correlations(df, cols)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = np.corrcoef(m.T)
    rows = got.collect()
    assert len(rows) == 10_000
    assert max(abs(want[int(r["x"][1:]), int(r["y"][1:])] - r["corr"]) for r in rows) < 1e-9


def test_empty(spark):
    df = spark.createDataFrame([], "a double, b int")
    assert {tuple(r) for r in correlations(df, ["a", "b"]).collect()} == {(x, y, 0, None) for x in "ab" for y in "ab"}
    assert correlations(df, []).collect() == []
