"""Oracle texts: shared subqueries are written once."""

import duckdb

from tabsight.functions.rounding import py_round_sql
from tabsight.plans.oracle import named
from tabsight.plans.registry import REGISTRY


def test_no_oracle_text_grows_by_pasting():
    longest = max(REGISTRY, key=lambda k: len(REGISTRY[k][1] or ""))
    assert len(REGISTRY[longest][1]) < 200_000, longest


def test_named_subqueries_change_no_result():
    inner, outer = "(SELECT 1 AS a UNION ALL SELECT 2)", "(SELECT SUM(a) AS s FROM (SELECT 1 AS a UNION ALL SELECT 2) i)"
    for sql in (f"SELECT x.s + y.s + z.a AS r FROM {outer} x, {outer} y, {inner} z",
                f"WITH q AS {inner} SELECT a + s AS r FROM q, {outer} o", f"SELECT a AS r FROM {inner} i"):
        short = named(sql, {"outer_": outer, "inner_": inner})
        assert short.count("SELECT 1 AS a") == 1
        assert sorted(duckdb.sql(short).fetchall()) == sorted(duckdb.sql(sql).fetchall())


def test_rounding_text_equals_python():
    for x in (0.5, 1.5, 2.675, 1.005, -2.5, 1e300, 0.125, 1234.56785):
        for d in (0, 1, 2, 4):
            assert duckdb.sql(f"SELECT {py_round_sql(repr(x), d)}").fetchall()[0][0] == round(x, d)
