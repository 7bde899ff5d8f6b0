import pytest

from tabsight.operators.formula import calculated, type_and_role

ROWS = [("a", 10.0, 4, "x", "1.5"), ("a", 20.0, 0, "it's", "n/a"), ("b", None, 5, None, "2"), ("b", 6.0, 2, "yx", None), (None, 1.0, 0, "x", "3")]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "g string, `Sales.Amount` double, n int, t string, txt string").repartition(3)


def groups(df, formula):
    return {r["g"]: r["v"] for r in calculated(df, "v", formula, ["g"]).collect()}


def rows(df, formula):
    out = calculated(df, "v", formula)
    assert out.columns == [*df.columns, "v"]
    return {(r["g"], r["n"], r["t"]): r["v"] for r in out.collect()}


def test_aggregates_and_arithmetic(df):
    assert groups(df, "SUM([Sales.Amount]) / SUM([n])") == {"a": 7.5, "b": 6 / 7, None: None}
    assert groups(df, "(SUM([Sales.Amount]) - MIN([n]) * 2) / -(MAX([n]) + 1) + COUNT([t])") == {"a": 30 / -5 + 2, "b": 2 / -6 + 1, None: 0.0}
    assert groups(df, "sum(if [n] > 1 then [Sales.Amount] / [n] elseif isnull([t]) then 7 else 0 end)") == {"a": 2.5, "b": 3.0, None: 0.0}
    assert groups(df, "IF AVG([Sales.Amount]) > 10 THEN 'high' ELSE CONCAT('low ', [g]) END") == {"a": "high", "b": "low b", None: None}
    assert groups(df, "SUM([txt])") == {"a": 1.5, "b": 2.0, None: 3.0}
    assert groups(df, "COUNTD([t]) + 10 % 4") == {"a": 4, "b": 3, None: 3}
    assert [r["v"] for r in calculated(df, "v", "MAX([n]) / 2 / 2").collect()] == [1.25]


def test_rows(df):
    assert rows(df, "[Sales.Amount] / [n]")["a", 0, "it's"] is None
    assert rows(df, "1 + 2 * LEN([t])")["b", 2, "yx"] == 5
    got = rows(df, "IF CONTAINS(UPPER([t]), 'X') AND NOT [n] = 0 THEN \"in\" ELSE 'it''s' END")
    assert got == {("a", 4, "x"): "in", ("a", 0, "it's"): "it's", ("b", 5, None): "it's", ("b", 2, "yx"): "in", (None, 0, "x"): "it's"}
    assert rows(df, "ZN(FLOAT([txt])) - ROUND([n] / (3), 1)")["a", 0, "it's"] == 0.0
    assert rows(df, "[t] = 'it''s' OR [t] == \"x\"")["a", 4, "x"] is True


def test_types_and_roles(df):
    assert type_and_role(calculated(df, "v", "SUM([n]) / 2"), "v") == ("real", "measure")
    assert type_and_role(calculated(df, "v", "LEN([t])"), "v") == ("integer", "measure")
    assert type_and_role(calculated(df, "v", "[n] > 2"), "v") == ("boolean", "dimension")
    assert type_and_role(calculated(df, "v", "LEFT([t], 1)"), "v") == ("string", "dimension")


@pytest.mark.parametrize("formula, why", [
    ("", "empty"), ("SUM([nope])", "unknown column 'nope'"), ("SUM(AVG([n]))", "inside another"), ("SUM([n]) + [n]", "outside of an aggregation: n"),
    ("SUM([n]", "not closed"), ("[n] +", "PARSE_SYNTAX_ERROR"), ("IF [n] THEN 1", "PARSE_SYNTAX_ERROR"), ("EXEC([n])", "unknown function EXEC"), ("n + 1", "unknown word"),
    ("LEFT([t])", "takes 2 arguments"), ("[n] ; 1", "not understood"), ("IF [t] THEN 1 ELSE 2 END", "DATATYPE_MISMATCH")])
def test_bad_formulas(df, formula, why):
    with pytest.raises(ValueError, match="calculated field 'v'") as e:
        calculated(df, "v", formula)
    assert why in str(e.value)


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, n int")
    assert calculated(df, "v", "SUM([n]) / COUNT([n])", ["g"]).collect() == []
    assert [r["v"] for r in calculated(df, "v", "SUM([n]) / COUNT([n])").collect()] == [None]
