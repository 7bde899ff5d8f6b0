"""K9 in full: calculated fields as Spark expressions.

A formula is rewritten into Spark SQL text, token by token, and Spark parses and checks that: columns in brackets become
quoted names, ``IF`` becomes ``CASE``, a divisor of zero gives null, and functions are those of the table below.  What an
aggregation holds is computed per row, aggregated once per group, and the rest of the formula is an expression over
the aggregates.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import kind_of, nan_to_null, quote, to_number
from .charts import exact_sum

TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^']|'')*'|"(?:[^"]|"")*")|\[(?P<col>[^\]]+)\]|(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
    |(?P<word>[A-Za-z_]\w*)|(?P<op><=|>=|<>|!=|==|[-+*/%(),<>=]))""", re.X)
AGGREGATIONS = ("SUM", "AVG", "MIN", "MAX", "COUNT", "COUNTD")
KEYWORDS = {"IF": "CASE WHEN", "ELSEIF": "WHEN", **{w: w for w in ("THEN", "ELSE", "END", "AND", "OR", "NOT", "TRUE", "FALSE", "NULL")}}
#: Functions of a row, as Spark SQL over their arguments.
FUNCTIONS = {
    "ABS": "abs({0})", "ROUND": "round({0}, {1})", "CEILING": "ceil({0})", "FLOOR": "floor({0})", "SQRT": "sqrt({0})", "ZN": "coalesce({0}, 0)",
    "ISNULL": "({0} IS NULL)", "IFNULL": "coalesce({0}, {1})", "FLOAT": "try_cast({0} AS DOUBLE)", "INT": "try_cast({0} AS BIGINT)", "STR": "cast({0} AS STRING)",
    "LEN": "char_length({0})", "UPPER": "upper({0})", "LOWER": "lower({0})", "TRIM": "trim({0})", "LEFT": "left({0}, {1})", "RIGHT": "right({0}, {1})",
    "MID": "substring({0}, {1}, {2})", "CONCAT": "concat({0}, {1})", "CONTAINS": "contains({0}, {1})", "STARTSWITH": "startswith({0}, {1})",
    "ENDSWITH": "endswith({0}, {1})", "REPLACE": "replace({0}, {1}, {2})", "YEAR": "year({0})", "MONTH": "month({0})", "DAY": "day({0})",
}


def _tokens(formula: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while formula[at:].strip():
        m = TOKEN.match(formula, at)
        if not m:
            raise ValueError(f"not understood in {formula!r}: {formula[at:].strip()[:20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def _literal(text: str) -> str:
    inner = text[1:-1].replace(text[0] * 2, text[0])
    return "'" + inner.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _operand(tokens: list, at: int) -> int:
    """Where the operand that begins at ``at`` ends: a sign, then a group in parentheses, a call, a column, a text or a number."""
    while at < len(tokens) and tokens[at] in (("op", "-"), ("op", "+")):
        at += 1
    if at + 1 < len(tokens) and tokens[at][0] == "word" and tokens[at + 1] == ("op", "("):
        at += 1
    return _closed(tokens, at) if at < len(tokens) and tokens[at] == ("op", "(") else at + 1


def _closed(tokens: list, at: int) -> int:
    """Behind the parenthesis that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(tokens)):
        depth += {"(": 1, ")": -1}.get(tokens[i][1], 0) if tokens[i][0] == "op" else 0
        if depth == 0:
            return i + 1
    raise ValueError("a parenthesis is not closed")


def _arguments(tokens: list) -> list[list]:
    out, depth = [[]], 0
    for t in tokens:
        depth += {"(": 1, ")": -1}.get(t[1], 0) if t[0] == "op" else 0
        if t == ("op", ",") and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return out if tokens else []


class _Sql:
    """The SQL of a formula's tokens; ``aggs`` gathers (aggregation, SQL of its argument), named ``_g0``, ``_g1`` in the text."""

    def __init__(self, columns: list[str], by: list[str]):
        self.columns, self.by, self.aggs, self.free = columns, by, [], []

    def call(self, name: str, args: list[list], inside: bool) -> str:
        if name in AGGREGATIONS:
            if inside:
                raise ValueError(f"{name} inside another aggregation")
            if len(args) != 1:
                raise ValueError(f"{name} takes 1 argument, not {len(args)}")
            self.aggs.append((name, self.of(args[0], True)))
            return f"_g{len(self.aggs) - 1}"
        if name not in FUNCTIONS:
            raise ValueError(f"unknown function {name}")
        wanted = len(set(re.findall(r"\{\d\}", FUNCTIONS[name])))
        if len(args) != wanted:
            raise ValueError(f"{name} takes {wanted} arguments, not {len(args)}")
        return FUNCTIONS[name].format(*[f"({self.of(a, inside)})" for a in args])

    def of(self, tokens: list, inside: bool) -> str:
        out, at = [], 0
        while at < len(tokens):
            what, text = tokens[at]
            if what == "word" and at + 1 < len(tokens) and tokens[at + 1] == ("op", "(") and text.upper() not in KEYWORDS:
                end = _closed(tokens, at + 1)
                out.append(self.call(text.upper(), _arguments(tokens[at + 2:end - 1]), inside))
                at = end
                continue
            if what == "op" and text in "/%":
                end = _operand(tokens, at + 1)
                out.append(f"{text} nullif({self.of(tokens[at + 1:end], inside)}, 0)")
                at = end
                continue
            if what == "word":
                if text.upper() not in KEYWORDS:
                    raise ValueError(f"unknown word {text!r}; columns stand in brackets")
                text = KEYWORDS[text.upper()]
            elif what == "col":
                if text not in self.columns:
                    raise ValueError(f"unknown column {text!r}")
                if not inside:
                    self.free.append(text)
                text = quote(text) if inside or text not in self.by else f"_k{self.by.index(text)}"
            elif what == "text":
                text = _literal(text)
            out.append("=" if text == "==" else text)
            at += 1
        return " ".join(out)


def _aggregate(fn: str, x: Column, dtype) -> Column:
    if fn in ("COUNT", "COUNTD"):
        return F.count(x) if fn == "COUNT" else F.count_distinct(x)
    if fn in ("MIN", "MAX"):
        return F.min(x) if fn == "MIN" else F.max(x)
    v = to_number(x) if kind_of(dtype) == "string" else x.cast("double")
    return exact_sum(v) if fn == "SUM" else F.try_divide(exact_sum(v), F.count(v))


def calculated(df: DataFrame, name: str, formula: str, by: list[str] | None = None) -> DataFrame:
    """K9: the calculated field ``name``: a column beside those of ``df``, or, where the formula aggregates, one value
    for each value of ``by`` (of the whole table without it).

    Nested arithmetic, comparisons, ``IF .. THEN .. ELSEIF .. ELSE .. END``, the row functions of ``FUNCTIONS`` and any number of
    ``SUM AVG MIN MAX COUNT COUNTD``.  A divisor of zero gives null; sums of text take what is a number.  A formula
    that cannot be read, mixes values of rows with aggregates, or does not fit its columns' types is a ``ValueError``.
    """
    by = by or []
    df = nan_to_null(df)
    sql = _Sql(df.columns, by)
    try:
        outer = sql.of(_tokens(formula), False)
        if not outer:
            raise ValueError("empty")
        if not sql.aggs:
            plain = _Sql(df.columns, [])
            return df.select("*", F.expr(plain.of(_tokens(formula), False)).alias(name))
        loose = [c for c in sql.free if c not in by]
        if loose:
            raise ValueError(f"columns outside of an aggregation: {', '.join(loose)}")
        cells = df.select(*[F.col(quote(c)).alias(f"_k{i}") for i, c in enumerate(by)], *[F.expr(a).alias(f"_a{i}") for i, (_, a) in enumerate(sql.aggs)])
        found = cells.groupBy(*[f"_k{i}" for i in range(len(by))]).agg(*[
            _aggregate(fn, F.col(f"_a{i}"), cells.schema[f"_a{i}"].dataType).alias(f"_g{i}") for i, (fn, _) in enumerate(sql.aggs)])
        return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(by)], F.expr(outer).alias(name))
    except (ValueError, ParseException, AnalysisException) as e:
        raise ValueError(f"calculated field {name!r}, {formula!r}: {str(e).strip().splitlines()[0]}") from e


def type_and_role(df: DataFrame, name: str) -> tuple[str, str]:
    """Type (real, integer, string, boolean, date, datetime) and role (measure or dimension) of a calculated field."""
    kind, text = kind_of(df.schema[name].dataType), df.schema[name].dataType.simpleString()
    if kind == "numeric":
        return ("integer" if text in ("tinyint", "smallint", "int", "bigint") else "real"), "measure"
    return {"datetime": "date" if text == "date" else "datetime"}.get(kind, kind if kind != "other" else "string"), "dimension"
