"""SQL text for the independent DuckDB oracle of each registered query.

The oracle never sees Spark: it re-derives the same per-column statistics with
plain SQL (one SELECT per column, UNION ALL) from static schemas of the driver
tables.
"""

from __future__ import annotations

from ..functions.casts import NUMERIC_TEXT_PATTERN
from ..functions.constants import (
    BOOL_FALSE, BOOL_TRUE, BUILDER_TEXT_AVG_LEN, BUILDER_TEXT_DISTINCT, CATEGORICAL_CARDINALITY_THRESHOLD,
    PARSE_RATIO_THRESHOLD, PIPELINE_BOOL_STRINGS, TEXT_AVG_LENGTH_THRESHOLD,
)
from ..sources.tables import DIRTY_ORDERS_SQL

N, S, D, O = "numeric", "string", "datetime", "other"

# static schemas of the driver tables: (column, physical kind)
SCHEMAS = {
    "region": [("r_regionkey", N), ("r_name", S)],
    "nation": [("n_nationkey", N), ("n_name", S), ("n_regionkey", N)],
    "customer": [("c_custkey", N), ("c_name", S), ("c_nationkey", N), ("c_acctbal", N), ("c_mktsegment", S)],
    "supplier": [("s_suppkey", N), ("s_name", S), ("s_nationkey", N), ("s_acctbal", N)],
    "part": [("p_partkey", N), ("p_name", S), ("p_brand", S), ("p_type", S), ("p_size", N), ("p_retailprice", N)],
    "orders": [("o_orderkey", N), ("o_custkey", N), ("o_orderstatus", S), ("o_totalprice", N), ("o_orderdate", D),
               ("o_orderpriority", S)],
    "lineitem": [("l_orderkey", N), ("l_partkey", N), ("l_suppkey", N), ("l_linenumber", N), ("l_quantity", N),
                 ("l_extendedprice", N), ("l_discount", N), ("l_tax", N), ("l_returnflag", S), ("l_linestatus", S),
                 ("l_shipdate", D)],
    "events": [("event_id", N), ("ts", D), ("user_id", N), ("event_type", S), ("value", N), ("props", S)],
    "documents": [("doc_id", N), ("text", S), ("lang", S), ("source", S), ("n_chars", N)],
    "embeddings": [("vec_id", N), ("embedding", O), ("label", N)],
    "pages": [("page_id", N), ("url", S), ("html", S)],
    "benchmark": [("item_id", N), ("text", S)],
    "labels": [("doc_id", N), ("quality", N), ("toxic", N)],
    "conversations": [("conv_id", N), ("turn", N), ("role", S), ("text", S)],
}
SCHEMAS["dirty_orders"] = SCHEMAS["orders"] + [
    ("price_null", N), ("price_text", S), ("date_text", S), ("flag_text", S), ("price_outlier", N),
    ("constant_col", S), ("empty_col", S)]

SCHEMAS["undated_orders"] = [x for x in SCHEMAS["dirty_orders"] if x[0] != "o_orderdate"]

SOURCES = {t: t for t in SCHEMAS}
SOURCES["dirty_orders"] = DIRTY_ORDERS_SQL
SOURCES["undated_orders"] = f"(SELECT * EXCLUDE (o_orderdate) FROM {DIRTY_ORDERS_SQL} u0)"

ISO_FMTS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d"]
MONTH_FIRST = ["%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M", "%m/%d/%Y"]
YEAR_SLASH = ["%Y/%m/%d %H:%M:%S", "%Y/%m/%d %H:%M", "%Y/%m/%d"]
MONTH_NAME = ["%b %d, %Y", "%B %d, %Y", "%d %b %Y", "%d %B %Y", "%d-%b-%Y"]
DAY_FIRST = ["%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M", "%d/%m/%Y"]


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit_list(vals) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in vals)


def num_sql(c: str) -> str:
    """P3 in SQL: NULL unless the trimmed text is a plain number."""
    t = f"trim(CAST({c} AS VARCHAR))"
    return (f"CASE WHEN regexp_full_match({t}, '(?i){NUMERIC_TEXT_PATTERN[1:-1]}') "
            f"THEN TRY_CAST({t} AS DOUBLE) END")


def dt_sql(c: str, dayfirst: bool = False) -> str:
    t = f"trim(CAST({c} AS VARCHAR))"
    fmts = ISO_FMTS + (DAY_FIRST if dayfirst else MONTH_FIRST) + YEAR_SLASH + MONTH_NAME
    day = r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"
    fraction = f"CASE WHEN regexp_full_match({t}, '{day}:\\d{{2}}\\.\\d{{1,9}}') THEN TRY_CAST({t} AS TIMESTAMP) END"
    zoned = (f"CASE WHEN regexp_full_match({t}, '{day}(:\\d{{2}}(\\.\\d{{1,9}})?)?(Z|[+-]\\d{{2}}:\\d{{2}})') "
             f"THEN TRY_CAST({t} AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END")
    return "COALESCE(" + ", ".join([*[f"try_strptime({t}, '{f}')" for f in fmts], fraction, zoned]) + ")"


def column_stats_sql(table: str, dayfirst: bool = False, label: str | None = None) -> str:
    label = label or table
    src = SOURCES[table]
    parts = []
    for i, (c, k) in enumerate(SCHEMAS[table]):
        cq = q(c)
        avg_len = f"AVG(length({cq}))" if k == S else "CAST(NULL AS DOUBLE)"
        min_len = f"MIN(length({cq}))" if k == S else "CAST(NULL AS BIGINT)"
        max_len = f"MAX(length({cq}))" if k == S else "CAST(NULL AS BIGINT)"
        if k == N:
            num, dt = f"CAST({cq} AS DOUBLE)", "CAST(NULL AS TIMESTAMP)"
        elif k == S:
            num, dt = num_sql(cq), dt_sql(cq, dayfirst)
        elif k == D:
            num, dt = "CAST(NULL AS DOUBLE)", f"CAST({cq} AS TIMESTAMP)"
        else:
            num, dt = "CAST(NULL AS DOUBLE)", "CAST(NULL AS TIMESTAMP)"
        str_bool = f"BOOL_AND({cq} IN ({lit_list(PIPELINE_BOOL_STRINGS)}))" if k == S else "CAST(NULL AS BOOLEAN)"
        zero_one = f"BOOL_AND({cq} IN (0, 1))" if k == N else "CAST(NULL AS BOOLEAN)"
        bb = (f"BOOL_AND(lower(trim(CAST({cq} AS VARCHAR))) IN ({lit_list(BOOL_TRUE + BOOL_FALSE)}))"
              if k in (S, D) else "CAST(NULL AS BOOLEAN)")
        parts.append(
            f"SELECT '{label}' AS \"table\", {i} AS ordinal, '{c}' AS name, '{k}' AS kind, "
            f"COUNT(*) AS n_rows, COUNT(*) - COUNT({cq}) AS missing_count, COUNT({cq}) AS non_null, "
            f"COUNT(DISTINCT {cq}) AS distinct_count, {avg_len} AS avg_len, {min_len} AS min_len, {max_len} AS max_len, "
            f"COUNT({num}) AS num_parsed, COUNT({dt}) AS dt_parsed, MIN({num}) AS num_min, MAX({num}) AS num_max, "
            f"{str_bool} AS str_bool, {zero_one} AS zero_one, {bb} AS builder_bool FROM {src}")
    return "\nUNION ALL\n".join(parts)


def pipeline_type_sql() -> str:
    r = PARSE_RATIO_THRESHOLD
    return f"""CASE WHEN non_null = 0 THEN 'unknown'
      WHEN kind = 'boolean' THEN 'boolean'
      WHEN kind = 'string' AND COALESCE(str_bool, false) AND distinct_count <= 2 THEN 'boolean'
      WHEN kind = 'datetime' THEN 'datetime'
      WHEN kind = 'numeric' AND COALESCE(zero_one, false) AND distinct_count <= 2 THEN 'boolean'
      WHEN kind = 'numeric' THEN 'numeric'
      WHEN kind = 'string' AND num_parsed / CAST(non_null AS DOUBLE) >= {r} THEN 'numeric'
      WHEN kind = 'string' AND dt_parsed / CAST(non_null AS DOUBLE) >= {r} THEN 'datetime'
      WHEN kind = 'string' AND distinct_count <= {CATEGORICAL_CARDINALITY_THRESHOLD} THEN 'categorical'
      WHEN kind = 'string' AND avg_len > {TEXT_AVG_LENGTH_THRESHOLD} THEN 'text'
      WHEN kind = 'string' THEN 'categorical'
      ELSE 'unknown' END"""


def builder_type_sql() -> str:
    return f"""CASE WHEN non_null = 0 THEN 'unknown'
      WHEN kind = 'other' THEN 'unknown'
      WHEN kind IN ('numeric', 'boolean') THEN 'numeric'
      WHEN COALESCE(builder_bool, false) THEN 'boolean'
      WHEN dt_parsed / CAST(non_null AS DOUBLE) >= {PARSE_RATIO_THRESHOLD} THEN 'datetime'
      WHEN distinct_count > {BUILDER_TEXT_DISTINCT} OR avg_len > {BUILDER_TEXT_AVG_LEN} THEN 'text'
      ELSE 'categorical' END"""


def catalog_sql(tables: list[str], dayfirst: bool = False) -> str:
    """Full catalog: stats + both semantic types, as a parenthesised subquery."""
    body = "\nUNION ALL\n".join(column_stats_sql(t, dayfirst) for t in tables)
    return (f"(SELECT *, missing_count / CAST(n_rows AS DOUBLE) AS missing_ratio, non_null = 0 AS is_empty, "
            f"{pipeline_type_sql()} AS semantic_type, {builder_type_sql()} AS semantic_type_builder "
            f"FROM ({body}) s)")


def value_num_sql(c: str, kind: str) -> str:
    """Numeric view of a column in SQL (P3 for text)."""
    if kind == N:
        return f"CAST({c} AS DOUBLE)"
    if kind == S:
        return num_sql(c)
    return "CAST(NULL AS DOUBLE)"


def value_dt_sql(c: str, kind: str, dayfirst: bool = False) -> str:
    if kind == D:
        return f"CAST({c} AS TIMESTAMP)"
    if kind == S:
        return dt_sql(c, dayfirst)
    return "CAST(NULL AS TIMESTAMP)"


def iso_sql(e: str) -> str:
    """Python isoformat of a timestamp: seconds, plus .ffffff when non-zero."""
    return (f"CASE WHEN {e} IS NULL THEN NULL WHEN microsecond({e}) % 1000000 = 0 "
            f"THEN strftime({e}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({e}, '%Y-%m-%dT%H:%M:%S.%f') END")


def np_quantiles_sql(values_sql: str, qs: dict[str, float]) -> str:
    """Linear-interpolation quantiles in numpy's two-sided form (``values_sql`` yields column v).

    Used where the oracle must reproduce the exact double (e.g. before 4-digit rounding).
    """
    cols = []
    for name, q in qs.items():
        pos = f"({q} * (n - 1))"
        a = f"MAX(CASE WHEN rn = floor({pos}) THEN v END)"
        b = f"MAX(CASE WHEN rn = ceil({pos}) THEN v END)"
        t = f"MAX({pos} - floor({pos}))"
        cols.append(f"CASE WHEN {t} >= 0.5 THEN {b} - ({b} - {a}) * (1 - {t}) ELSE {a} + ({b} - {a}) * {t} END AS {name}")
    return (f"SELECT {', '.join(cols)}, MAX(n) AS n FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS rn, "
            f"COUNT(*) OVER () AS n FROM ({values_sql}) s0 WHERE v IS NOT NULL) s1")


def named(sql: str, parts: dict[str, str]) -> str:
    """``sql`` with every subquery of ``parts`` that it repeats written once, as a common table expression.

    ``parts`` go from the outer to the inner ones: the text of each may hold those behind it.
    """
    used: dict[str, str] = {}
    for name, text in parts.items():
        ref = f"(SELECT * FROM {name})"
        if sql.count(text) + sum(t.count(text) for t in used.values()) > 1:
            sql = sql.replace(text, ref)
            used = {k: t.replace(text, ref) for k, t in used.items()} | {name: text}
    if not used:
        return sql
    defined = ",\n".join(f"{k} AS MATERIALIZED {t}" for k, t in reversed(used.items()))
    return f"WITH {defined}{', ' + sql[5:] if sql.startswith('WITH ') else chr(10) + sql}"
