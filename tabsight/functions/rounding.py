"""Python's ``round(x, d)`` on doubles, exactly, as a Column expression.

Python rounds the exact binary value half-to-even; Spark's ``round``/``bround``
round the shortest decimal text, so the two differ when that text is a tie.
The error-free product (Veltkamp split, no FMA needed) recovers the exact
``x * 10**d`` as ``p + e`` and the tie is decided on it.  From ``|x| * 10**d >= 2**52`` on a
double has no digits left to round (and infinities and NaN none at all): it is returned as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = 134217729.0  # 2**27 + 1
WHOLE = float(2 ** 52)


def py_round(x: Column, d: int) -> Column:
    m = F.lit(float(10 ** d))
    p = x * m
    c = F.lit(SPLIT) * x
    xh = c - (c - x)
    xl = x - xh
    mc = SPLIT * float(10 ** d)
    mh = mc - (mc - float(10 ** d))
    ml = float(10 ** d) - mh
    e = ((xh * F.lit(mh) - p) + xh * F.lit(ml) + xl * F.lit(mh)) + xl * F.lit(ml)
    r = F.floor(F.when(F.abs(p) < F.lit(WHOLE), p)).cast("double")
    g = ((p - r) - F.lit(0.5)) + e
    odd = (r - F.lit(2.0) * F.floor(r / 2)) == 1
    up = (g > 0) | ((g == 0) & odd)
    # NaN compares greater than every number
    return F.when(x.isNull(), None).when(F.abs(p) >= F.lit(WHOLE), x).otherwise((r + up.cast("double")) / m)


def py_round_sql(x: str, d: int) -> str:
    """The same computation as SQL text (for the DuckDB oracle); ``x`` stands in it once, the parameter ``v`` elsewhere."""
    m = f"{float(10 ** d)!r}"
    mc = SPLIT * float(10 ** d)
    mh = mc - (mc - float(10 ** d))
    ml = float(10 ** d) - mh
    p = f"(v * {m})"
    c = f"({SPLIT!r} * v)"
    xh = f"({c} - ({c} - v))"
    xl = f"(v - {xh})"
    e = f"((({xh} * {mh!r} - {p}) + {xh} * {ml!r} + {xl} * {mh!r}) + {xl} * {ml!r})"
    big = f"(abs({p}) >= {WHOLE!r} OR isnan({p}))"
    r = f"CAST(floor(CASE WHEN {big} THEN 0 ELSE {p} END) AS DOUBLE)"
    g = f"((({p} - {r}) - 0.5) + {e})"
    odd = f"(({r} - 2.0 * floor({r} / 2)) = 1)"
    rounded = f"(CASE WHEN {big} THEN v ELSE ({r} + CASE WHEN {g} > 0 OR ({g} = 0 AND {odd}) THEN 1.0 ELSE 0.0 END) / {m} END)"
    return f"list_transform([CAST({x} AS DOUBLE)], lambda v: {rounded})[1]"
