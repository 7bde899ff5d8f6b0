"""Per-column profiles by semantic type (pipeline and builder variants).

Numeric moments come from A0, quartiles from the distributed exact quantiles over
it, top values from A0 with a partial group limit; the result is one row per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import py_round

from ..functions.casts import finite_or_null, iso_text
from ..functions.constants import BUILDER_TOP_K, TOP_K_CATEGORIES
from .quantiles import quantile_columns, weighted_quantiles
from .stats import _dt_of, _num_of, moments_from_frequencies, topk_values


def profile_report(df: DataFrame, catalog: DataFrame, freq_k: DataFrame, table: str,
                   variant: str = "pipeline", dayfirst: bool = False,
                   quartiles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns ``(profiles, top_values)``: one row per column, and the top-k rows.

    ``quartiles`` (``table, name, p25, median, p75``) saves the ranking where they are known.
    """
    type_col = "semantic_type" if variant == "pipeline" else "semantic_type_builder"
    cat = catalog.where(F.col("table") == table).select(
        "table", "ordinal", "name", "kind", F.col(type_col).alias("semantic_type"), "missing_count", "missing_ratio",
        "non_null", "distinct_count", "avg_len", "min_len", "max_len")
    meta = {r["name"]: r["semantic_type"] for r in cat.select("name", "semantic_type").collect()}  # one row per column
    numeric_cols = [c for c, t in meta.items() if t == "numeric"]
    cat_types = ["categorical", "boolean"]

    # numeric: moments and exact quartiles over A0
    if numeric_cols:
        mom = moments_from_frequencies(freq_k, numeric_cols)
        fk = freq_k.where(F.col("name").isin(numeric_cols) & F.col("value").isNotNull())
        vals = fk.select("table", "name", _num_of(F.col("kind"), F.col("value")).alias("x"), "cnt").where(F.col("x").isNotNull())
        q = quartiles if quartiles is not None else quantile_columns(weighted_quantiles(vals, ["table", "name"], [0.25, 0.5, 0.75]), ["table", "name"],
                             {0.25: "p25", 0.5: "median", 0.75: "p75"})
        num = mom.join(q, ["table", "name"], "left")
        if variant == "pipeline":
            num = num.select("table", "name", F.col("count").alias("num_count"),
                             *[finite_or_null(F.col(c)).alias(c) for c in ["mean", "std", "min", "p25", "median", "p75", "max"]])
        else:
            num = num.select("table", "name", F.col("count").alias("num_count"), "mean",
                             F.when(F.col("count") == 1, F.lit(0.0)).otherwise(F.col("std")).alias("std"),
                             "min", "p25", "median", "p75", "max")
    else:
        num = df.sparkSession.createDataFrame([], "table string, name string, num_count long, mean double, std double, "
                                                  "min double, p25 double, median double, p75 double, max double")

    # categorical / boolean: top value from A0
    k = TOP_K_CATEGORIES if variant == "pipeline" else BUILDER_TOP_K
    cat_names = [c for c, t in meta.items() if t in cat_types]
    top = topk_values(freq_k, k, cat_names) if cat_names else None
    if variant == "pipeline" and top is not None:
        # booleans list every value (at most two)
        bool_names = [c for c, t in meta.items() if t == "boolean"]
        top = top.where(~F.col("name").isin(bool_names) | (F.col("rank") <= 2))
    first = (top.where(F.col("rank") == 1).select("table", "name", F.col("value").alias("top"), F.col("count").alias("freq"))
             if top is not None else df.sparkSession.createDataFrame([], "table string, name string, top string, freq long"))

    # datetime: parsed count and range from A0
    dt_names = [c for c, t in meta.items() if t == "datetime"]
    dt = (freq_k.where(F.col("name").isin(dt_names) & F.col("value").isNotNull())
          .select("table", "name", _dt_of(F.col("kind"), F.col("value"), dayfirst).alias("d"), "cnt")
          .groupBy("table", "name").agg(F.sum(F.when(F.col("d").isNotNull(), F.col("cnt")).otherwise(0)).alias("dt_count"),
                                        F.min("d").alias("_mn"), F.max("d").alias("_mx"))
          .select("table", "name", "dt_count", iso_text(F.col("_mn")).alias("dt_min"), iso_text(F.col("_mx")).alias("dt_max")))

    st = F.col("semantic_type")
    prof = (cat.join(num, ["table", "name"], "left").join(first, ["table", "name"], "left").join(dt, ["table", "name"], "left"))
    avg_len = py_round(F.col("avg_len"), 2) if variant == "pipeline" else F.col("avg_len")
    out = prof.select(
        "table", "ordinal", "name", "semantic_type", "missing_count", "non_null",
        (py_round(F.col("missing_ratio"), 4) if variant == "pipeline" else F.col("missing_ratio")).alias("missing_ratio"),
        F.when(st == "numeric", F.coalesce("num_count", F.lit(0)))
        .when(st.isin(cat_types), F.col("non_null"))
        .when(st == "datetime", F.coalesce("dt_count", F.lit(0)))
        .when(st == "text", F.col("non_null")).cast("long").alias("count"),
        "mean", "std", "min", "p25", "median", "p75", "max",
        F.when(st.isin(cat_types), F.col("distinct_count")).alias("unique"),
        F.when(st.isin(cat_types), F.col("top")).alias("top"),
        F.when(st.isin(cat_types), F.col("freq")).alias("freq"),
        F.when(st == "datetime", F.col("dt_min")).alias("dt_min"),
        F.when(st == "datetime", F.col("dt_max")).alias("dt_max"),
        F.when((st == "text") & (F.col("non_null") > 0), avg_len).alias("avg_length"),
        F.when((st == "text") & (F.col("non_null") > 0), F.col("min_len")).alias("min_length"),
        F.when((st == "text") & (F.col("non_null") > 0), F.col("max_len")).alias("max_length"),
    )
    return out, top


def profile_notes(profiles: DataFrame, variant: str = "pipeline") -> DataFrame:
    """Notes for numeric/datetime columns without valid values, and non-null unknowns."""
    st = F.col("semantic_type")
    bare = st.isin("numeric", "datetime") & (F.col("count") == 0)
    note = F.when(bare, F.concat_ws(":", st, F.lit("no_valid_values")))
    if variant == "pipeline":
        note = note.when((st == "unknown") & (F.col("non_null") > 0), F.lit("unknown:values_of_no_known_type"))
    return (profiles.select("table", "ordinal", "name", "semantic_type", note.alias("note")).where(F.col("note").isNotNull()))
