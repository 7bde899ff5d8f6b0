"""Shared pieces of the registered queries: loading, catalog, rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import build_catalog, catalog_of_tables
from ..sources.tables import dirty_orders, load

# rounding of floating results that are sums/means of many doubles: the last bits
# depend on summation order, so registered outputs carry 6 decimals
DIGITS = 6


def r6(c: Column | str, d: int = DIGITS) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, d)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return dirty_orders(spark, sf) if name == "dirty_orders" else load(spark, sf, name)


def catalog_for(spark: SparkSession, sf: str, name: str, dayfirst: bool = False):
    df = table(spark, sf, name)
    cat, fk = build_catalog(spark, df, name, dayfirst=dayfirst)
    return df, cat, fk


def multi_catalog(spark: SparkSession, sf: str, names: list[str], dayfirst: bool = False) -> DataFrame:
    return catalog_of_tables(spark, {n: table(spark, sf, n) for n in names}, dayfirst=dayfirst)
