"""tabsight: a Spark-native table profiling, data-quality and chart-data engine.

Every operator is a DataFrame -> DataFrame function built from Spark's own
functions.  The shared basis is one value-frequency aggregation per table
(``operators.freq``); column metadata lives in a long "catalog" DataFrame
with one row per (table, column), so rules over many tables run as one job.
"""

__version__ = "0.1.0"
