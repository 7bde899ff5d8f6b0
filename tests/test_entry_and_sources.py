import os

import pytest

from tabsight.sources import readers


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 8
    assert {"name", "mean", "p25", "outlier_count"} <= set(df.columns)


def test_registry_has_oracles():
    import __spark_entry__ as E

    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 80


def test_csv_reader(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text(" a ,b\n1,x\nNA,n/a\n")
    df = readers.read_csv(spark, str(p))
    assert df.columns == ["a", "b"]
    rows = df.collect()
    assert rows[1]["a"] is None and rows[1]["b"] is None


def test_csv_header_only(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text("a,b,c\n")
    with pytest.raises(readers.DataLoadError):
        readers.read_csv(spark, str(p))


def test_csv_latin1_fallback(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_bytes("name\ncaf\xe9\n".encode("latin-1"))
    assert readers.read_csv(spark, str(p)).first()["name"] == "café"


def test_bad_suffix(spark, tmp_path):
    p = tmp_path / "bad.txt"
    p.write_text("x")
    with pytest.raises(readers.DataLoadError):
        readers.read_table(spark, str(p))


def test_check_source(spark, tmp_path):
    p = tmp_path / "ok.csv"
    p.write_text("a,b\n1,2\n")
    r = readers.check_source(spark, str(p), limit_bytes=1024).first()
    assert r["files"] == 1 and r["bytes"] == p.stat().st_size and r["within_limit"]
    assert not readers.check_source(spark, str(p), limit_bytes=4).first()["within_limit"]
    with pytest.raises(readers.DataLoadError):
        readers.check_source(spark, str(tmp_path / "missing.csv"))
    with pytest.raises(readers.DataLoadError):
        readers.check_source(spark, str(tmp_path / "x.txt"))



def test_stage_round_trip_keeps_schema(spark):
    from tabsight.session import stage

    empty = spark.createDataFrame([], "a int, b string, c array<double>")
    back = stage(empty, "empty")
    assert back.count() == 0 and [f.name for f in back.schema] == ["a", "b", "c"]
    rows = spark.createDataFrame([(1, "x", [1.5]), (None, None, None)], "a int, b string, c array<double>")
    assert sorted(stage(rows, "rows").collect(), key=lambda r: str(r)) == sorted(rows.collect(), key=lambda r: str(r))
