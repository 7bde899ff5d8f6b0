"""CSV cut at any byte: records, encodings and headers."""

import csv
import io
import random

import pytest

from tabsight.sources import readers
from tabsight.sources.csv_split import blocks_of, inside_after, lines_of, records


@pytest.fixture
def small_splits(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def cell(r, end):
    k = r.random()
    if k < 0.4:
        return str(r.randint(1, 999))
    if k < 0.5:
        return 'it 5" wide'
    parts = ["a", "é", '""', ",", end, "x y", '""""', end * 2, ', "" ,', "�"]
    return '"x' + "".join(r.choice(parts) for _ in range(r.randint(0, 40))) + '"'


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", [1, 2])
def test_files_cut_anywhere_equal_a_plain_reader(spark, small_splits, tmp_path, end, seed):
    r, want = random.Random(seed), []
    for f in range(2):
        body = "".join(f"{f}-{i},{cell(r, end)},{cell(r, end)}{end}{end if i % 9 == 0 else ''}" for i in range(60))
        text = f'"first ""q""{end}name",b,c{end}{body}'
        (tmp_path / f"f{f}.csv").write_bytes((b"\xef\xbb\xbf" if f else b"") + text.encode())
        rows = [x for x in csv.reader(io.StringIO(text, newline="")) if x]
        names, want = rows[0], want + [tuple(x) for x in rows[1:]]
    df = readers.read_csv(spark, str(tmp_path))
    assert df.columns == names
    assert sorted(map(tuple, df.collect())) == sorted(want)
    text, blocks = records(spark, str(tmp_path))
    assert text.rdd.getNumPartitions() > 8 and blocks.where("inside").count() > 2


def test_inside_after():
    for line, outside, inside in [(b"a,b", False, True), (b'"a', True, False), (b'a"b', False, False), (b'a,"b""c', True, False),
                                  (b'x","y', True, True), (b'""', False, True), (b"", False, True), (b'a,"b",c', False, False),
                                  (b'"",""', False, True), (b'x""y"', False, False), (b'5" wide,"', True, True)]:
        assert (inside_after(line, False), inside_after(line, True)) == (outside, inside), line


def test_one_record_over_many_blocks(spark, small_splits, tmp_path):
    long = "\n".join(f"line {i}, \"\"quoted\"\"" for i in range(400))
    (tmp_path / "a.csv").write_text(f'k,v\n1,"{long}"\n2,x\n')
    got = dict(map(tuple, readers.read_csv(spark, str(tmp_path / "a.csv")).collect()))
    assert got == {"1": long.replace('""', '"'), "2": "x"}


def test_encoding_is_decided_per_file_from_its_bytes(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_text("k,café\n1,�\n2,naïve\n", encoding="utf-8")
    (tmp_path / "b.csv").write_bytes("k,café\n3,na\xefve\n4,plain\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes("k,caf\xe9\n5,ascii\n".encode("latin-1"))
    df = readers.read_csv(spark, str(tmp_path))
    assert df.columns == ["k", "café"]
    assert dict(map(tuple, df.collect())) == {"1": "�", "2": "naïve", "3": "naïve", "4": "plain", "5": "ascii"}
    only = readers.read_csv(spark, str(tmp_path / "c.csv"))
    assert only.columns == ["k", "café"]
    utf8 = {r["file"].rsplit("/", 1)[1]: r["utf8"] for r in blocks_of(lines_of(spark, str(tmp_path))).collect()}
    assert utf8 == {"a.csv": True, "b.csv": False, "c.csv": False}


def test_header_names(spark, tmp_path):
    assert readers.header_names(["a", " a", "b", "a", ""]) == ["a", "a.2", "b", "a.1", "_c4"]
    assert readers.header_names(["a", "a", "a.1"]) == ["a", "a.2", "a.1"]
    (tmp_path / "a.csv").write_text("a, a,b,a\n1,2,3,4\n")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["a", "a.2", "b", "a.1"] and tuple(df.first()) == ("1", "2", "3", "4")


@pytest.mark.parametrize("text", ["", "\n\n", "a,b\n", "a,b\n1,2,3\n", 'a,b\n1,"x\n2,y\n'])
def test_broken_files_raise(spark, tmp_path, text):
    (tmp_path / "a.csv").write_text(text)
    with pytest.raises(readers.DataLoadError):
        readers.read_csv(spark, str(tmp_path / "a.csv"))


def test_missing_file_raises(spark, tmp_path):
    with pytest.raises(readers.DataLoadError):
        readers.read_csv(spark, str(tmp_path / "none.csv"))


def test_short_rows_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\na,b,c\n\n1\n2,"",x\n\n')
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "a.csv")).collect())) == [("1", None, None), ("2", None, "x")]
