"""CSV whose quoted fields hold line ends, read by many tasks, with the encoding decided per file from its bytes.

A line is the start of a record only if all quotes before it are closed, which a task that begins in mid-file cannot
see.  So the files are scanned twice, both times as plain lines that Spark splits at any block:

1. Every block says whether it ends inside a quoted field, once if it begins outside of one and once if inside, and whether
   its bytes are UTF-8.  These transitions (a row per block) are composed over the blocks of a file in order, which gives
   the state in which every block begins.
2. With that state every block cuts its lines into records.  A record that crosses a block's end comes in pieces, at most
   one at each end of a block; only these are shuffled, and joined in order.

A quote opens a field only at the field's start; a doubled quote inside does not close it; ``\\n`` and ``\\r\\n`` end lines.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage

BOM = b"\xef\xbb\xbf"
BLOCKS = "file string, block long, from_outside boolean, from_inside boolean, utf8 boolean, header binary"
PIECES = "file string, block long, piece int, utf8 boolean, text binary"
#: Kinds of pieces: a whole record, the end of one that an earlier block began, the begin of one that goes on.
WHOLE, END, BEGIN = 0, 1, 2


def inside_after(line: bytes, inside: bool) -> bool:
    """Whether a quoted field is open at the end of ``line``, given whether one is at its begin."""
    at = 0
    if not inside and line[:1] == b'"':
        at, inside = 1, True
    while True:
        if inside:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line[at + 1:at + 2] == b'"':
                at += 2
                continue
            at, inside = at + 1, False
        at = line.find(b',"', at)
        if at < 0:
            return False
        at, inside = at + 2, True


def _states(lines: list[tuple[int, bytes]], n: int, inside: bool) -> tuple[np.ndarray, bool]:
    """For ``n`` lines, of which those with a quote are given: whether each begins inside a field; the state behind them."""
    before, at = np.empty(n, bool), 0
    for i, line in lines:
        before[at:i + 1] = inside
        inside, at = inside_after(line, inside), i + 1
    before[at:] = inside
    return before, inside


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """The batches cut where the file or block changes, and whether a cut begins another block."""
    last = None
    for b in batches:
        file, block = b.column("file").to_pylist(), b.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (np.array(file[1:], object) != np.array(file[:-1], object))) + 1), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                here = (file[i], int(block[i]))
                yield b.slice(i, j - i), here != last
                last = here


def _quoted(lines: pa.Array) -> list[tuple[int, bytes]]:
    """The lines with a quote and where they stand."""
    at = np.flatnonzero(pc.greater_equal(pc.find_substring(lines, b'"'), 0).to_numpy(zero_copy_only=False))
    return list(zip(at.tolist(), lines.take(pa.array(at)).to_pylist(), strict=True))


def _without_mark(lines: pa.Array) -> pa.Array:
    """The lines of a file's begin without a byte order mark."""
    first = lines[0].as_py()
    return pa.concat_arrays([pa.array([first.removeprefix(BOM)], lines.type), lines[1:]]) if first.startswith(BOM) else lines


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: its transitions, whether it is UTF-8, and a file's header record."""
    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "file": [key[0]], "block": pa.array([key[1]], pa.int64()), "from_outside": [ends[False]], "from_inside": [ends[True]],
            "utf8": [utf8], "header": pa.array([b"\n".join(header) if key[1] == 0 else None], pa.binary())})

    key = None
    for b, new in _runs(batches):
        lines = b.column("line")
        if new:
            if key is not None:
                yield row()
            key, ends, utf8, header, open_ = (b.column("file")[0].as_py(), b.column("block")[0].as_py()), {False: False, True: True}, True, [], True
            lines = _without_mark(lines) if key[1] == 0 else lines
        quoted = _quoted(lines)
        for start in (False, True):
            ends[start] = _states(quoted, len(lines), ends[start])[1]
        if utf8:
            try:
                b"\n".join(lines.to_pylist()).decode("utf-8")
            except UnicodeDecodeError:
                utf8 = False
        if key[1] == 0 and open_:
            inside = bool(header)
            for line in lines.to_pylist():
                if not header and line.rstrip(b"\r") == b"":
                    continue   # blank lines are no records
                header.append(line)
                inside = inside_after(line, inside)
                if not inside:
                    open_ = False
                    break
    if key is not None:
        yield row()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and pieces of records, without line ends behind them; a file's first record is its header and left out."""
    def out(kind: int, text: list | pa.Array) -> pa.RecordBatch:
        n = len(text)
        return pa.RecordBatch.from_arrays([
            pa.repeat(pa.scalar(key[0]), n), pa.repeat(pa.scalar(key[1], pa.int64()), n), pa.repeat(pa.scalar(kind, pa.int32()), n),
            pa.repeat(pa.scalar(utf8), n), text if isinstance(text, pa.Array) else pa.array(text, pa.binary())],
            ["file", "block", "piece", "utf8", "text"])

    key, held, closing, header = None, [], False, False
    for b, new in _runs(batches):
        lines = b.column("line")
        if new:
            if held:
                yield out(END if closing else BEGIN, [b"\n".join(held)])
            key, utf8 = (b.column("file")[0].as_py(), b.column("block")[0].as_py()), b.column("utf8")[0].as_py()
            inside = b.column("inside")[0].as_py()
            # ``closing``: the lines held belong to a record that an earlier block began
            held, closing, header = [], inside, key[1] == 0
            lines = _without_mark(lines) if header else lines
        before, inside = _states(_quoted(lines), len(lines), inside)
        after = np.append(before[1:], inside)
        alone = ~before & ~after
        if header and not before[0]:   # the first record that is not blank
            blank = np.array([x.rstrip(b"\r") == b"" for x in lines.to_pylist()]) & alone
            first = int(np.argmax(~blank)) if not blank.all() else None
            if first is not None:
                header = False
                end = first + int(np.argmax(~after[first:])) if not after[first:].all() else None
                if end is None:
                    raise ValueError(f"{key[0]}: the header is longer than a block")
                alone[:first + 1] = False
                lines, before, after, alone = lines[end + 1:], before[end + 1:], after[end + 1:], alone[end + 1:]
            else:
                continue
        if alone.any():
            yield out(WHOLE, lines.filter(pa.array(alone)))
        rest = np.flatnonzero(~alone)
        done = []
        for line, ends in zip(lines.take(pa.array(rest)).to_pylist(), (~after[rest]).tolist(), strict=True):
            held.append(line)
            if ends:
                record = b"\n".join(held)
                if closing:
                    yield out(END, [record])
                    closing = False
                else:
                    done.append(record)
                held = []
        if done:
            yield out(WHOLE, done)
    if held:
        yield out(END if closing else BEGIN, [b"\n".join(held)])


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, line``: the raw lines of text files, in file order within each block; Spark splits the files."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def blocks_of(lines: DataFrame) -> DataFrame:
    """``file, block, inside, ends_inside, utf8, header``: how every block begins; ``utf8`` holds for the whole file."""
    t = lines.mapInArrow(_scan, BLOCKS)
    fixed, swap = F.col("from_outside") == F.col("from_inside"), F.col("from_outside") & ~F.col("from_inside")
    w = Window.partitionBy("file").orderBy("block")   # one row per block
    upto, all_ = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("file")
    t = t.withColumn("swaps", F.sum(swap.cast("int")).over(upto))
    # the last block that ends in one state however it begins, and the swaps since
    since = F.col("swaps") - F.coalesce(F.last(F.when(fixed, F.col("swaps")), True).over(upto), F.lit(0))
    state = F.coalesce(F.last(F.when(fixed, F.col("from_outside")), True).over(upto), F.lit(False))
    t = t.withColumn("ends_inside", state != (since % 2 == 1))
    return stage(t.select("file", "block", F.lag("ends_inside", 1, False).over(w).alias("inside"), "ends_inside",
                          F.min("utf8").over(all_).alias("utf8"), "header",
                          (F.lead("block").over(w).isNull() & F.col("ends_inside")).alias("never_closed")), "blocks")


def records(spark: SparkSession, path: str, fallback: str = "ISO-8859-1") -> tuple[DataFrame, DataFrame]:
    """``text`` of every record but the headers, and the table of blocks.

    A file that is not UTF-8 throughout, its header included, is read as ``fallback``; other files are not
    touched by that.  The blocks are broadcast: a row per block, as Spark's own list of them on the driver.
    """
    lines = lines_of(spark, path)
    blocks = blocks_of(lines)
    pieces = lines.join(F.broadcast(blocks.select("file", "block", "inside", "utf8")), ["file", "block"]).select(
        "file", "block", "line", "inside", "utf8").mapInArrow(_cut, PIECES)
    found = pieces.where(F.col("piece") == WHOLE).select("utf8", "text")
    if not blocks.where("inside").isEmpty():
        parts = pieces.where(F.col("piece") != WHOLE)
        order = Window.partitionBy("file").orderBy("block", "piece")   # at most two rows per block
        crossing = (parts.withColumn("nth", F.sum((F.col("piece") == BEGIN).cast("int")).over(order))
                    .groupBy("file", "nth", "utf8").agg(F.array_sort(F.collect_list(F.struct("block", "piece", F.hex("text").alias("hex")))).alias("p")))
        joined = F.unhex(F.array_join(F.transform("p", lambda x: x["hex"]), "0A"))
        found = found.unionByName(crossing.select("utf8", joined.alias("text")))
    text = F.when(F.col("utf8"), F.col("text").cast("string")).otherwise(F.decode("text", fallback))
    text = F.regexp_replace(text, "\r$", "")
    return found.select(text.alias("text")).where(F.col("text") != ""), blocks


def header_of(blocks: DataFrame, fallback: str = "ISO-8859-1") -> tuple[list[str], list[str]]:
    """The names in the header of the first file, and the files whose last quoted field is never closed."""
    first = blocks.where("block = 0").orderBy("file").select("header", "utf8").first()
    broken = [r["file"] for r in blocks.where("never_closed").select("file").limit(5).collect()]
    if first is None or not first["header"]:
        return [], broken
    text = bytes(first["header"]).decode("utf-8" if first["utf8"] else fallback).removesuffix("\r")
    return next(csv.reader(io.StringIO(text, newline=""))), broken


def parsed(text: DataFrame, columns: int, options: dict[str, str]) -> DataFrame:
    """``c0..cn, _broken``: the fields of every record; ``_broken`` holds a record with too many or too few."""
    names = [*[f"c{i}" for i in range(columns)], "_broken"]
    opts = {k: v for k, v in options.items() if k != "header"} | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "columnPruning": "false"}
    return text.select(F.from_csv("text", ", ".join(f"{n} string" for n in names), opts).alias("r")).select("r.*")
