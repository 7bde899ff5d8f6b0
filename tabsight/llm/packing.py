"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: as many of the longest
as fit, then the binary digits of the rest, longest first.  A piece is a sequence of its own, so no
sequence crosses documents and none needs padding; sequences of equal length are numbered next to
each other, as buckets from which batches of one length are drawn.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage

LONGEST = 2048
END = 1
CACHED_WORDS = 600_000
BLOCK = 20_000
SLICE, SLICE_BYTES = 512, 1 << 20


def pieces(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: powers of two up to ``longest``, longest first."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


#: Runs of letters (a-z and those of Latin-1), and of other visible ASCII without the apostrophe (which may begin a contraction).
_RUNS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[!-&(-@\[-`{-~]+")

#: What may stand behind letters as a run of its own: one visible ASCII sign, but no apostrophe and no "<".
_SIGNS = frozenset(bytes([b]) for b in range(33, 127) if not bytes([b]).isalpha() and b not in b"'<")

#: A full stop or comma that does not stand behind a letter (of ASCII or Latin-1).
_STRAY = re.compile(rb"[.,](?<![A-Za-z][.,])(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][.,])")

#: Characters beyond Latin-1.
_BEYOND = re.compile(rb"[\xc4-\xff]")


class WordIds:
    """Token ids, as little-endian unsigned 32-bit bytes, of words between ASCII white space.

    The tokenizer drops white space and never joins what it separates, nor letters and other signs, and it
    lower-cases.  So the ids of a text are those of its words, and the ids of a plain word are those of its runs
    of letters and of signs; words and runs are encoded once while they are remembered.  With ``added``, text that
    spells an added token is that token, as in a plain encode, and words that hold one are encoded whole.  Runs of letters are
    encoded many at a time: each ends with the one token that is marked as a word's end.
    """

    def __init__(self, tokenizer_file: str, added: bool = False):
        # one thread a worker: Spark has given each core a task, and the library's threads spin on short words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = not added
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        # if all of them hold a "<", only words that do are searched
        self.added = re.compile("|".join(re.escape(x) for x in names).encode(), re.I) if names else None
        self.marked = all("<" in x for x in names)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self.runs: dict[bytes, bytes] = {}

    def _encode(self, parts: list[bytes]) -> None:
        for at in range(0, len(parts), 4096):
            some = parts[at:at + 4096]
            for p, e in zip(some, self.tokenizer.encode_batch_fast([x.decode() for x in some], add_special_tokens=False), strict=True):
                self.runs[p] = np.array(e.ids, "<u4").tobytes()

    def _encode_letters(self, parts: list[bytes]) -> None:
        for at in range(0, len(parts), 1024):
            some = parts[at:at + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(some):   # a vocabulary without such marks
                self._encode(some)
                continue
            data, begin = ids.tobytes(), 0
            for p, end in zip(some, cuts, strict=True):
                self.runs[p] = data[begin:end]
                begin = end

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self.words)
        if len(self.words) + len(new) > CACHED_WORDS:
            self.words, new = {}, words
        # a word of ASCII letters is one run and holds no added token
        plain, mixed = list(filter(bytes.isalpha, new)), list(filterfalse(bytes.isalpha, new))
        runs, split, whole = list(map(bytes.lower, plain)), [], set()
        easy = self.added is None or self.marked
        for w in mixed:
            body, last = w[:-1], w[-1:]
            if easy and last in _SIGNS and body.isalpha():   # as most words that are not plain: letters and one sign
                split.append((body.lower(), last))
                continue
            low = w.lower()
            parts = _RUNS.findall(low)
            # it holds more than those runs, or may hold an added token, whose case counts: encoded whole
            if b"".join(parts) != low or self.added and (b"<" in w or not self.marked) and self.added.search(w):
                parts = [w]
                whole.add(w)
            split.append(parts)
        needed = set(chain.from_iterable(split))
        needed.update(runs)
        missing = needed.difference(self.runs)
        if len(self.runs) + len(missing) > CACHED_WORDS:
            self.runs, missing = {}, needed
        letters = [p for p in missing if (97 <= p[0] <= 122 or p[0] == 0xC3) and p not in whole]
        self._encode([p for p in missing if not (97 <= p[0] <= 122 or p[0] == 0xC3) or p in whole])
        self._encode_letters(letters)
        get = self.runs.__getitem__
        self.words.update(zip(plain, map(get, runs), strict=True))
        self.words.update(zip(mixed, [get(parts[0]) if len(parts) == 1 else b"".join(map(get, parts)) for parts in split], strict=True))

    def _split(self, text: str) -> list[bytes]:
        """Words of a text; full stops and commas begin words of their own where all stand behind a letter.

        Letters end at such a sign in any case, so the ids stay the same, and far fewer words differ.
        """
        data = text.encode("utf-8", "replace")
        if self.added is not None and (not self.marked or b"<" in data) or _STRAY.search(data):
            return data.split()
        if text.isascii() or not _BEYOND.search(data):   # the tokenizer lower-cases; beyond Latin-1 it composes characters first
            data = data.lower()
        return data.replace(b".", b" .").replace(b",", b" ,").split()

    def of(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        found = [self._split(t or "") for t in texts]
        self.learn(set().union(*found))
        get = self.words.__getitem__
        return [b"".join(map(get, f)) for f in found]


_LOADED: dict[str, WordIds] = {}


def _cut(tokenizer_file: str, longest: int, with_ids: bool, ids_type: pa.DataType):
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_file not in _LOADED:
            _LOADED[tokenizer_file] = WordIds(tokenizer_file, added=True)
        encoder = _LOADED[tokenizer_file]
        for batch in batches:
            # short texts many at a time: their new words are encoded together
            step = max(64, min(SLICE, batch.num_rows * SLICE_BYTES // max(batch.column(1).nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                row, start, length, crc, total, kept = [], [], [], [], [], []
                for i, data in enumerate(encoder.of(part.column(1).to_pylist())):
                    data, done = data + end, 0
                    view = memoryview(data)
                    for n in pieces(len(data) // 4, longest):
                        row.append(i)
                        start.append(done)
                        length.append(n)
                        crc.append(zlib.crc32(view[4 * done:4 * (done + n)]))
                        total.append(len(data) // 4)
                        if with_ids:
                            kept.append(np.frombuffer(data, "<u4", n, 4 * done).astype(np.int32))
                        done += n
                out = [part.column(0).take(pa.array(row, pa.int32())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    flat = pa.array(np.concatenate(kept) if kept else np.empty(0, np.int32))
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length, dtype=np.int32)]), pa.int32()), flat))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def pack(df: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST,
         with_ids: bool = True) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, on request, ``ids``.

    Ids are those of the tokenizer at its defaults, without added special tokens; text that spells one is that token.
    A null or blank text is the end token alone.  Repeated rows are packed as often as they occur; null ids
    are kept.  ``longest`` must be a power of two.  Sequence ids count from 0 through the buckets, shortest
    first, without gaps; ``offset`` is 0 throughout, as a piece is its sequence.  An empty table gives no
    rows.  Other columns are not read.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = [picked.schema["id"], *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    cut = stage(picked.mapInArrow(_cut(tokenizer_file, longest, with_ids, pa.list_(pa.int32())), T.StructType(fields)), "pieces")
    # numbering: rows of a bucket are dealt by hash into blocks of about BLOCK rows; blocks get offsets, rows a place in theirs
    sizes = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = F.lit(1)
    for n, rows in sizes.items():
        blocks = F.when(F.col("length") == n, F.lit(-(-rows // BLOCK))).otherwise(blocks)
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("id", "start", "ids_crc32"), blocks).cast("int"))
    first = dict(zip(sorted(sizes), np.concatenate([[0], np.cumsum([sizes[n] for n in sorted(sizes)])]).tolist(), strict=False))
    base = F.lit(0).cast("long")
    for n, at in first.items():
        base = F.when(F.col("length") == n, F.lit(at).cast("long")).otherwise(base)
    offsets = (dealt.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
               .select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before")))
    place = F.row_number().over(Window.partitionBy("length", "block").orderBy("id", "start", "ids_crc32")) - 1
    return (dealt.withColumn("place", place).join(offsets, ["length", "block"])
            .select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
                    (base + F.col("before") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
                    *(["ids"] if with_ids else [])))
