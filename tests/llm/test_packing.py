import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabsight.llm.packing import WordIds, pack, pieces
from tabsight.llm.queries import op3_packing

SF = "/root/testdata/sf0.01"
FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return t


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_pieces_are_powers_of_two_and_add_up():
    for n in (1, 2, 3, 1023, 2048, 2049, 5000, 10240):
        p = pieces(n)
        assert sum(p) == n and p == sorted(p, reverse=True) and all(x & (x - 1) == 0 and x <= 2048 for x in p)
        assert len({x for x in p if x < 2048}) == len([x for x in p if x < 2048])


def test_word_ids_equal_the_tokenizer(spark, tokenizer):
    odd = ["".join(map(chr, range(0x3000))), "a\x1cb\x85c\xa0d e Σας ΟΔΟΣ İx ʼn é ́x <|endoftext|> it's I'M we'd''x", "\x0b\x0c\x1d x​y", "a b\n\nc\td",
           " ́a ͅb", "don't—stop,now... 'tis", "É.é;×÷ a×b 12.5€ ñ'd", "", "''", "x'", "é. é", "1½2", "K K"]
    texts = odd + [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(300).collect()]
    words = WordIds(FILE)
    for t, got in zip(texts, words.of(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids_of(tokenizer, t)[:-1]


def check(rows, out, tokenizer):
    """Exact round trip of (id, text) rows; ids are unique here."""
    by, sequences = defaultdict(list), set()
    for r in out:
        by[r["doc_id"]].append(r)
        assert r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048
        sequences.add(r["sequence_id"])
    assert sequences == set(range(len(out)))
    assert by.keys() == {i for i, _ in rows}
    for i, t in rows:
        ids, at = ids_of(tokenizer, t), 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            part = ids[at:at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            assert "ids" not in r.asDict() or r["ids"] == part
            at += r["length"]
        assert at == len(ids)


def test_documents_round_trip(spark, tokenizer):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = op3_packing(spark, SF).collect()
    check(rows, out, tokenizer)
    order = sorted(out, key=lambda r: r["sequence_id"])
    assert [r["length"] for r in order] == sorted(r["length"] for r in out)


def test_nulls_empty_long_repeated_and_extra_columns(spark, tokenizer):
    rows = [(1, None), (2, ""), (3, "word " * 30000), (None, "x y"), (5, "Hello, world!")]
    df = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], "doc_id long, text string, id string, block int, length int")
    check(rows, pack(df, FILE).collect(), tokenizer)
    twice = pack(df.unionByName(df), FILE, with_ids=False).collect()
    assert len(twice) == 2 * len(pack(df, FILE).collect()) and len({r["sequence_id"] for r in twice}) == len(twice)
    assert pack(df.limit(0), FILE).count() == 0
    with pytest.raises(ValueError):
        pack(df, FILE, longest=1000)


def test_literal_added_tokens_as_in_a_plain_encode(spark):
    plain = Tokenizer.from_file(FILE)
    rows = [(i, t) for i, t in enumerate(["a <|endoftext|> b", "x<|startoftext|>y,<|endoftext|>'s", "<|ENDOFTEXT|> é<|EndOfText|>中", "<|endoftext|>", "<|endoftext| >",
                                          "中<|endoftext|>é <|startoftext|><|endoftext|>.", "endoftext startoftext <| |>"])]
    check(rows, pack(spark.createDataFrame(rows, "doc_id long, text string"), FILE).collect(), plain)
    assert 49407 in ids_of(plain, rows[0][1])


def test_letters_and_one_sign_need_no_split(monkeypatch):
    from tabsight.llm import packing

    class Never:
        def findall(self, _):
            raise AssertionError("split")

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    words = WordIds(path, added=True)
    odd = ["don't", "x'", "a<", "é,", "a,b", "12", ",", "<|endoftext|>", "Straße.", "3d", "a\x01", "a\x7f"]
    easy = [w + s for w in ("word", "Word", "WORD", "a") for s in map(chr, range(33, 127)) if s not in "'<"]
    want = {t: np.array([*plain.encode(t, add_special_tokens=False).ids], "<u4").tobytes() for t in [*odd, *easy, " ".join(odd)]}
    for t in [*odd, " ".join(odd)]:
        assert words.of([t]) == [want[t]], t
    monkeypatch.setattr(packing, "_RUNS", Never())
    assert words.of(easy) == [want[t] for t in easy]


def test_full_stops_and_commas_make_no_new_words():
    """A word is remembered once, however it is capitalised and whatever of the two stands behind it."""
    words = WordIds(FILE, added=True)
    words.of(["Alpha beta. gamma, Beta, alpha. GAMMA", "été. Été, Beta."])
    assert set(words.words) == {b"alpha", b"beta", b"gamma", "été".encode(), "Été".encode(), b".", b","}


def test_odd_signs_equal_an_unmodified_tokenizer():
    plain, words, rnd = Tokenizer.from_file(FILE), WordIds(FILE, added=True), random.Random(5)
    bits = ["a", "It's", "J", "̌", "É", "é", "ß", "×", "İ", "Σ", "—", "ъ", "1", ".", ",", "...", ",.", " .", ". ", ", ", "'", "'s", "<", "<|endoftext|>",
            "<|EndOfText|>", "\xa0", "\x1c", "\n", "\t", " ", "&", "ª", "​", "²", "T", "̈"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 14))) for _ in range(20_000)]
    for t, got in zip(texts, words.of(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t
