"""The pipeline's rows, stage by stage, against brute force over the smallest tables."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tabsight.llm.common import table
from tabsight.llm.quality_rules import apply_rules
from test_line_dedup import components, lines_of
from test_quality import brute_counts
from test_simhash import brute_fingerprint, brute_roots

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage, and what comes out of the last."""
    at, docs, out = tmp_path_factory.mktemp("stages"), table(spark, SF, "documents"), []
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        out.append(docs)
        step(spark, docs, SF).write.parquet(str(at / f"{i}"))
        docs = spark.read.parquet(str(at / f"{i}"))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.dtypes == out[0].dtypes, name
    return [*out, docs]


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_quality_rules(spark, stages):
    judged, _ = apply_rules(stages[0], table(spark, SF, "labels"))
    verdict = {r["doc_id"]: r["kept"] for r in judged.collect()}
    for i, t in rows(stages[0]):
        n = brute_counts(t)
        assert not (verdict[i] and (n[0] < 50 or 100 * n[4] > 50 * n[0]))
    assert sorted(rows(stages[1])) == sorted((i, t) for i, t in rows(stages[0]) if verdict[i])
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    good = [i for i, t in rows(stages[0]) if labels.get(i) == 1 and brute_counts(t)[0] >= 50 and 100 * brute_counts(t)[4] <= 50 * brute_counts(t)[0]]
    assert sum(verdict[i] for i in good) >= 0.97 * len(good)


def test_line_dedup(stages):
    lines = lines_of(rows(stages[1]))
    want, _ = components(lines)
    first = {}
    for i, n, x in sorted(lines):
        first.setdefault(want[x], (i, n))
    kept, missed = defaultdict(list), 0
    for i, n, x in sorted(lines):
        if first[want[x]] == (i, n):
            kept[i].append(x)
    after = {i: [x for x in t.split("\n") if x.strip()] for i, t in rows(stages[2])}
    for i in {*kept, *after}:
        missed += len(set(after.get(i, [])) ^ set(kept.get(i, [])))
    assert missed <= 0.01 * len(lines)                   # near copies that no band found
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_simhash_dedup(stages):
    fps = [(i, brute_fingerprint(t)) for i, t in rows(stages[2])]
    root = brute_roots({f for _, f in fps}, lambda a, b: bin(a ^ b).count("1") <= 2)
    least = {}
    for i, f in sorted(fps):
        least.setdefault(root[f], i)
    assert sorted(i for i, _ in rows(stages[3])) == sorted(least.values())


def test_mixing(stages):
    before, after = rows(stages[3]), Counter(rows(stages[4]))
    assert after.keys() == set(before) and set(after.values()) <= {1, 2}


def test_packing(stages):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = Counter()
    for i, text in rows(stages[4]):
        ids, at = [*t.encode(text, add_special_tokens=False).ids, 1], 0
        for n in [2048] * (len(ids) // 2048) + [1 << b for b in range(10, -1, -1) if len(ids) % 2048 >> b & 1]:
            want[i, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes()), len(ids)] += 1
            at += n
    out = stages[5].collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == want
    assert sorted(r["sequence_id"] for r in out) == list(range(len(out)))
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in out)


def test_run_gives_the_last_stage(spark, stages):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    run = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, run.select(*columns).collect())) == Counter(map(tuple, stages[5].select(*columns).collect()))


def test_stages_on_empty_and_odd_tables(spark):
    wide = table(spark, SF, "documents")
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (2, "x " * 60, "en", "s", 120)],
                                wide.schema).selectExpr("*", "1 AS size", "'z' AS row")
    for docs in (wide.limit(0), odd):
        for name, step in corpus_pipeline.STAGES:
            docs = step(spark, docs, SF)
        assert docs.count() >= 0
