import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.llm import quality_cnn
from tabsight.llm.queries import op7_quality_cnn, op9_decision_list
from tabsight.llm.quality_cnn import CHUNK, STEP, chunks, score, score_documents, train
from tabsight.llm.quality_rules import apply_rules, filter_documents

SF = "/root/testdata/sf0.1"


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    marked = {j for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), dup, len(marked)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@pytest.fixture(scope="module")
def judged(spark):
    return op9_decision_list(spark, SF).collect()


def test_counts_and_base_rules_against_brute_force(spark, judged):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(judged) == len(text)
    for r in judged:
        n = brute_counts(text[r["doc_id"]])
        assert tuple(r[c] for c in COLUMNS) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and (not r["kept"] or not r["base_failed"])


def test_rules_reject_what_is_labelled_low_and_keep_the_rest(spark, judged):
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = [(label[r["doc_id"]], r["kept"]) for r in judged if r["doc_id"] in label and not r["base_failed"]]
    bad, good = [k for q, k in seen if q == 0], [k for q, k in seen if q == 1]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_rules_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b " * 30), (3, "c " * 49), (None, " ".join(f"w{i}" for i in range(60))), (4, " ".join(f"v{i}" for i in range(40000)))]
    df = spark.createDataFrame([(*r, 1, "z", 3) for r in rows], "doc_id long, text string, n_words int, rule string, h int")
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 0), (4, 1), (9, None)], "doc_id long, quality int")
    out, rules = apply_rules(df, labels)
    assert rules == []
    assert sorted((r["doc_id"] or 0, *(r[c] for c in COLUMNS)) for r in out.collect()) == sorted((i or 0, *brute_counts(t)) for i, t in rows)
    kept = filter_documents(df, labels)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {None, 4}
    assert apply_rules(df.limit(0), labels.limit(0))[0].count() == 0 and filter_documents(df.limit(0), labels).count() == 0


def test_the_list_finds_planted_conjunctions(spark):
    def doc(i):
        junk = i % 4 == 0
        return " ".join((f"w{i}x{j}" if not junk else f"q{i}x{j}#") for j in range(60 + i % 50)), 0 if junk else 1
    rows = [(i, *doc(i)) for i in range(400)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    out, rules = apply_rules(df, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int"))
    assert rules and all(r["kept"] == bool(rows[r["doc_id"]][2]) for r in out.collect())
    assert "reject if" in str(rules[0])


def test_chunks_cover_the_whole_text():
    for n in (0, 1, CHUNK, CHUNK + 1, CHUNK + STEP, 5000):
        c = chunks("x" * n)
        assert c.shape == (1 + max(0, -(-(n - CHUNK) // STEP)), CHUNK)
        assert sum((c[0] < 256)) == min(n, CHUNK) and (len(c) - 1) * STEP + CHUNK >= n


def test_held_out_quality(spark):
    out = op7_quality_cnn(spark, SF).collect()
    text = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(out) == text.count()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3)
    held = [(label[r["doc_id"]], r["score"]) for r in out if r["held_out"] and r["doc_id"] in label]
    pos, neg = (np.array([s for q, s in held if q == k]) for k in (1, 0))
    assert (pos[:, None] > neg[None]).mean() > 0.97
    assert np.mean([int(s >= 0.3) == q for q, s in held]) > 0.95


def test_classifier_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x" * 100_000), (None, "abc"), (5, "good text"), (5, "good text")]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, score int, quality string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (5, 1), (5, 0), (7, None)], "doc_id long, quality int")
    out = score_documents(df, labels).collect()
    assert len(out) == len(rows) and len({r["score"] for r in out if r["doc_id"] in (1, 2)}) == 1
    assert {r["held_out"] for r in out if r["doc_id"] is None} == {True}
    assert score_documents(df.limit(0), labels).count() == 0
    none = train(np.empty((0, CHUNK), np.uint16), np.empty(0))
    assert score(none, "anything") == pytest.approx(0.5)
    assert df.select(F.lit(1)).count() == len(rows)


def test_forward_pass_against_plain_loops():
    """Every position of every chunk, one byte and one filter at a time."""
    rnd = np.random.default_rng(3)
    q = quality_cnn
    net = q.Network(*[rnd.normal(0, 0.3, shape) for shape in (
        (q.PAD + 1, q.EMBED), (q.STRIDE * q.EMBED, q.FILTERS), (q.STRIDE * q.EMBED, q.FILTERS), q.FILTERS, q.FILTERS, 1)])
    text = "Ein Satz, größer als ein Stück. " * 30
    raw = text.encode()
    odds = []
    for start in range(0, max(1, len(raw) - q.CHUNK + q.STEP), q.STEP):
        x = [raw[i] if i < len(raw) else q.PAD for i in range(start, start + q.CHUNK)]
        total = net.shift[0]
        for f in range(q.FILTERS):
            best = -np.inf
            for at in range(0, q.CHUNK - q.WIDTH + 1, q.STRIDE):
                response = 0.0
                for i in range(q.WIDTH):
                    weights, row = (net.first, i) if i < q.STRIDE else (net.second, i - q.STRIDE)
                    response += float(net.embed[x[at + i]] @ weights[row * q.EMBED:(row + 1) * q.EMBED, f])
                best = max(best, response)
            total += max(best + net.bias[f], 0) * net.out[f]
        odds.append(total)
    assert len(odds) == len(q.chunks(text)) == 3
    assert np.allclose(q.log_odds(net, q.chunks(text)), odds)
    assert abs(q.score(net, text) - 1 / (1 + np.exp(-np.mean(odds)))) < 1e-9
