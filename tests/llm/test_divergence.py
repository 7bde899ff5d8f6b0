import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tabsight.llm.divergence import DIVERGENCE_SQL, divergence, terms_of
from tabsight.llm.queries import op11_divergence

SF = "/root/testdata/sf0.01"
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]
SCHEMA = "lang string, source string, text string, term long, n string, uses int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = sorted(s for w, s in groups if w == lang)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        mine, of_lang = shares(counts[lang, source]), shares(whole)
        pairs = []
        for other in sources:
            if other != source:
                theirs = shares(counts[lang, other])
                pairs.append((sum(f(mine[t], theirs[t]) for t in kept), other))
        terms = [(f(mine[t], of_lang[t]), t) for t in kept if counts[lang, source][t] and mine[t] > of_lang[t]]
        for part, found, n in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:n]
            out += [(lang, source, part, item, value, r) for r, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def run(spark, rows, min_docs=2, top=3):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in divergence(df, min_docs, top).select(*COLUMNS).collect())


def test_equals_sql_on_the_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({DIVERGENCE_SQL})").fetchall())
    assert sorted(tuple(r) for r in op11_divergence(spark, SF).select(*COLUMNS).collect()) == want


def test_equals_brute_force(spark):
    rows = [("en", "a", "The cat, the dog 7 THE end"), ("en", "a", "the cat"), ("en", "b", "a dog the end"), ("en", "b", None),
            ("en", "c", ""), ("en", None, "cat dog cat dog"), (None, "a", "x y"), ("", "a", "x z"), ("", "b", "y x"),
            ("de", "a", "Über ÜBER über straße"), ("de", "b", "über Straße"), ("de", "b", "ÜBER straße"),
            ("fr", "alone", "un deux"), ("fr", "alone", "un deux trois"), ("es", "q", "nada"), ("es", "r", "otra")]
    got = run(spark, rows)
    assert got == brute(rows, 2, 3)
    # no kept term in es: the pairs stand with 0; c has no terms and is compared all the same
    assert [r for r in got if r[0] == "es"] == [("es", "q", "pair", "r", 0, 1), ("es", "r", "pair", "q", 0, 1)]
    assert {r[3] for r in got if r[:3] == ("en", "c", "pair")} == {"", "a", "b"}


def test_ties_expand_in_byte_order_across_cells(spark):
    words = ["zeta", "é", "alpha", "Beta", "\U0001F600", "ﬀ", "gamma", "delta"]
    rows = [("en", "a", " ".join(words))] * 4 + [("en", "b", "other " * 3 + w) for w in words] * 2 + [("en", "b", "other")] * 40
    for top in (1, 3, 8, 20):
        assert run(spark, rows, 2, top) == brute(rows, 2, top)


def test_long_terms_and_texts_and_repeated_rows(spark):
    rows = [("en", "a", "w" * 200_000 + " " + "k " * 100_000)] * 3 + [("en", "b", "k " + "w" * 200_000)] * 3 + [("en", "b", " \n\t9_")] * 2
    assert run(spark, rows, 3, 10) == brute(rows, 3, 10)


@pytest.mark.parametrize("held", [1, 7])
def test_counts_do_not_depend_on_what_a_task_holds(held, monkeypatch):
    import pyarrow as pa

    from tabsight.llm import divergence as module

    rows = [("en", f"s{i % 3}", f"w{chr(97 + i % 5)} common") for i in range(30)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "text"), r, strict=True)) for r in rows[i:i + 4]]) for i in range(0, 30, 4)]

    def total():
        c = Counter()
        for b in module._count(iter(batches)):
            for r in b.to_pylist():
                c[r["lang"], r["source"], r["term"]] += 1000 * r["n"] + r["docs"]
        return c
    want = total()
    monkeypatch.setattr(module, "HELD", held)
    assert total() == want


def test_empty_table(spark):
    assert run(spark, []) == []


def test_terms():
    assert terms_of("It's A-Z_é\x7fÉ [x]`y{ z") == [t.encode() for t in ["it", "s", "a", "z", "é", "É", "x", "y", "z"]]
    assert terms_of(None) == [] and terms_of("123 \x00") == []
