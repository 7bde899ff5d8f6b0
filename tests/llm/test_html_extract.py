import html
import random
import re
import time

import numpy as np

from tabsight.llm import html_extract
from tabsight.llm.html_extract import PRIOR, extract, extract_text, features, minimum_cut, parse, train
from tabsight.llm.queries import op5_html_extraction

SF = "/root/testdata/sf0.01"
PAGE = """<!doctype html><head><title>T</title></head><body class="home"><header><h1>Site</h1></header><nav><a href=x>Home</a> <a href=y>More</a></nav>
<div class="cookie-notice">We use cookies, ok.</div><main><article><header><h1>The &amp; title</h1></header><p>First para,
 with  text.<div class="ad">Buy now, please do it.</div><p>Ok.</p><ul><li>One<li>Two</ul><script>if (a<b) "</p>"</script><!-- <p>no</p> -->
<section id="comments"><p>Nice article, thank you all.</p></section><form><p>Mail:</p><input></form></article>
<aside><p>Related stuff is here, all of it.</p></aside></main><div class="site-footer">&copy; x</div><div style="display:none">secret words, hidden.</div></body>"""


def brute_cut(s, t, edges):
    n, best = len(s), None
    for m in range(1 << n):
        c = sum(t[i] if m >> i & 1 else s[i] for i in range(n)) + sum(w for a, b, w in edges if (m >> a & 1) != (m >> b & 1))
        best = c if best is None else min(best, c)
    return best


def test_minimum_cut_against_all_cuts():
    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randint(1, 9)
        s, t = ([rnd.choice([0, rnd.randint(0, 9)]) for _ in range(n)] for _ in range(2))
        edges = [(a, b, rnd.randint(0, 6)) for a in range(n) for b in range(a) if rnd.random() < 0.5]
        side = minimum_cut(s, t, edges)
        cost = sum(t[i] if side[i] else s[i] for i in range(n)) + sum(w for a, b, w in edges if side[a] != side[b])
        assert cost == brute_cut(s, t, edges)


def test_pages_give_their_articles(spark):
    rows = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = op5_html_extraction(spark, SF).collect()
    assert sorted(r["page_id"] for r in out) == sorted(rows)
    for r in out:
        body = re.search(r"<article>(.*?)</article>", rows[r["page_id"]]["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?(?:b|br)>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"]) and r["url"] == rows[r["page_id"]]["url"]


def test_boilerplate_goes_and_the_article_stays(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(60).collect()
    found = [features(*parse(p["html"])) for p in pages]
    trained = train(np.vstack([x for x, _ in found]), np.concatenate([t for _, t in found]))
    for w in (PRIOR, trained):
        assert extract(PAGE, w) == "The & title\nFirst para, with text.\nOk.\nOne\nTwo"


def test_null_empty_broken_long_and_extra_columns(spark):
    long = "<article>" + "".join(f"<p>Paragraph number {i}, with words.</p>" for i in range(3000)) + "</article>"
    rows = [(1, None), (2, ""), (3, "<"), (4, "<p title='x>a"), (5, long), (5, long), (None, "<article><p>Words here.</p>"), (6, "<script>never closed"), (7, "</p></div></div>")]
    df = spark.createDataFrame([(i, h, "t", 3) for i, h in rows], "page_id long, html string, text string, n_chars int")
    got = [(r["page_id"], r["text"]) for r in extract_text(df).collect()]
    assert len(got) == len(rows) and extract_text(df).columns == df.columns
    text = dict(got)
    assert text[1] == text[2] == text[6] == text[7] == "" and text[None] == "Words here."
    assert text[5].count("\n") == 2999
    assert extract_text(df.limit(0)).count() == 0


def test_skipped_elements_that_are_not_closed_lose_their_tag_only():
    for tag in ("button", "video", "object", "math", "svg", "select", "noscript", "template", "iframe", "canvas", "audio", "datalist"):
        for page in (f"<article><p>First words, here.</p><{tag} class=x><p>Second words, here.</p></article>",
                     f"<{tag}><article><p>First words, here.</p><p>Second words, here.</p></article><{tag}>x</{tag}>"):
            assert [x for x in extract(page, PRIOR).split("\n") if "words" in x] == ["First words, here.", "Second words, here."], page
    assert extract("<article><p>Words here.</p><button>Buy <svg><svg>a</svg>b</svg></button><script>if (1) <p>No words.</p>", PRIOR) == "Words here."


def test_formulas_and_fallbacks_are_text():
    page = "<article><p>So <math><mi>a</mi><mo>=</mo><msup><mi>b</mi><mn>2</mn></msup></math> holds, <object data=x><param name=y>as drawn</object> here.</p></article>"
    assert extract(page, PRIOR) == "So a=b2 holds, as drawn here."


def test_training_keeps_all_distinct_blocks_of_a_long_page(spark, monkeypatch):
    """Paragraphs of 300 lengths in an article, 300 in a navigation: none is left out."""
    blocks = ["".join(f"<p>{'w ' * n}</p>" for n in range(1, 301)), "".join(f"<p>{'v ' * n}</p>" for n in range(1, 301))]
    page = f"<nav>{blocks[0]}</nav><article>{blocks[1]}</article>"
    seen = []
    monkeypatch.setattr(html_extract, "train", lambda x, told: seen.append(told) or PRIOR)
    html_extract.learn(spark.createDataFrame([(1, page)], "page_id long, html string"))
    x, told = features(*parse(page))
    distinct = {(t, *r) for t, r in zip(told, np.round(x, 3).tolist(), strict=True)}
    assert sorted(seen[0].tolist()) == sorted(t for t, *_ in distinct) and (seen[0] == 2).sum() > 200 and (seen[0] < 0).sum() > 200


LONG = ("The first long paragraph of this page tells, in many words, what the article is about, and it goes on.",
        "The second paragraph tells the rest, with commas, and closes the matter after quite a few more words.")


def test_class_words_are_evidence_that_text_can_outweigh():
    body = "".join(f"<p>{x}</p>" for x in LONG)
    for attrs in ('class="main has-sidebar"', 'id="content" class="content with-sidebar"', 'class="legal-article"', 'class="ad-free"', ""):
        assert extract(f"<nav><a href=x>Home</a></nav><div {attrs}>{body}</div><footer>End.</footer>", PRIOR) == "\n".join(LONG), attrs
    for attrs in ('class="post-comments"', 'class="sidebar widget-content"', 'id=comments class=entry', 'class="articleFooter footer"'):
        assert extract(f"<article><p>{LONG[0]}</p><div {attrs}><p>Nice words, all of you.</p></div></article>", PRIOR) == LONG[0], attrs


def test_inline_elements_stay_in_their_sentence():
    for word in ("<span class='search-hit'>bridge</span>", "<a class='share' href=x>bridge</a>", "<b id=ad>bridge</b>"):
        assert extract(f"<article><p>The word {word} appears here.</p></article>", PRIOR) == "The word bridge appears here."
    assert "secret" not in extract("<article><p>The word <span hidden>secret</span> appears here.</p></article>", PRIOR)


def test_tags_end_outside_of_quotes_and_open_ends_take_linear_time():
    assert extract("<article><p title=\"a > b\">Words, here.</p><p title='x>More words, here.</p></article>", PRIOR) == "Words, here.\nMore words, here."
    assert extract("<head><title>T</title></head><article><p>Words, here.</p></article><!-- open <p>no", PRIOR) == "Words, here."
    for piece in ("<head>x", "<a '", "<a \"'>", "<script ", "<button ", "<!", "<div>x", "<button>x", "</p>", "<div><b class=ad>a</b>"):
        page = piece * (500_000 // len(piece))
        start = time.process_time()
        extract(page, PRIOR)
        assert time.process_time() - start < 20, piece


def test_an_id_that_repeats_trains_one_page(spark, monkeypatch):
    pages = [(1, f"<article><p>{'w ' * n}</p></article>") for n in range(1, 8)] + [(2, f"<nav><p>{'v ' * 3}</p></nav>"), (2, None)]
    seen = []
    monkeypatch.setattr(html_extract, "train", lambda x, told: seen.append(told) or PRIOR)
    html_extract.learn(spark.createDataFrame(pages, "page_id long, html string"), train_pages=2)
    assert sorted(seen[0].tolist()) == [-2, 2]
