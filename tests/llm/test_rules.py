"""Quality rules, decontamination and HTML extraction against brute force."""

import hashlib
import html as html_lib
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfolio.llm import decontaminate, html_text, quality_rules, queries

SF = "/root/testdata/sf0.001"


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(spark):
    texts = [None, "", " \n\t ", "a b c d e " * 7, "x\nx\n\n x\ny", "é #*|<>& $%", "a b c d e f a b c d e", "one\x0btwo\x0cthree\rfour"] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("own"))
    for r in quality_rules.base_statistics(df, F.col("doc_id")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(texts[r.doc_id])


def mcd(x, floors):
    """Mean and covariance of the better of two starts, concentrated until the determinant stands still."""
    med, best = np.median(x, axis=0), None
    robust = med, np.diag((1.4826 * np.median(np.abs(x - med), axis=0)) ** 2 + floors**2)
    for mean, cov in (robust, (x.mean(axis=0), np.cov(x.T, bias=True) + np.diag(floors**2))):
        for _ in range(quality_rules.MOST_STEPS):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            near = x[d <= np.sort(d)[int(np.ceil(quality_rules.COVERAGE * len(d))) - 1]]
            was = np.linalg.slogdet(cov)[1]
            mean, cov = near.mean(axis=0), quality_rules.CONSISTENCY * np.cov(near.T, bias=True) + np.diag(floors**2)
            if abs(np.linalg.slogdet(cov)[1] - was) <= quality_rules.STILL:
                break
        best = min(best or (np.inf, 0, 0), (np.linalg.slogdet(cov)[1], mean, cov), key=lambda b: b[0])
    return np.einsum("ij,jk,ik->i", x - best[1], np.linalg.inv(best[2]), x - best[1])


def test_distances_equal_numpy(spark):
    rng = np.random.default_rng(3)
    names = list(quality_rules.FLOORS)
    x = rng.normal(0, [0.2, 1.0, 0.3, 0.2], (400, 4))
    x[:20] += 5
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], ["grp", *names])
    got = rows.join(quality_rules.estimates(rows), "grp").select(*names, quality_rules.distance().alias("d")).collect()
    by_value = {tuple(round(v, 9) for v in r[:4]): r.d for r in got}
    want = mcd(x, np.array(list(quality_rules.FLOORS.values())))
    have = np.array([by_value[tuple(round(float(v), 9) for v in r)] for r in x])
    assert np.allclose(have, want, rtol=1e-2)  # the two starts step on together until both stand still
    assert (have[:20] > quality_rules.CUTOFF).all() and (have[20:] < quality_rules.CUTOFF).mean() > 0.98


def test_rules_edges(spark):
    schema = "doc_id long, text string, lang string, source string, kept string"
    rows = [(1, None, None, None, "x"), (2, "", "en", "s", "x"), (3, "just ten words are in this very short text here", None, "s", "x")] * 2
    got = {(r.doc_id, r.base_failed, r.kept) for r in quality_rules.apply(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, True, False), (2, True, False), (3, False, True)}
    assert quality_rules.apply(spark.createDataFrame([], schema)).count() == 0


def test_junk_goes_and_clean_stays(spark):
    rows = queries.op7_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert sum(not r.kept for r in rows if r.quality == 0) > 5


@pytest.mark.parametrize("many", [5, 40, 200])
def test_small_groups_and_tables_are_judged(spark, many):
    rng = np.random.default_rng(9)
    clean = lambda: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(80))
    junk = lambda: " ".join("#$%&|<>*" * 2 + str(rng.integers(10**9)) for _ in range(80))
    rows = [(i, clean(), "en", "web") for i in range(many)] + [(1000, junk(), "en", "rare"), (1001, junk(), None, None), (1002, clean(), "en", "rare"), (1003, clean(), None, None)]
    got = {r.doc_id: r for r in quality_rules.apply(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and all(not r.base_failed and r.distance is not None for r in got.values())
    assert {d for d, r in got.items() if not r.kept} == {1000, 1001}


def lower_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def contaminated(text, items):
    w, hit, ids = lower_words(text), set(), set()
    for item_id, body in items:
        b = lower_words(body)
        n = min(13, len(b))
        for s in range(len(b) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == b[s : s + n]:
                    hit.update(range(p, p + n))
                    ids.add(str(item_id))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_decontamination(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    items = [(10, item), (9, "Short one"), (2, "solo"), (3, None), (4, "..."), (10, item), (5, "é café"), (6, "not there at all in any document of this small table ever seen before")]
    texts = [None, "", item, item.upper() + "!", "x " * 40 + item, "short, one. short ONE solo", "one two three four five six seven eight nine ten eleven twelve", item.replace("fifteen", "x"), item + " " + item, "y " * 500 + "solo", "É café é café"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts * 2)] + [(0, "solo", "z"), (None, "solo", "z")], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit("own"))
    got = decontaminate.contamination(docs, bench).collect()
    want = [(i, *contaminated(t, items)) for i, t in enumerate(texts * 2)] + [(0, *contaminated("solo", items)), (None, *contaminated("solo", items))]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs, bench.limit(0)).collect()} == {0}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x green y blue"), (2, "blue " + "z " * 9 + "red green"), (3, "red green")], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "blue red green")], "item_id string, text string")
    assert {r.doc_id for r in decontaminate.proximity_matches(docs, bench, 4).collect()} == {1}
    assert {r.doc_id for r in decontaminate.proximity_matches(docs, bench, 20).collect()} == {1, 2}


def test_phrase_and_proximity_matches(spark):
    texts = ["so alpha beta then", "beta or alpha", "alpha " + "z " * 9 + "beta", "beta beta " + "z " * 9 + "alpha beta", "alpha only", None]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)] + [(None, "beta alpha", "own")], "doc_id long, text string, kind string")
    bench = spark.createDataFrame([("q", "alpha beta"), ("r", "solo"), ("s", None)], "item_id string, text string")
    got = {(r.doc_id, r.item_id, r.kind, r.first, r.last) for r in decontaminate.matches(docs, bench, within=4).collect()}
    assert {g for g in got if g[2] == "phrase"} == {(0, "q", "phrase", 1, 2), (3, "q", "phrase", 11 + 0, 12)}
    assert {g[0] for g in got if g[2] == "near"} == {0, 1, 3, None}
    assert decontaminate.matches(docs.limit(0), bench).count() == 0


def test_a_long_document_with_a_frequent_short_item(spark):
    """Each alignment carries its own few words, not the document's."""
    docs = spark.createDataFrame([(1, "x y " * 30_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "x y"), (8, "y x z")], "item_id long, text string")
    r = decontaminate.contamination(docs, bench).first()
    assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (60_000, 60_000, 1, True)


PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div id="cookie-notice">We use cookies</div><main><h1>Title &amp; more</h1><p>First   para &eacute;<br>next line.</p><p>Short.</p><p><b>Bold<p>Third paragraph with <a href=y>a link</a> inside it.
<div class="ad">Buy this now</div><ul><li>item one<li>item two</ul><form><input><p>Your mail</p></form></main><aside>Side</aside><section class="comments"><p>I disagree entirely with this article</p></section><footer>&copy; x</footer></body></html>"""


def test_html():
    assert html_text.blocks(PAGE) == ["Title & more", "First para é next line.", "Short.", "Bold", "Third paragraph with a link inside it.", "item one", "item two"]


LONG = "Quite a long paragraph of the article that has many words and no links in it at all. "


@pytest.mark.parametrize("page, text", [
    # The lead, the end and a second section stay, though one child holds over 70 % of the text.
    (f"<div>Menu</div><article><h1>Head</h1><p>Lead.</p><div class=body><p>{LONG * 3}</p><p>{LONG * 4}</p></div><p>{LONG}</p></article>", f"Head|Lead.|{LONG * 3}|{LONG * 4}|{LONG}"),
    (f"<body><article><section><h2>A</h2><p>{LONG * 8}</p></section><section><h2>B</h2><p>{LONG}</p></section></article></body>", f"A|{LONG * 8}|B|{LONG}"),
    # A list of sources in the article.
    (f"<article><p>{LONG * 3}</p><ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul></article><p>Outside</p>", f"{LONG * 3}|One|Two|Three"),
    # Without an article: all dense text, and menus of the body go.
    (f"<body><ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul><div><p>{LONG * 8}</p></div><div><p>{LONG * 2}</p></div></body>", f"{LONG * 8}|{LONG * 2}"),
])
def test_html_keeps_the_whole_article(page, text):
    assert html_text.blocks(page) == [t.strip() for t in text.split("|")]


TEASERS = "".join(f"<article><h3><a href=t{i}>Teaser {i}</a></h3><p>Read <b>more</b> <i>here</i></p></article>" for i in range(6))


@pytest.mark.parametrize("page, text", [
    # Teaser cards are articles too; only their lines' text-to-tag ratio tells them from the article.
    (f"<body><article><h1>Head</h1><p>{LONG * 3}</p><p>Short.</p><p>{LONG * 2}</p></article>{TEASERS}</body>", f"Head|{LONG * 3}|Short.|{LONG * 2}"),
    # One very long paragraph doesn't make the others sparse.
    (f"<article><p>{LONG * 60}</p>" + f"<p>{LONG}</p>" * 40 + "<p>The end.</p></article>", "|".join([LONG * 60, *[LONG] * 40, "The end."])),
    # Unmarked menus and footers around plain text of the body.
    (f"<body><div><a href=a>Home</a></div><div><a href=b>News</a></div><div><a href=c>Shop</a></div><p>Lead.</p><p>{LONG * 4}</p><ul><li>one<li>two</ul><p>{LONG * 4}</p></body>", f"Lead.|{LONG * 4}|one|two|{LONG * 4}"),
])
def test_html_ratio_clusters_select_the_content(monkeypatch, page, text):
    assert html_text.blocks(page) == [t.strip() for t in text.split("|")]
    verdict = html_text.dense
    monkeypatch.setattr(html_text, "dense", lambda r: ~verdict(r))
    only_article = page.startswith("<article>")  # is kept whole, whichever lines are dense
    assert only_article or html_text.blocks(page) != [t.strip() for t in text.split("|")]


@pytest.fixture(scope="module")
def table_pages(spark):
    return [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]


@pytest.mark.parametrize("verdict", [lambda r: np.ones(len(r), bool), lambda r: np.zeros(len(r), bool)])
def test_html_without_ratios_differs_on_the_tables(table_pages, monkeypatch, verdict):
    before = [html_text.main_text(h) for h in table_pages]
    monkeypatch.setattr(html_text, "dense", verdict)
    assert sum(a != html_text.main_text(h) for a, h in zip(before, table_pages, strict=True)) > 0.9 * len(table_pages)


def article_blocks(page):
    """The blocks of a page that has one article, by cutting its source at block tags."""
    inner = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    parts = re.split(r"(?i)</?(?:p|h\d|ul|li|div|blockquote|pre|section)\b[^>]*>", inner)
    text = [" ".join(html_lib.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", x))).split()) for x in parts]
    return [t for t in text if t]


def test_html_equals_the_articles_of_the_tables(table_pages):
    assert [html_text.blocks(h) for h in table_pages] == [article_blocks(h) for h in table_pages]


def test_html_ratios_alone_find_the_articles(table_pages, monkeypatch):
    for name in ("MARKED", "HINTS", "STRONG"):
        monkeypatch.setattr(html_text, name, frozenset())
    right = found = wanted = 0
    for h in table_pages:
        nameless = re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", h)
        got, want = Counter(html_text.blocks(nameless)), Counter(article_blocks(h))
        right += (got & want).total()
        found += got.total()
        wanted += want.total()
    assert right / found > 0.9 and right / wanted > 0.99


def test_html_of_deep_and_unclosed_elements():
    began = time.time()
    assert html_text.main_text("<article>" + "<div><b>" * 20_000 + LONG * 5 + "</i></p>" * 20_000) == (LONG * 5).strip()
    assert time.time() - began < 20


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("plain &lt;b&gt; text", "plain <b> text"), ("<nav>x</nav>", ""), ("<article><p>cut off here</p><p>and he</", "cut off here\n\nand he"), ("<p>" + "long " * 50000, ("long " * 50000).strip())])
def test_html_edges(page, text):
    assert html_text.main_text(page) == text


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "own"), (2, None, None, None), (1, "u", PAGE, "own")], "page_id long, url string, html string, text string")
    got = html_text.extract(pages, F.col("page_id"), F.col("url")).collect()
    assert [r.n_chars for r in got] == [len(r.text) for r in got] and got[1].text == "" and got[0] == got[2]
    assert html_text.extract(pages.limit(0), F.col("page_id")).count() == 0
