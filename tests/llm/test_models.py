"""Language identification, toxicity and HTML extraction, against slow versions and held-out rows."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quietlake.llm import html_text, langid, page_sample, queries, toxicity

from .helpers import awkward, frame

# language identification


class SlowPPM:
    """The definition, a symbol at a time."""

    def __init__(self, texts):
        self.seen = defaultdict(Counter)
        for t in texts:
            s = langid.PAD + t
            for i in range(len(langid.PAD), len(s)):
                for k in range(langid.ORDER + 1):
                    self.seen[s[i - k : i]][s[i]] += 1

    def bits(self, text):
        s, total = langid.PAD + text, 0.0
        for i in range(len(langid.PAD), len(s)):
            for k in range(langid.ORDER, -1, -1):
                c = self.seen.get(s[i - k : i])
                if c is None:
                    continue
                n, u = sum(c.values()), len(c)
                if s[i] in c:
                    total -= math.log2(c[s[i]] / (n + u))
                    break
                total -= math.log2(u / (n + u))
            else:
                total += 8
        return total


TEXTS = {"de": ["die katze schläft", "der hund und die maus", ""], "en": ["the cat sleeps", "the dog and the mouse"], "fr": ["le chat dort", "été à la mer"]}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([x for v in TEXTS.values() for x in v]), st.text(max_size=12)), min_size=1, max_size=5))
def test_code_lengths_are_exact(texts):
    model = langid.Model({k: [x.encode() for x in v] for k, v in TEXTS.items()})
    raw = [t.encode("utf-8", "replace") for t in texts]
    slow = {k: SlowPPM([x.encode() for x in v]) for k, v in TEXTS.items()}
    want = [[slow[k].bits(x) for k in model.langs] for x in raw]
    assert model.code_lengths(raw) == pytest.approx(np.array(want), rel=1e-4, abs=1e-3)


def test_predictions():
    model = langid.Model({k: [x.encode() for x in v] for k, v in TEXTS.items()})
    lang, score, bits = model.predict([b"", b"12 - 34", "der hund schläft".encode(), "中".encode(), b"the dog"])
    assert lang[:3] == ["und", "und", "de"] and lang[3] != "und" and lang[4] == "en"
    assert score[:2] == [0.0, 0.0] and all(0 <= x <= 1 for x in score)
    assert langid.Model({}).predict([b"x"]) == (["und"], [0.0], [8.0])


def test_language_accuracy(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    got = {r["doc_id"]: r for r in queries.op4_language_id(spark, d).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)


def test_language_edges(spark):
    rows = awkward([(40, "12345"), (41, "Ω")])
    df = frame(spark, rows, clash=True)
    model = langid.train(df)
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(df, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (40, "und"), (7, "fr")} <= got
    kept = langid.accepted(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= {4, 5, 6, 7, None}
    assert langid.identify(frame(spark, []), langid.train(frame(spark, []))).count() == 0


# toxicity


def test_toxicity_on_held_out_rows(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.1")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [r for r in queries.op7_toxicity(spark, d).collect()]
    held = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    hit = sum(y for s, y in held if s >= 0.5)
    assert hit >= 0.85 * sum(y for _, y in held) and hit >= 0.85 * sum(s >= 0.5 for s, _ in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_pooled_scores_are_the_slow_ones():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["bad"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) for _ in range(120)]
    y = np.array([int("bad" in t.split()) for t in texts])
    m = toxicity.Model().fit([t.encode() for t in texts], y, ["en" if i % 2 else "fr" for i in range(120)])
    z, _ = m.logits([t.encode() for t in texts])
    for t, got in zip(texts, z, strict=True):
        h, _ = toxicity.buckets([t.encode()])
        x = np.concatenate([m.emb[m.rows(h)], np.zeros((max(toxicity.WIDTHS), toxicity.DIM))])
        act = []
        for w in toxicity.WIDTHS:
            o = [sum(x[min(i + j, len(x) - 1)] @ m.conv[w][j] if i + j < len(x) else 0 for j in range(w)) for i in range(len(x))]
            act.append(np.maximum(np.max(o, 0), 0))
        assert got == pytest.approx(float(np.concatenate(act) @ m.out + m.bias), abs=1e-3)
    assert ((m.score([t.encode() for t in texts]) >= 0.5) == (y > 0)).mean() > 0.95


def test_toxicity_edges(spark):
    rows = awkward([(i, f"text {i} is {'awful' if i % 3 == 0 else 'fine'}") for i in range(200, 290)])
    df = frame(spark, rows, clash=True)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200, 290)] + [(None, 1), (1, None), (5, 0), (5, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(df, toxicity.train(df, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in got if r["doc_id"] and r["doc_id"] >= 200) >= 85
    none = toxicity.train(df, labels.limit(0))
    assert len({r["score"] for r in toxicity.score_toxicity(df, none).collect()}) == 1
    assert toxicity.score_toxicity(frame(spark, []), none).count() == 0


def test_toxicity_learns_from_every_labelled_text(spark, monkeypatch):
    """Texts over any length too, in several shards; counts are those of all labels, and reruns agree."""
    monkeypatch.setattr(toxicity, "SHARD_WORDS", 150_000)
    rng = random.Random(8)
    rows = [(i, " ".join(["awful" if i % 3 == 0 and k == 900 else f"word{rng.randrange(300)}" for k in range(3000 + 3 * i)]), "en") for i in range(120)]
    assert min(len(r[1]) for r in rows) > 20_000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    first, again = toxicity.train(df, labels), toxicity.train(df, labels)
    assert first.mean == 40 / 120 and (first.gather == again.gather).all() and (first.thresholds == again.thresholds).all()
    got = toxicity.score_toxicity(df, first).collect()
    assert len(got) == 120 and sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in got) >= 115


def test_word_counts_are_of_all_texts():
    texts = ["a b a", "b \u00e9", "", None, "c a"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([1, 0, 1, 0, 1]), pa.array(["en", "fr", "en", None, "en"])], names=["text", "y", "lang"])
    got = {(r["bucket"], r["lang"]): (r["seen"], r["hit"], r["words"]) for part in toxicity.count_words(iter([batch])) for r in part.to_pylist()}
    a, b, e, c = (int(toxicity.buckets([w.encode()])[0][0]) for w in ("a", "b", "\u00e9", "c"))
    assert got == {(a, "en"): (2, 2, 3), (b, "en"): (1, 1, 1), (b, "fr"): (1, 0, 1), (e, "fr"): (1, 0, 1), (c, "en"): (1, 1, 1), (-1, "en"): (3, 3, 5), (-1, "fr"): (1, 0, 2), (-1, None): (1, 0, 0)}


def test_thresholds():
    z, y = np.array([3.0, 2.0, 2.0, 1.0]), np.array([True, True, False, False])
    assert 1 < toxicity.best_threshold(z, y) < 2 and toxicity.best_threshold(z[:0], y[:0]) == 0.0


# HTML


def cost(weights, links, side):
    return sum(w if (w > 0) != s and w > 0 else -w if s and w < 0 else 0 for w, s in zip(weights, side, strict=True)) + sum(c for a, b, c in links if side[a] != side[b])


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_cut_is_least(data):
    n = data.draw(st.integers(1, 7))
    weights = data.draw(st.lists(st.integers(-6, 6).map(float), min_size=n, max_size=n))
    links = [(a, b, float(data.draw(st.integers(0, 4)))) for a in range(n) for b in range(a + 1, n) if data.draw(st.booleans())]
    best = min(cost(weights, links, s) for s in itertools.product([False, True], repeat=n))
    assert cost(weights, links, html_text.min_cut(weights, links)) == pytest.approx(best)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header class="site"><a href="/">Home</a><p>A long slogan of the site that is in its header and goes on and on for many words.</p></header>
<div class="cookie-notice">We use cookies to give you the best experience on this site, and so on and on and on.</div>
<main><article><header><h1>Head&eacute;</h1></header><p>First   paragraph with <b>bold</b> and <a href=x>a link</a>,<br>broken.<p>Second &amp; last &#x41;.
<div class="advert">Buy this thing now, it is the best thing that you can buy anywhere today.</div><ul><li>one<li>two</ul>
<form><label>Your name</label><input name=a></form><blockquote>Quoted words.</blockquote></article>
<section id="comments"><p>A reader says something rather long about the article, which isn't the article.</p></section></main>
<aside>About the author of this page and other long things that aside boxes say.</aside>
<script>document.write("<p>no</p>")</script><div hidden>secret words</div><footer>&copy; 2024 all rights reserved by the owner</footer>"""


def test_article_alone():
    assert html_text.main_text(PAGE) == "Headé\nFirst paragraph with bold and a link, broken.\nSecond & last A.\none\ntwo\nQuoted words."


def test_without_article():
    p = "<div id=nav><a href=1>One</a> <a href=2>Two</a></div><div>" + "".join(f"<p>Paragraph {i} with enough words in it to be counted as the text of a page, as it is long.</p>" for i in range(3)) + "<p>Short one.</p></div><div class='footer'>Contact</div>"
    assert html_text.main_text(p).split("\n")[-1] == "Short one." and html_text.main_text(p).count("\n") == 3


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<", ">", "<a", " href='", "<!--", "-->", "&", "&amp;", "<script>", "</script>", "<li>", "text", "\n", "<![CDATA[x]]>", "<head>", "</", "<div hidden>"]), max_size=20).map("".join))
def test_broken_markup_never_fails(markup):
    out = html_text.main_text(markup)
    assert isinstance(out, str) and "  " not in out and out == "\n".join(x.strip() for x in out.split("\n"))


def test_pages(spark, sf_dir):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (1, "u", PAGE), (4, "u", "<article>" + "<p>word word.</p>" * 20_000 + "</article>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r["text"] for r in got[1:3]] == ["", ""] and got[0] == got[3] and got[4]["text"].count("\n") == 19_999
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def test_smoothness_mends_what_the_classifier_mistakes(monkeypatch):
    """On labelled pages that weren't learnt from: the flow runs, flips labels, and leaves fewer errors than the classifier alone."""
    ran, flow = [], html_text._flow
    monkeypatch.setattr(html_text, "_flow", lambda *a: ran.append(1) or flow(*a))
    w, alone, cut, with_flow, flipped = html_text.weights(), 0, 0, 0, 0
    pages = list(page_sample.labelled_pages(200, seed=99))
    for page, label in pages:
        found, before = html_text.blocks(page), len(ran)
        odds = [html_text.log_odds(b, w) for b in found]
        keep = html_text.min_cut(odds, html_text.edges(found))
        with_flow += len(ran) > before
        flipped += any((o > 0) != k for o, k in zip(odds, keep, strict=True))
        alone += sum((o > 0) != label(b.text) for o, b in zip(odds, found, strict=True))
        cut += sum(k != label(b.text) for k, b in zip(keep, found, strict=True))
    print(f"flow on {with_flow} of {len(pages)} pages, labels flipped on {flipped}, errors {alone} without and {cut} with smoothness")
    assert with_flow >= 0.02 * len(pages) and flipped >= 0.03 * len(pages) and cut < alone
    assert max(map(abs, w)) <= html_text.CUE <= html_text.STRONGEST


def test_cut_is_least_on_real_blocks(spark, sf_dir):
    """All labellings of stretches of ten blocks, of the tables' pages and of labelled ones."""
    w = html_text.weights()
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").limit(20).collect()] + [p for p, _ in page_sample.labelled_pages(20, seed=5)]
    sides = np.array(list(itertools.product([False, True], repeat=10)))
    for page in pages:
        found = html_text.blocks(page)
        for k in range(0, max(1, len(found) - 9), 7):
            some = found[k : k + 10]
            odds, links = np.array([html_text.log_odds(b, w) for b in some]), html_text.edges(some)
            each = sides[: 1 << len(some), -len(some) :] if len(some) < 10 else sides
            costs = (np.where((odds > 0) != each, np.abs(odds), 0)).sum(1) + sum(c * (each[:, a] != each[:, b]) for a, b, c in links)
            assert cost(odds, links, html_text.min_cut(odds.tolist(), links)) == pytest.approx(costs.min())


def test_unlucky_names_in_an_article():
    p = "<article><h1>Head.</h1><p>One paragraph of the text, of some length.</p><p class='share-price'>The price rose again.</p><p>Another paragraph of the text.</p><p id='legal-history'>Laws of old.</p><div class='ad'>Buy now.</div><p>The formula <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <svg><text>a drawing</text></svg>.</p></article><div class='share-buttons'>Share this.</div>"
    assert html_text.main_text(p) == "Head.\nOne paragraph of the text, of some length.\nThe price rose again.\nAnother paragraph of the text.\nLaws of old.\nThe formula x=1 and a drawing."
    q = p.replace("<article>", "<div>").replace("</article>", "</div>")
    assert html_text.main_text(q) == html_text.main_text(p)


def test_all_pages_by_their_articles(spark, sf_dir):
    """In the synthetic pages the article is what <article> holds."""
    import html
    import re

    for r in queries.op2_html_text(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("page", ["<body><p hidden>note<p>article text</body>", "<ul><li style='display:none'>note<li>article text</ul>", "<div><button>note</div><p>article text</p>", "<div>article <span hidden>note<div>note</div></span>text</div>", "<div><p>article text<span hidden>note</div>"])
def test_hidden_elements_end_where_html_ends_them(page):
    assert [b.text for b in html_text.blocks(page)] == ["article text"]
