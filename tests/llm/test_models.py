"""Language models, the quality classifier and the HTML extractor: held-out accuracy and edge cases."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietday.llm import boosting, html, html_training, langid, quality
from quietday.llm.queries import QUERIES
from tests.llm.common import DE, EN, documents, empty, odd, prose


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, prose(EN if i % 2 else DE, 60, i), "en" if i % 2 else "de") for i in range(200)] + [(900, None, "en"), (901, "x", None), (902, "", "de")]
    return langid.train(documents(spark, rows), 60, 30)


def test_languages_of_odd_texts(spark, model):
    got = {r["doc_id"]: r for r in langid.predict(odd(spark), model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (1, 2, 3, 14))
    assert got[8]["lang_pred"] == got[9]["lang_pred"] == got[16]["lang_pred"] == "en"
    assert got[6]["lang_pred"] in ("en", "de") and got[13]["lang_pred"] in ("en", "de")
    assert langid.predict(odd(spark), model).count() == odd(spark).count()
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.predict(empty(spark), model).count() == 0


def test_unlike_texts_are_rejected_and_usual_ones_stay(spark, model):
    rng = np.random.default_rng(0)
    noise = " ".join("".join(chr(rng.integers(0x3B1, 0x3C9)) for _ in range(6)) for _ in range(60))
    docs = documents(spark, [(1, noise), (2, prose(EN, 80, 999)), (3, prose(DE, 80, 998)), (4, None), (5, prose(EN, 3, 5))])
    kept = langid.filter_known(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5]


@pytest.mark.parametrize("left_out", ["de", "en", "es", "fr"])
def test_a_language_left_out_and_short_junk_are_rejected_and_passages_stay(spark, sf, left_out):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and text is not null")
    model = langid.train(docs.where(F.col("lang") != left_out), 200, 100)
    foreign = [r["text"] for r in docs.where((F.col("lang") == left_out) & (F.length("text") > 300)).select("text").collect()]
    rng = random.Random(0)
    word = lambda a, b: "".join(chr(rng.randint(a, b)) for _ in range(6))
    junk = [" ".join(word(97, 122) for _ in range(10)) for _ in range(50)]
    junk += [" ".join(word(a, b) for _ in range(3)) for a, b in ((0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA)) for _ in range(50)]
    assert np.mean([not r[2] for r in model.score(foreign)]) < 0.1
    assert not any(not r[2] for r in model.score(junk))
    own = docs.where((F.col("lang") != left_out) & F.length("text").between(600, 3000)).select("text").collect()
    mixed = [" ".join([*(w := r["text"].split(" "))[: len(w) // 2], *rng.choice(foreign).split(" ")[: len(w) // 4], *w[len(w) // 2 :]]) for r in own]
    assert np.mean([r[2] for r in model.score(mixed)]) < 0.03


def test_no_labels_no_language(spark):
    nothing = langid.train(documents(spark, [(1, "abc", None)]))
    assert [r["lang_pred"] for r in langid.predict(documents(spark, [(1, "abc")]), nothing).collect()] == ["und"]
    for rows in ([(1, None, "en"), (2, "", "de")], []):
        m = langid.train(documents(spark, rows))
        assert [r["lang_pred"] for r in langid.predict(documents(spark, [(1, "abc"), (2, None)]), m).collect()] == ["und", "und"]


def test_a_column_of_noise_gives_a_bounded_number_of_languages(spark):
    rows = [(i, prose(EN, 30, i), "en") for i in range(30)] + [(100 + i, prose(DE, 30, i), "de") for i in range(20)] + [(200 + i, "x y", f"n{i}") for i in range(40)]
    with pytest.warns(UserWarning, match="only the 2 most frequent"):
        assert langid.train(documents(spark, rows), languages=2).languages == ["de", "en"]


def of_texts(texts):
    return {lang: np.unique(np.concatenate([langid.grams(langid.symbols(t)) for t in ts]), return_counts=True) for lang, ts in texts.items()}


def test_the_full_table_and_backing_off_agree():
    counts = of_texts({"en": [prose(EN, 60, i) for i in range(4)], "de": [prose(DE, 60, i) for i in range(4)], "xx": ["ab ba abba"]})
    with_table, without = langid.build(counts), langid.build(counts, table_bytes=0)
    assert with_table.table is not None and without.table is None
    asked = ["the dog", "der hund und the cat", "zyx", "", "abba ab", prose(EN, 400, 5), "1 2", "é" * 50]
    for a, b in zip(with_table.score(asked), without.score(asked), strict=True):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], rel=1e-5, abs=1e-6)


def test_many_languages_take_the_space_of_their_own_ngrams():
    """128 languages of different letters: a table of all n-grams by languages would take some 80 times as much."""
    rng = np.random.default_rng(0)
    counts = {}
    for i in range(128):
        letters = np.sort(rng.choice(np.arange(0x61, 0x900), 40, replace=False))
        counts[f"l{i:03d}"] = np.unique(langid.grams(np.r_[32, rng.choice(letters, 3000), 32]), return_counts=True)
    model = langid.build(counts, table_bytes=4 << 20)
    own = sum(len(k) for k, _ in counts.values())
    assert model.table is None and model.nbytes < 150 * own and 4 * len(model.tables[langid.ORDER][0].keys) * 128 > 3 * model.nbytes
    texts = {lang: "".join(chr(int(k) & 0xFFF) for k in keys[:60]) for lang, (keys, _) in counts.items()}
    got = model.score(list(texts.values()))
    assert sum(g[0] == lang for g, lang in zip(got, texts, strict=True)) > 120


def test_quantiles_of_pieces_are_those_of_numpy():
    rng = np.random.default_rng(1)
    pieces = np.array([1, 2, 3, 7, 40, 1])
    values = [np.sort(rng.normal(size=k)) for k in pieces]
    first = np.r_[0, np.cumsum(pieces)]
    for q in (0.5, 0.75):
        assert langid.Model._quantile(np.concatenate(values), first, pieces, q) == pytest.approx([np.quantile(v, q) for v in values])


def test_kneser_ney_is_a_distribution():
    sym = langid.symbols("the cat sat on the mat and the rat")
    keys, counts = np.unique(langid.grams(sym), return_counts=True)
    alphabet = np.unique(sym)
    m = langid.KneserNey(keys, counts, len(alphabet))
    for context in {int(k) >> langid.CHAR_BITS for k in keys} | {12345}:
        p = m.probability(np.array([context << langid.CHAR_BITS | int(c) for c in alphabet]), langid.ORDER)
        assert p.sum() == pytest.approx(1.0, abs=1e-9) and (p > 0).all()


def test_op1_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op1_language_id"](spark, sf).join(docs, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(got) == 1000 and 150 < len(held) < 350 and (held["lang"] == held["lang_pred"]).mean() > 0.99
    assert got["rejected"].mean() < 0.005


def test_op2_held_out_accuracy(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = QUERIES["op2_quality_classifier"](spark, sf).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    held = got[got["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert (held["quality"] == held["predicted"]).mean() > 0.95


def test_quality_edges(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(8, 1), (8, 1), (9, 0), (16, 1), (17, 1), (4, None), (15, 0), (None, 1), (3, 7)], "doc_id long, quality int")
    m = quality.fit(docs, labels)
    got = quality.predict(docs, m).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.predict(empty(spark), m).count() == 0
    kept = quality.filter_good(docs, m)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    nothing = quality.fit(docs, labels.where("doc_id > 1000"))
    assert {r["predicted"] for r in quality.predict(docs, nothing).collect()} == {1}
    zeros = quality.fit(docs, labels.where("quality = 0"))
    assert {r["predicted"] for r in quality.predict(docs, zeros).collect()} == {0}


def test_discriminant_separates_what_only_spread_tells_apart():
    rng = np.random.default_rng(1)
    k = len(quality.FEATURES)
    x = np.concatenate([rng.normal(0, 1, (600, k)), rng.normal(0, 3, (600, k))])
    y = np.repeat([0, 1], 600)
    m = quality.fit_arrays(x, y, np.zeros(k))
    assert ((m.posterior(x) >= 0.5) == y).mean() > 0.97


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = boosting.train(x[:2000], y[:2000], rounds=40, depth=3)
    assert ((m.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


@pytest.fixture(scope="module")
def trees():
    return html.model()


def test_extraction_on_pages_not_trained_on(trees):
    pages = [html.Page(x) for x in html_training.training_pages(80, 99)]
    right = total = 0
    for p in pages:
        keep, y = html.decode(p, trees.predict(html.features(p))), html.labels(p)
        total += len(p.runs)
        right += sum(keep[n] == bool(y[n]) for n, *_ in p.runs)
        assert all(keep[p.parents[v]] or not keep[v] for v in range(1, len(keep)))
    assert right / total > 0.98


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- x <p>no</p> -->
<div class="cookie-notice">We use cookies.</div><div class="ad">Buy now, cheap things.</div><article><h1>A title &amp; more</h1><p><b>First   paragraph with&nbsp;words,
and a second line.<br><p>Second paragraph &lt;here&gt; is also part of the text.</p><ul><li>one item of a list</li><li>another item</li></ul></article>
<div id="comments"><h3>Comments</h3><div class="comment"><p>Nice text, thank you for it.</p></div></div><form><p>Sign up for news</p><button>Go</button></form><footer>&copy; site</footer></body></html>"""


def test_a_page(trees):
    assert html.extract([PAGE], trees) == ["A title & more\nFirst paragraph with words, and a second line.\nSecond paragraph <here> is also part of the text.\none item of a list\nanother item"]


def test_page_edges(spark, trees):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "no markup at all, just a plain sentence."), (4, "u", "<p>open <b>never closed"), (5, "u", PAGE[: len(PAGE) // 2]), (6, "u", "<" * 50 + "\">'"), (7, "u", "<div>" * 3000 + "deep"), (None, "u", "<script>only()"), (1, "u", None)]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = html.main_text(df, trees).collect()
    assert len(got) == len(rows) and all(len(r["text"]) == r["n_chars"] for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[2] == by[None] == "" and "First paragraph" in by[5]
    assert html.main_text(df.limit(0), trees).count() == 0


def test_op4_keeps_articles_whole(spark, sf):
    import html as entities
    import re

    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op4_html_extraction"](spark, sf).collect()
    assert len(got) == len(rows)
    same = 0
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", rows[r["page_id"]], re.S)[1]
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        same += r["text"] == "\n".join(x for x in blocks if x)
    assert same / len(got) > 0.99


def plain_kneser_ney(texts, alphabet):
    """Interpolated Kneser-Ney by its definition, on dictionaries: a function of (context, symbol)."""
    counts = {langid.ORDER: {}}
    for t in texts:
        s = [32] * (langid.ORDER - 2) + langid.symbols(t).tolist()
        for i in range(langid.ORDER - 1, len(s)):
            g = tuple(s[i - langid.ORDER + 1 : i + 1])
            counts[langid.ORDER][g] = counts[langid.ORDER].get(g, 0) + 1
    for n in range(langid.ORDER - 1, 0, -1):  # how many distinct symbols stand before
        counts[n] = {}
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1
    discounts = {}
    for n, c in counts.items():
        ones, twos = (sum(v == k for v in c.values()) for k in (1, 2))
        discounts[n] = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5

    def p(context, symbol):
        n = len(context) + 1
        lower = p(context[1:], symbol) if context else 1 / alphabet
        after = [v for g, v in counts[n].items() if g[:-1] == context]
        if not after:
            return lower
        own = max(counts[n].get((*context, symbol), 0) - discounts[n], 0) / sum(after)
        return own + discounts[n] * len(after) / sum(after) * lower

    return p


def test_scores_are_those_of_plain_kneser_ney():
    texts = {"en": [prose(EN, 25, i) for i in range(2)], "de": [prose(DE, 25, i) for i in range(2)]}
    counts = {}
    for lang, ts in texts.items():
        counts[lang] = np.unique(np.concatenate([langid.grams(langid.symbols(t)) for t in ts]), return_counts=True)
    m = langid.build(counts)
    alphabet = len({int(c) for ts in texts.values() for t in ts for c in langid.symbols(t)[1:]})
    plain = {lang: plain_kneser_ney(ts, alphabet) for lang, ts in texts.items()}
    asked = ["the dog ran", "der hund läuft", "zyx qqq", "a", "the der und and", prose(EN, 12, 77)]
    for text, got in zip(asked, m.score(asked), strict=True):
        s = [32] * (langid.ORDER - 2) + langid.symbols(text).tolist()
        bits = {}
        for lang, p in plain.items():
            probs = [p(tuple(s[i - langid.ORDER + 1 : i]), s[i]) for i in range(langid.ORDER - 1, len(s))]
            bits[lang] = -np.mean(np.log2((1 - langid.NOISE) * np.array(probs) + langid.NOISE / alphabet))
        assert got[0] == min(bits, key=bits.get) and got[3] == pytest.approx(min(bits.values()), rel=1e-4)


def test_scores_are_those_of_a_literal_discriminant(spark):
    """Densities by the inverse and determinant of each shrunk covariance, against the cached factors."""
    rng = random.Random(8)
    good = [prose(EN, rng.randint(20, 90), i) for i in range(60)]
    bad = [" ".join(rng.choice(["BUY", "now!!", "$$$", "win|win", "99"]) for _ in range(rng.randint(5, 60))) for _ in range(45)]
    docs = documents(spark, list(enumerate([*good, *bad, "", None])))
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(105)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.predict(docs, quality.fit(docs, labels)).collect()}
    raw = np.array([quality.statistics(t) for t in [*good, *bad, "", ""]])
    k, y = len(quality.FEATURES), np.repeat([1, 0], [60, 45])
    usual = raw[:60, :k].sum(0) / np.maximum(raw[:60, k:].sum(0), 1)
    x = quality.transform(raw, usual)
    z = np.clip((x - x[:105].mean(0)) / np.maximum(x[:105].std(0), 1e-3), -12, 12)
    own = {c: z[:105][y == c] for c in (0, 1)}
    pooled = sum(np.cov(o.T, bias=True) * len(o) for o in own.values()) / 103
    density = {}
    for c, o in own.items():
        lean = max(quality.POOL, k / (k + len(o)))
        cov = (1 - lean) * np.cov(o.T) + lean * pooled
        cov = (1 - quality.RIDGE) * cov + quality.RIDGE * np.trace(cov) / k * np.eye(k)
        d = z - o.mean(0)
        density[c] = np.log(len(o) / 105) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1]
    want = 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / quality.TEMPERATURE, -30, 30)))
    assert [got[i] for i in range(107)] == pytest.approx(want.tolist(), rel=1e-6, abs=1e-9)
    assert ((want[:105] >= 0.5) == (y == 1)).all()


BARE = [
    ("<h1>Title of it</h1><p>First part of the text, with words.</p><p>Second part of the text.</p>", "Title of it\nFirst part of the text, with words.\nSecond part of the text."),
    ("<p>some words</p><math><mi>x</mi></math><p>b <object>fallback</object> c</p>", "some words\nx\nb fallback c"),
    ("<section data-u=/x/><p>in</p></section>", "in"),
    ("<div/>text", "text"),
    ("<div>" * 450 + "deep" + "</div>" * 450, "deep"),
    ("<div><p>One sentence of the text is here.</p><p>A se<b>co</b>nd one <video>no video</video>follows.</p></div><footer>&copy; site</footer>", "One sentence of the text is here.\nA second one follows."),
    ("<div id=main><h2>A head</h2>loose text<br>more of it<ul><li>one<li>two</ul></div><div class=sidebar><h3>More</h3><ul><li><a href=/>x y</a></ul></div>", "A head\nloose text more of it\none\ntwo"),
    ("<p>cut off in a tag is no text<a href='x", "cut off in a tag is no text"),
    ("<p>1 < 2 and 3 <4 &lt;5</p><!-- <p>not</p> --><!--><p>yes it is<?x y?></p>", "1 < 2 and 3 <4 <5\nyes it is"),
]


@pytest.mark.parametrize("page, text", BARE)
def test_pages_without_an_article_element(trees, page, text):
    assert html.extract([page], trees) == [text]


@pytest.mark.parametrize("unit", ["<a", "<a b=\"", "<div class='x>' ", "<!--", "</script ", "<", "<script></script ", "<div>", "<p>x</p>"])
def test_long_hostile_pages_take_linear_time(trees, unit):
    source = (unit * (1_000_000 // len(unit)))[:1_000_000] if unit not in ("<div>", "<p>x</p>") else unit * 60_000
    began = time.process_time()
    html.Page(source)
    assert time.process_time() - began < 3


def test_a_long_page_and_one_depth_for_all(trees):
    page = "<body><article>" + "".join(f"<p>Sentence number {i} of a very long text.</p>" for i in range(20_000)) + "</article><footer>&copy; us</footer>"
    assert html.extract([page], trees)[0].count("\n") == 19_999
    deep = html.Page("<div>" * 5000 + "<p>x")
    assert deep.parents[-1] == len(deep.parents) - 2
