import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolattice.llm import html_extraction as h
from geolattice.llm import language_id
from geolattice.llm.html_pages import PageMaker

from . import fixtures


def extract(*sources):
    return h.extract(list(sources), h.model())


def test_held_out_pages():
    exact = right = total = 0
    for seed in range(120):
        page = h.read(PageMaker(5_000_000 + seed).page(), labelled=True)
        labels, kept = h.labels_of(page), np.array(h.decode(page, h.model().scores(h.features(page))))
        exact += "\n".join(t for n, t in page.runs if labels[n]) == "\n".join(t for n, t in page.runs if kept[n])
        right, total = right + (labels == kept).sum(), total + len(labels)
    assert right / total > 0.99 and exact / 120 > 0.92


def test_decoding_is_the_best_consistent_choice():
    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randint(1, 9)
        page = h.Page([-1, *(rnd.randrange(i) for i in range(1, n))], [0] * n, [0] * n, [-1] * n, [], [])
        scores = np.array([rnd.gauss(0, 2) for _ in range(n)])
        best = max((sum(s if m >> i & 1 else -s for i, s in enumerate(scores)) for m in range(1, 2**n, 2) if all(m >> page.parent[i] & 1 or not m >> i & 1 for i in range(1, n))))
        kept = h.decode(page, scores)
        assert kept[0] and all(kept[page.parent[i]] for i in range(1, n) if kept[i])
        assert sum(s if k else -s for s, k in zip(scores, kept, strict=True)) == pytest.approx(best)


BODY = "<article><h1>Some  title &amp; more</h1><p>First paragraph of the text, with <b>bold</b>&nbsp;words\n and a <a href='/x'>link</a>.<p>Second paragraph that is not closed<br>and goes on; it says &lt;p&gt; and &#233;.<ul><li>An item of it.<li>Another item.</ul></article>"
TEXT = "Some title & more\nFirst paragraph of the text, with bold words and a link.\nSecond paragraph that is not closed and goes on; it says <p> and é.\nAn item of it.\nAnother item."


def test_pages_with_all_that_is_left_out():
    page = (
        "<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>if(a<b){x='</p>'}</script></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>"
        f"<div class='cookie-banner'>We use cookies. <button>OK</button></div><div class=ad>Buy this thing now, it is good.</div><!-- <p>no</p> -->{BODY}<aside><h3>More</h3><ul><li><a href=c>Three</a></ul></aside>"
        "<form><label>Mail</label><input><textarea>no</textarea></form><section id=comments><h3>2 comments</h3><div class=comment><p>I liked this text a lot.</p></div></section><footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"
    )
    assert extract(page) == [TEXT]


def test_odd_pages():
    assert extract(None, "", "   ", "<p ", "<p", "<!--", "<!-- x", "</p></div>", "<script>x", "<a b='") == [""] * 10
    deep = "<div>" * 3000 + "<p>" + "deep text " * 30
    assert len(extract(deep)) == 1
    assert extract(BODY[:-20])[0].startswith("Some title")
    assert extract("<article><p>" + "word " * 200_000)[0].count("word") in (0, 200_000)
    for seed in range(60):  # any cut of a page is read to its end
        page = PageMaker(seed).page()
        extract(page[: random.Random(seed).randrange(len(page))], page.replace(">", "", 3), page.replace('"', "", 1))


def test_the_label_of_training_is_no_input():
    for value in ("yes", "", "1.5", "0", "1"):
        assert extract(BODY.replace("<article", f'<article data-keep="{value}"').replace("<p>", f"<p DATA-KEEP={value}>")) == [TEXT]


def test_deep_and_stray_tags_take_no_long_time():
    import time

    began = time.process_time()
    n = 100_000
    for page in ("<div>" * n, "<div>" * n + "</span>" * n, "<p><button>" + "<div><b>" * n, "<ul><li>" * n + "</li>" * n, "<table><tr><td>" * n, "<a b='>" * n):
        assert len(extract(page + "<p>end")) == 1
    assert time.process_time() - began < 120


def test_table_of_pages(spark):
    rows = [(1, "u", BODY, 7), (1, "u", BODY, 7), (None, None, None, None), (2, "v", "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = sorted(map(tuple, h.main_texts(pages).collect()), key=repr)
    assert got == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert h.main_texts(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(8)
    rows = [(i, fixtures.prose(rnd, rnd.randint(5, 120), lang), lang) for i in range(600) for lang in [rnd.choice(["en", "fr", "de"])]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()


def test_languages(spark, labelled):
    model = language_id.train(labelled)
    got = language_id.identify(labelled, model).withColumn("held_out", language_id.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert sum(r.accepted for r in got) / len(got) > 0.99 and all(0 <= r.score <= 1 for r in got)
    assert [r.lang_pred for r in language_id.identify(labelled.drop("lang"), language_id.train(labelled)).orderBy("doc_id").collect()] == [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)]
    labels, scores, accepted = model.predict(["Привет мир, как дела сегодня?", "12 !", None, "", "the and tion ing", "中文字符"])
    assert not accepted[[0, 1, 2, 3, 5]].any() and labels[1:4] == ["und"] * 3 and (scores[1:4] == 0).all() and labels[4] == "en" and accepted[4]


def test_texts_without_letters(labelled):
    model = language_id.train(labelled)
    texts = ["\u00bd \u00b2", "\u2460\u2461", "\u2167 12", "\u0663 \u4e00"[:1], "_ - 3", "\U0001f642"]
    assert [(x, y) for x, y, _ in zip(*model.predict(texts), strict=True)] == [("und", 0.0)] * 6
    assert model.predict(["\u2460 the tion"])[0] == ["en"]


def test_any_number_of_labels(spark, labelled, monkeypatch):
    rnd = random.Random(5)
    rows = [(1000 + i, " ".join(fixtures.words(rnd, 30)) + f" {chr(0x4E00 + i % 70)}{chr(0x5E00 + i % 70)}" * 20, f"x{i % 70}") for i in range(420)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "SAMPLE", 210)
    model = language_id.train(many)
    assert len(model.labels) == 70
    monkeypatch.setattr(language_id, "SAMPLE_BUCKETS", 40)
    assert language_id.train(labelled).labels == ["de", "en", "fr"]


def test_held_out_rows_teach_nothing(spark, labelled):
    hidden = labelled.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "xx").otherwise(labelled.lang))
    assert language_id.train(hidden).labels == ["de", "en", "fr"]


def test_languages_of_odd_rows(spark, labelled):
    odd, model = fixtures.odd_documents(spark), language_id.train(labelled)
    got = language_id.identify(odd, model)
    assert got.count() == odd.count() and got.where("text is null").first().lang_pred == "und"
    none = fixtures.no_documents(spark)
    empty = language_id.train(none)
    assert empty.labels == [] and language_id.identify(none, model).count() == 0
    assert {(r.lang_pred, r.score, r.accepted) for r in language_id.identify(odd, empty).collect()} == {("und", 0.0, False)}
    assert language_id.train(labelled.where("lang = 'en'")).predict(["the tion"])[0] == ["en"]


def test_caches_start_anew(labelled, monkeypatch):
    model = language_id.train(labelled)
    texts = [r.text for r in labelled.limit(50).collect()]
    whole = model.predict(texts)
    monkeypatch.setattr(language_id, "REMEMBERED", 20)
    model._sums = None
    model._rows.clear()
    for i, t in enumerate(texts):
        label, score, _ = model.predict([t])
        assert label[0] == whole[0][i] and score[0] == pytest.approx(whole[1][i], abs=1e-6)
