"""Language, quality and block labels: held-out accuracy, and defined results for odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import blocklabel, langid, quality, queries, sample
from quern.llm.html_blocks import blocks

SF = "/root/testdata/sf0.01"


def rest(key, parts):
    return zlib.crc32(str(key).encode()) % parts


def test_language_of_held_out_texts(spark):
    got = queries.language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    assert all(row["held_out"] == (rest(row["doc_id"], 3) == 1) and 0 <= row["score"] <= 1 for row in got)
    held = [row for row in got if row["held_out"]]
    assert len(got) == 1000 and np.mean([row["lang_pred"] == row["lang"] for row in held]) > 0.97


def test_bit_slices_answer_for_every_language():
    plan = langid.Plan(cells_log2=12)
    names = [f"l{k:02}" for k in range(11)]
    rng = np.random.default_rng(1)
    held = {name: rng.choice(1 << 30, 40, replace=False) for name in names}
    grams = pa.table({
        "lang": np.repeat(names, 40), "gram": np.concatenate(list(held.values())).astype(np.int64), "share": np.full(440, 0.5),
    })
    model = langid._build(names, grams, plan)
    assert model.cells.shape[0] == 2 and (model.by_chance < 0.01).all()
    for at, name in enumerate(names):
        mask = np.full(40, 255, np.uint8)
        for probe in range(plan.probes):
            mask &= model.cells[at // 8][langid._cell(held[name].astype(np.uint32), probe, plan.cells_log2)]
        assert ((mask >> (at % 8)) & 1).all()


def test_language_of_odd_rows(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, "doc_id", "text", "lang")
    got = {row["id"]: row for row in langid.predict(odd, "doc_id", "text", model).collect()}
    assert [got[k]["lang_pred"] for k in (0, 1, 2, 6, 7)] == ["und"] * 5 and got[0]["score"] == 0
    assert got[5]["lang_pred"] == "en" and got[5]["score"] == 0 and got[5]["n_grams"] == 0
    assert got[8]["lang_pred"] == "en" and got[10]["lang_pred"] != "und"
    kept = langid.keep(odd, "text", model, 20, 0.2)
    assert kept.columns == odd.columns and not {0, 1, 2, 6, 7} & {row["doc_id"] for row in kept.collect()}
    assert {5, 8, 9, 11} <= {row["doc_id"] for row in kept.collect()}
    blank = langid.train(none, "doc_id", "text", "lang")
    assert {row["lang_pred"] for row in langid.predict(odd, "doc_id", "text", blank).collect()} == {"und"}
    assert langid.keep(odd, "text", blank, 20, 0.2).count() == odd.count()
    assert langid.predict(none, "doc_id", "text", model).count() == 0


def auc(marks, scores):
    order = np.argsort(np.argsort(scores))
    n1 = marks.sum()
    return (order[marks].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(marks) - n1))


def test_quality_of_held_out_texts(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.quality_scores(spark, SF)
    assert got.count() == 1000
    held = got.join(labels, "doc_id").where("held_out").toPandas()
    assert set(held["doc_id"].map(lambda key: rest(key, 5))) == {0}
    assert auc((held["quality"] == 1).to_numpy(), held["score"].to_numpy()) > 0.97
    assert (held["predicted"] == held["quality"]).mean() > 0.95


def test_only_positives_and_unlabelled_rows_matter(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    plan = quality.Plan(epochs=2, prior=0.8)
    full = quality.train(docs, labels, "doc_id", "text", "quality", plan)
    bare = quality.train(docs, labels.where("quality = 1"), "doc_id", "text", "quality", plan)
    assert all(np.array_equal(a, b) for a, b in zip(full.weights, bare.weights))


def test_prior_is_near_the_share_of_positives():
    rng = np.random.default_rng(3)
    unlabelled = np.concatenate((rng.normal(2, 1, (1400, 3)), rng.normal(-2, 1, (600, 3))))
    x = np.concatenate((rng.normal(2, 1, (800, 3)), unlabelled))
    assert abs(quality.estimate_prior(x, np.arange(2800) < 800, quality.Plan()) - 0.7) < 0.08


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(8, 1), (9, 1), (9, 0), (None, 1), (3, None), (4, 1), (77, 1)], "doc_id long, quality int")
    network = quality.train(odd, labels, "doc_id", "text", "quality", quality.Plan(epochs=2))
    got = quality.score(odd, "doc_id", "text", network).collect()
    assert len(got) == odd.count() and all(0 <= row["score"] <= 1 for row in got)
    assert quality.train(none, labels, "doc_id", "text", "quality") is None
    assert quality.train(odd, labels.limit(0), "doc_id", "text", "quality") is None
    assert {row["score"] for row in quality.score(odd, "doc_id", "text", None).collect()} == {0.5}
    assert quality.keep(odd, "text", None, 0.3).count() == odd.count()
    scores = [(row["id"], row["score"]) for row in got]
    kept = quality.keep(odd, "text", network, 0.3)
    assert kept.columns == odd.columns and kept.count() == sum(score >= 0.3 for _, score in scores)
    assert quality.score(none, "doc_id", "text", network).count() == 0


def test_features_do_not_depend_on_neighbours():
    texts = ["", "One two two three.", "A | b | c\nd", "ÀÉ!!! XX", "x" * 3000, "the cat " * 50]
    alone = [quality.features(*quality.flat.utf8(pa.array([text])))[0] for text in texts]
    together = quality.features(*quality.flat.utf8(pa.array(texts)))
    assert np.allclose(alone, together) and np.isfinite(together).all()


def test_samples_are_bounded_and_repeatable(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 3 == 0).alias("label"))
    chosen, counts = sample.per_class(rows, "id", "label", 500)
    got = chosen.groupBy("label").count().collect()
    assert counts == {True: 6667, False: 13333} and all(400 < row["count"] < 600 for row in got)
    again = sample.per_class(rows.repartition(7), "id", "label", 500)[0]
    assert chosen.exceptAll(again).count() == 0


PARAGRAPH = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore. "


@pytest.mark.parametrize("page, want", [
    ("<p>a <b>b</b>c<br>d<p>e &amp; f&copy g</p><div>x</p>y</div><p", ["a bc d", "e & f© g", "x", "y"]),
    ('<ul><li>1<li>2 <a href="x">l</a></ul>t < 5 <x-y>cu</x-y> <a href="/The', ["1", "2 l", "t < 5 cu"]),
    ('<script>var t="</p>";</script>z<!-- c --><title>no</title>k<style>p{}', ["zk"]),
    ("<div><p>a<div class=ad>ad</div>tail</div>end", ["a", "ad", "tail", "end"]),
    ("&lt;b&gt; &#233;&#x1F600; &nbsp; &unknown; &am", ["<b> é\U0001f600 &unknown; &am"]),
    ('<a title="x > y">l</a><p class="open>t</p>', ["l", "t"]),
    ("<!-- never closed <p>x</p>", []), ("", []), (None, []), (" \n ", []), ("<", ["<"]), ("a" * 100_000, ["a" * 100_000]),
    ("<div>" * 3000 + "deep", ["deep"]),
    ("<p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> is</p><xmp>a <b> &amp; c</xmp>t", ["Energy E=m is", "a <b> &amp; c", "t"]),
    ("<p>one <script>x('<p>')</script> two <style>p{}</style>three</p>", ["one two three"]),
    ("<p>a <svg><title>icon</title><text>label</text></svg> b</p><noscript><p>shown</p></noscript>", ["a label b", "shown"]),
    ("<p>" + "<b>" * 200 + "x<div>y</div>", ["x", "y"]),
])
def test_blocks(page, want):
    found = [block.text for block in blocks(page)]
    assert found == want or (want == ["zk"] and found == ["z", "k"])


@pytest.fixture(scope="module")
def extracted(spark):
    return queries.main_text(spark, SF).collect()


def test_main_text_is_the_article(spark, extracted):
    pages = {row["page_id"]: row for row in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(extracted) == len(pages)
    for row in extracted:
        want = [block.text for block in blocks(pages[row["page_id"]]["html"]) if "article" in block.path]
        assert row["text"] == "\n\n".join(want) and row["n_chars"] == len(row["text"]) and row["url"] == pages[row["page_id"]]["url"]


def layouts():
    """Hand-marked pages: the blocks of the article, in order, and the page around them."""
    long = (PARAGRAPH * 2).strip()
    site = '<nav><a href="/">Home</a><a href="/b">About</a></nav>{}<footer>© 2021 Some company</footer>'
    yield ["Title", "By Ann", long, "Year", "Degrees", "1990", "11", long], site.format(
        f"<article><header><h1>Title</h1><p>By Ann</p></header><p>{long}</p><table><tr><th>Year</th><th>Degrees</th></tr>"
        f"<tr><td>1990</td><td>11</td></tr></table><p>{long}</p></article>"
    )
    yield ["Title", long, "A caption", long], site.format(f"<main><h1>Title</h1><p>{long}</p><figure><img><figcaption>A caption</figcaption></figure><p>{long}</p></main>")
    teasers = "".join(f'<li><a href="/{k}">Another story {k}</a></li>' for k in range(4))
    yield ["Title", long, long], site.format(f"<main><article><h1>Title</h1><p>{long}</p><p>{long}</p></article></main><section><h2>You may also like</h2><ul>{teasers}</ul></section>")
    yield ["Title", long, "first item", "second item", long], site.format(f"<article><h1>Title</h1><p>{long}</p><ol><li>first item</li><li>second item</li></ol><p>{long}</p></article>")
    yield ["Title", f"The law E=m holds. {long}", "x = 1", long], site.format(f"<article><h1>Title</h1><p>The law <math><mi>E</mi>=<mi>m</mi></math> holds. {long}</p><pre>x = 1</pre><p>{long}</p></article>")
    yield ["Title", long, "A quoted line.", long], site.format(f'<div class="ad">Buy now</div><div class="post"><h1>Title</h1><p>{long}</p><blockquote>A quoted line.</blockquote><p>{long}</p></div>')
    yield ["Title", long, long], site.format(f'<div class="cookie-notice">We use cookies.</div><article><h1>Title</h1><p>{long}</p><aside><h3>Popular</h3><p>Other things</p></aside><p>{long}</p></article>')
    comments = "".join(f'<div class="comment"><b>Bob</b><p>{PARAGRAPH}</p></div>' for _ in range(3))
    yield ["Title", long, "Part two", long], site.format(f'<article><h1>Title</h1><p>{long}</p><h2>Part two</h2><p>{long}</p></article><section class="comments" id="comments"><h2>3 comments</h2>{comments}</section>')


def test_hand_marked_layouts(spark):
    model = blocklabel.train(spark.read.parquet(f"{SF}/pages.parquet"), "page_id", "html")
    pages = list(layouts())
    found = blocklabel.main_texts([page for _, page in pages], model, blocklabel._Bins())
    assert len(pages) == 8
    assert [(at, text) for at, ((want, _), text) in enumerate(zip(pages, found)) if text != "\n\n".join(want)] == []


def test_pages_of_other_makes(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = blocklabel.train(pages, "page_id", "html")
    junk = (
        '<header><a href="/">Site</a></header><nav><a>Home</a><a>About</a></nav><div class="cookie-notice"><p>We use cookies.</p></div>{}'
        f'<aside class="sidebar"><h3>Popular</h3><p>{PARAGRAPH}</p></aside><section class="comments"><h2>Comments</h2>'
        f'<div class="comment"><p>Bob</p><p>{PARAGRAPH}</p></div></section><form><input><button>Send</button></form><footer>© 2020</footer>'
    )
    article = f'<h1>Title here</h1><p>{PARAGRAPH}</p><div class="ad">Buy now</div><p>{PARAGRAPH * 3}</p><p>Short end.</p>'
    want = "\n\n".join(["Title here", PARAGRAPH.strip(), (PARAGRAPH * 3).strip(), "Short end."])
    for shell in ("<article>{}</article>", "<main>{}</main>", '<div id="content">{}</div>', '<div class="post"><section>{}</section></div>'):
        made = spark.createDataFrame([(1, None, junk.format(shell.format(article)))], "page_id long, url string, html string")
        assert blocklabel.extract(made, "page_id", "url", "html", model).first()["text"] == want
    odd = spark.createDataFrame(
        [(None, "u", None), (2, None, ""), (2, None, ""), (3, "u", "<html></html>"), (4, "u", f"<article>{PARAGRAPH * 2000}</article>")],
        "page_id long, url string, html string",
    ).withColumn("text", F.lit("clash"))
    got = blocklabel.extract(odd, "page_id", "url", "html", model).collect()
    assert sorted(row["n_chars"] for row in got) == [0, 0, 0, 0, len((PARAGRAPH * 2000).strip())]
    assert blocklabel.extract(odd.limit(0), "page_id", "url", "html", model).count() == 0
    assert blocklabel.train(odd.limit(0), "page_id", "html", blocklabel.Plan(epochs=1)) is not None


def test_gradients_of_the_network():
    rng = np.random.default_rng(2)
    pages = [blocks(f"<article><p>{'word ' * k}</p><p>b</p></article><footer>c</footer>") for k in (1, 3, 8)]
    ids, counts, dense = blocklabel.page_features(pages[:2] + [pages[2][:1]], blocklabel._Bins())
    lengths, marks, h = [3, 3, 1], np.array([1, 1, 0, 1, 1, 0, 1.0]), 3
    weights = [
        rng.normal(0, 0.3, (blocklabel.PATH_BINS, 8 * h)), rng.normal(0, 0.3, (blocklabel.DENSE, 8 * h)),
        rng.normal(0, 0.5, (h, 4 * h)), rng.normal(0, 0.5, (h, 4 * h)), rng.normal(0, 0.5, 2 * h + 1),
    ]

    def loss(w):
        model = blocklabel.Model(w[0], w[1], (w[2], w[3]), w[4])
        z = blocklabel.logits(model, blocklabel._project(model, ids, counts, dense.astype(float)), lengths)
        return np.mean(np.logaddexp(0, z) - marks * z)

    grads = blocklabel._gradients(weights, ids, counts, dense.astype(float), lengths, marks)
    for k, grad in enumerate(grads):
        for place in list(zip(*np.nonzero(np.abs(grad) > 1e-4)))[:6]:
            moved = [w.copy() for w in weights]
            moved[k][place] += 1e-5
            assert abs((loss(moved) - loss(weights)) / 1e-5 - grad[place]) < 1e-3 * max(1, abs(grad[place]))
