"""Main text: reading of markup, the network's gradients, held-out accuracy, the test pages."""

from __future__ import annotations

import random
import re
import time
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import html_text as ht


def read(html):
    return ht.blocks_of(html, ht.Paths())[0]


def test_blocks():
    assert read("<p>a <b>b</b>c<p>d &amp; e&nbsp;f<br>g</p>h<ul><li>i<li>j</ul>") == ["a bc", "d & e f g", "h", "i", "j"]
    assert read("<script>var a='<p>x</p>'</script><style>p{}</style><!-- <p>no</p> --><title>t</title>x") == ["x"]
    assert read("a < b <p title='>'>c</p") == ["a < b", "c</p"]
    assert read("") == [] and read("<div></div> \n ") == [] and read("&lt;b&gt; \t z") == ["<b> z"]
    assert read("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert read("<script>never closed <p>x") == []
    deep = "<div>" * 3000 + "core" + "</div>" * 3000 + "<p>after"
    assert read(deep) == ["core", "after"]


TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(ht.RAW_TAGS) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/><\"']*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>", re.S | re.I)


def test_scanner_equals_one_expression():
    """The tokens of random rubbish are those of a single backtracking expression."""
    rng = random.Random(9)
    parts = ["<", ">", "<p", "</p>", "<a href=", '"', "'", " ", "/", "x", "<!--", "-->", "<script>", "</script >", "<b>", "</", "<!", "<?", "=", "<STYLE a", "\n", "title='>'", "<textarea-x>", "é"]
    for _ in range(4000):
        html = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 30)))
        want = [(m.start(), m.end(), bool(m["end"]), (m["tag"] or "").lower(), m["attrs"] or "") for m in TOKEN.finditer(html)]
        assert list(ht.Scanner(html)) == want, html


@pytest.mark.parametrize("piece", ["<a ", '<p title="', "<a", "<p title='", "<!", "</", "<!-- ", "<script ", "<x \"'", "<p a=\"'>", "<div class=", "<", "<a>\"<b '", "&", "<font>", "<div class='q'>"])
def test_a_page_of_a_megabyte_takes_seconds(piece):
    html = piece * (1_000_000 // len(piece))
    began = time.process_time()
    ht.blocks_of(html, ht.Paths())
    assert time.process_time() - began < 20


#: Pages as people write them: none of the forms that ``layout`` puts together; main text in order.
HAND_MADE = [
    ("""<!DOCTYPE html><html><head><title>Weather</title><meta charset=utf-8><style>p{}</style></head><body>
<table width=100%><tr><td bgcolor=#eee><a href=1>Start</a> | <a href=2>Maps</a> | <a href=3>Contact</a></td></tr>
<tr><td><main><font size=4><b>Snow in the hills</b></font><p>It snowed all night above the tree line, and the pass was shut at six.<p>Drivers
waited in the valley until the ploughs came through at noon.</main></td></tr><tr><td><small><footer>(c) 2003 The Valley Herald</footer></small></td></tr></table></body></html>""",
     ["Snow in the hills", "It snowed all night above the tree line, and the pass was shut at six.", "Drivers waited in the valley until the ploughs came through at noon."]),
    ("""<body><div role="banner"><a href="/">Home</a></div><nav><a href="/a">News</a><a href="/b">Sport</a></nav>
<article itemscope itemtype='http://schema.org/Article'><header><h1>Bread without a machine</h1></header>
<figure><img src=x alt="a loaf"><figcaption>A loaf from Tuesday.</figcaption></figure>
<p>Mix the flour &amp; water and wait an hour before you add the salt.</p><ol><li>Fold it four times.<li>Leave it cold overnight.</ol>
<blockquote>Good bread needs time more than work.</blockquote><aside class="advert">Buy our mixer!</aside><p>Bake it hot and let it cool.</p></article>
<section class="comments"><h3>2 comments</h3><p>Mine came out flat and I do not know why.</p></section><footer><p>All rights reserved</p></footer></body>""",
     ["Bread without a machine", "A loaf from Tuesday.", "Mix the flour & water and wait an hour before you add the salt.", "Fold it four times.",
      "Leave it cold overnight.", "Good bread needs time more than work.", "Bake it hot and let it cool."]),
    ("""<div id=wrap><div class="nav top"><ul><li><a href=/>Front</a></li><li><a href=/x>Archive</a></li></ul></div><div class="post main" id=content>
<h2>On the ferry</h2>We left before light.<br>The water was flat and grey.<p>Nobody spoke until the coast was out of sight.</p><hr>
<p>By noon we had seen three other boats.</p></div><div class="sidebar"><h4>Popular</h4><ul><li><a href=1>Ten lakes</a></li></ul></div>
<div class=footer>Imprint | Terms</div></div>""",
     ["On the ferry", "We left before light. The water was flat and grey.", "Nobody spoke until the coast was out of sight.", "By noon we had seen three other boats."]),
]


def test_hand_made_pages(model):
    right = total = 0
    for html, want in HAND_MADE:
        all_ = read(html)
        got = ht.extracted([html], model)[0].split("\n")
        assert all(t in all_ for t in want)
        right += sum((t in got) == (t in want) for t in all_)
        total += len(all_)
    assert right / total >= 0.85, (right, total)


def test_an_end_tag_finds_its_element_at_any_depth():
    for many in (0, 300, 5000):
        paths = ht.Paths()
        texts, at, _ = ht.blocks_of("<article>main" + "<font>x" * many + "</article><footer>below</footer><p>out", paths)
        assert len(texts) == 3 and texts[1:] == ["below", "out"]
        assert at[1:] == [paths.child(0, "footer", ""), paths.child(0, "p", "")]
        texts, at, _ = ht.blocks_of("<ul><li>one" + "<b>" * many + "<li>two</ul>end", paths)
        assert texts == ["one", "two", "end"] and at[0] == at[1] and at[2] == 0


def test_gradients():
    rng = np.random.default_rng(0)
    m = ht.Labeller()
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    seqs = [rng.standard_normal((n, ht.INPUT)) * 0.3 for n in (2, 4, 5)]
    x, mask = (a.astype(np.float64) for a in m.padded(seqs))
    y = (rng.random(mask.shape) > 0.5).astype(float)
    grad, _ = m._gradients(x, mask, y, mask)
    for k, g in grad.items():
        for _ in range(4):
            i = tuple(rng.integers(s) for s in m.w[k].shape)
            old, losses = m.w[k][i], []
            for e in (1e-4, -1e-4):
                m.w[k][i] = old + e
                losses.append(m._gradients(x, mask, y, mask)[1])
            m.w[k][i] = old
            assert abs((losses[0] - losses[1]) / 2e-4 - g[i]) < 1e-3 * max(1, abs(g[i])), k


@pytest.fixture(scope="module")
def model(spark, small_dir):
    return ht.train(ht.sample_pages(spark.read.parquet(f"{small_dir}/pages.parquet")))


def test_held_out_layouts(model):
    rng = np.random.Generator(np.random.PCG64(12345))
    paths = ht.Paths()
    right = total = 0
    for _ in range(200):
        texts, at, links = ht.blocks_of(ht.layout(rng, ht.PARAGRAPHS), paths)
        got = model.label([ht.inputs(texts, at, links, paths)])[0]
        keep = np.array([paths.keep[p] for p in at])
        right += int((got == keep).sum())
        total += len(keep)
    assert right / total > 0.97


def by_rule(html):
    """The test pages mark their article; its blocks are h1 and p."""
    body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = (" ".join(unescape(re.sub(r"<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(b for b in blocks if b)


def test_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("text", F.lit(1)).withColumn("extra", F.lit("e"))
    odd = spark.createDataFrame([(-1, "u", None, "e"), (-2, None, "", "e"), (None, "v", "plain", "e")], "page_id long, url string, html string, extra string")
    out = ht.main_text(pages.drop("text").unionByName(odd), model).collect()
    assert len(out) == 253
    for r in out:
        assert r.n_chars == len(r.text) and r.extra == "e"
        if r.page_id is not None and r.page_id >= 0:
            assert r.text == by_rule(r.html), r.page_id
    assert all(r.text == "" for r in out if r.page_id in (-1, -2))
    assert ht.main_text(pages.where("false")).count() == 0


def test_runs_do_not_depend_on_company(model):
    rng = np.random.Generator(np.random.PCG64(6))
    pages = [ht.layout(rng, ht.PARAGRAPHS) for _ in range(30)]
    assert ht.extracted(pages, model) == [ht.extracted([p], model)[0] for p in pages]
