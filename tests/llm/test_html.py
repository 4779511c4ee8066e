import itertools
import math
import random
import time

import numpy as np
import pytest

from maskframe.llm import html_extract as H


@pytest.fixture(scope="module")
def model():
    return H.train()


def text(model, html):
    return H.extract([html], model)[0]


def test_article(model):
    page = '<html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href=x>News</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div><article><h1>A title &amp; more</h1><p><b>First   words\nof it.<br><p>Second one is here, and it is long enough.</p></article><footer>&copy; site &middot; All of it.</footer></body></html>'
    assert text(model, page) == "A title & more\n\nFirst words of it.\n\nSecond one is here, and it is long enough."


def test_defined_cases(model):
    assert H.extract([None, "", "hello", "<p>a &lt;b&gt; <c", "<" * 9], model) == ["", "", "hello", "a <b> <c", "<" * 9]
    assert text(model, "<div>" * 3000 + "deep text here." + "</div>" * 3000) == "deep text here."


def test_held_out_pages(model):
    hit = wrong = missed = 0
    for i in range(120):
        nodes, y = H.labels(H.listed(H.parse(H.Layout(random.Random(77_000_000 + i)).page())))
        kept = H.decode(nodes, model.log_odds(H.features(nodes)))
        index = {id(n): k for n, k in zip(nodes, kept, strict=True)}
        assert all(index[id(n.parent)] for n, k in zip(nodes, kept, strict=True) if k and n.parent)
        for n, want, got in zip(nodes, y, kept, strict=True):
            if n.tag == "#":
                hit += len(n.text) * (want and got)
                wrong += len(n.text) * (got and not want)
                missed += len(n.text) * (want and not got)
    assert hit / (hit + wrong) > 0.98 and hit / (hit + missed) > 0.97


def test_decoding_is_the_likeliest_of_all_labellings():
    r = random.Random(2)
    for _ in range(60):
        root = H.Node("#root", frozenset(), False, None)
        nodes = [root]
        for _ in range(r.randint(0, 8)):
            nodes.append(H.Node("div", frozenset(), False, r.choice(nodes)))
        nodes = H.listed(root)
        odds = np.array([r.gauss(0, 2) for _ in nodes])
        parent = [next((i for i, x in enumerate(nodes) if x is n.parent), None) for n in nodes]
        allowed = [y for y in itertools.product([True, False], repeat=len(nodes)) if y[0] and all(not k or p is None or y[p] for k, p in zip(y, parent, strict=True))]
        value = lambda y: sum(-math.log1p(math.exp(-o if k else o)) for k, o in zip(y[1:], odds[1:].tolist(), strict=True))  # noqa: E731, B023
        got = H.decode(nodes, odds)
        assert tuple(got) in allowed and value(got) == pytest.approx(max(map(value, allowed)))


@pytest.mark.parametrize(
    "unit", ["<a ", "<a '", "<a \"<b>", "<head>", "<head><p>x", "</zz>", "<ul>", "<li>", "<div></zz>", "<td><div>", "<!-", "<!--", "<p", "&amp", "<script>", "<svg/>", "<p><button><ul>", "x<y> \"' ", "<a b=\"c' >"]
)
def test_hostile_pages_take_linear_time(model, unit):
    page = "<div>" * 1000 + unit * (1_000_000 // len(unit) // 4)
    began = time.time()
    H.extract([page], model)
    assert time.time() - began < 30


def test_rows(spark, model):
    df = spark.createDataFrame([(1, "u", "<p>x y</p>", 9), (1, "u", "<p>x y</p>", 9), (None, None, None, 9)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, H.main_text(df, model).collect()), key=str) == [(1, "u", "x y", 3), (1, "u", "x y", 3), (None, None, "", 0)]
    assert H.main_text(df.where("false"), model).count() == 0
