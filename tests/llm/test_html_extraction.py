import random

import numpy as np
import pytest

from reviewlake.llm import html_blocks as B
from reviewlake.llm import html_extraction as H

P = ["The council approved the new harbour plan on Monday after two years of debate.", "Work is to begin in spring, and the first ships should dock a year later.",
     "Critics said the cost, now put at ninety million, had doubled since the first draft."]
BODY = "\n".join(P)


@pytest.fixture(scope="module")
def model(spark):
    return H.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def extracted(weights, page):
    bs = B.blocks(page)
    p = H.Labeller.load(weights).chances([H.Figures().page(bs)])[0] if bs else []
    return "\n".join(b.text for b, x in zip(bs, p) if x >= 0.5)


def paragraphs(extra=""):
    return "".join(f"<p>{x}</p>{extra if i == 0 else ''}" for i, x in enumerate(P))


PAGES = {
    "semantic": f"<body><header><a href='/'>The Record</a></header><nav><ul><li><a href='/a'>News</a><li><a href='/b'>Sport</a></ul></nav><main>{paragraphs()}</main>"
                "<aside><h3>Most read</h3><ul><li><a href='/c'>Ten quiet beaches</a></li></ul></aside><footer>&copy; 2024 The Record</footer></body>",
    "classes": f"<body><div id=cookie-banner>We use cookies to improve your visit. <a href=#>Accept</a></div><div class='main-menu'><a href=/>Home</a> <a href=/x>News</a></div>"
               f"<div class='entry-content'>{paragraphs()}</div><div id='sidebar'><h4>Related</h4><p>Boats sold at record prices this year.</p></div>"
               "<div id='comments'><h3>2 comments</h3><div class=comment><b>Ann</b><p>About time too, the old pier was falling down.</p></div></div></body>",
    "inside": f"<body><nav><a href=/>Home</a></nav><article>{paragraphs('<div class=advert>Sponsored: cheap flights from Monday.</div>')}<form><label>Your email</label><input>"
              "<button>Subscribe</button></form></article><footer>Imprint</footer>",
    "cut off": f"<html><body><nav><ul><li><a href='/a'>News</a></ul></nav><article>{paragraphs()}<script>var x = '<p>no</p>'",
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts_never_seen(model, name):
    assert extracted(model, PAGES[name]) == BODY


def test_held_out_layouts(model):
    rng, right, all_, net = random.Random(77), 0, 0, H.Labeller.load(model)
    for k in range(150):
        bs = B.blocks(B.dressed([*P, f"A further sentence, number {k}, closes the report."][k % 3:], rng))
        p = net.chances([H.Figures().page(bs)])[0]
        right += sum((x >= 0.5) == (b.label == "1") for b, x in zip(bs, p))
        all_ += len(bs)
    assert right / all_ > 0.96


def test_gradient_is_that_of_the_loss():
    rng, read, net = random.Random(1), H.Figures(), H.Labeller(hidden=5)
    both = [B.blocks(B.dressed(P[:k + 1], rng)) for k in range(3)]
    pages, labels = [read.page(bs) for bs in both], [np.array([float(b.label == "1") for b in bs]) for bs in both]
    _, grad = net.gradient(pages, labels)
    for name, w in net.w.items():
        flat, g = w.reshape(-1), grad[name].reshape(-1)
        for i in {int(np.abs(g).argmax()), 0, len(flat) - 1}:
            keep, e = flat[i], 1e-5
            flat[i] = keep + e
            up = net.gradient(pages, labels)[0]
            flat[i] = keep - e
            down = net.gradient(pages, labels)[0]
            flat[i] = keep
            assert g[i] == pytest.approx((up - down) / (2 * e), abs=1e-6), name


def test_pages_side_by_side_do_not_touch(model):
    net, read = H.Labeller.load(model), H.Figures()
    pages = [read.page(B.blocks(p)) for p in PAGES.values()]
    for one, p in zip(pages, net.chances(pages)):
        assert np.allclose(net.chances([one])[0], p, atol=1e-5)


@pytest.mark.parametrize("page, texts", [
    (None, []), ("", []), ("plain text &amp; more", ["plain text & more"]), ("a < b", ["a < b"]),
    ("<p>one<p>two</div>three", ["one", "two", "three"]), ("<p>a <b>bold</b>\n word<br>next&nbsp;&#233;</p>", ["a bold word next é"]),
    ("<ul><li>x<li>y</ul>z", ["x", "y", "z"]), ("<script>if (a < b) '</p>'</script>t<style>p{}</style>", ["t"]), ("<!-- <p>no</p> -->yes<!-- open", ["yes"]),
    ("<head><title>no</title>no<body>yes", ["yes"]), ("text <a href='x", ["text"]), ("<p title='a > b'>in</p>", ["in"]), ("<svg><text>no</text></svg>yes", ["yes"]),
    ("<textarea>no</textarea>", []), ("<DIV>Up</DIV><br/>per", ["Up", "per"]), ("<", ["<"]), ("</x></y>", []), ("<p>　 \t</p>", [])])
def test_blocks_of_a_page(page, texts):
    assert [b.text for b in B.blocks(page)] == texts


def test_paths_and_links():
    b = B.blocks("<div id='mainContent'><ul class='menu top-2'><li><a href=x>Home</a> it is")[0]
    assert b.path == (("div", (".main", ".content")), ("ul", (".menu", ".top")), ("li", ())) and b.linked == 4 and b.text == "Home it is"


def test_edges_and_whole_texts(spark, model):
    long = "<article>" + "".join(f"<p>{P[i % 3]} {i}</p>" for i in range(4000)) + "</article><footer>x</footer>"
    rows = [(1, "u", None, "a"), (2, None, "", "b"), (None, "u", PAGES["classes"], "c"), (3, "u", PAGES["semantic"], "d"), (3, "u", PAGES["semantic"], "d"),
            (4, "u", "<p></p>", None), (5, "u", long, "e"), (6, "u", "<div>" * 3000 + "deep", "f")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, H.extract(df, model).collect()), key=str)
    want = sorted(((i, u, t, len(t)) for i, u, t in ((i, u, extracted(model, h)) for i, u, h, _ in rows)), key=str)
    assert got == want and [x[3] for x in got if x[0] == 5] == [len("\n".join(f"{P[i % 3]} {i}" for i in range(4000)))]
    assert H.extract(df.where("false")).collect() == []


def test_without_an_article_element_stock_texts_train(spark):
    df = spark.createDataFrame([(1, "u", "<div>" + P[0] + "</div>")], "page_id long, url string, html string")
    assert H.fit(df) == H.fit(df.where("false"))
