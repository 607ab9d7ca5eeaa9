import itertools
import re

import numpy as np
import pytest

from harborline.llm import html_text as H


def page(i, tag="article", comments=""):
    body = "".join(f"<p>Sentence {j} of page {i}, with a comma. It goes on &amp; on, for a while.</p>" for j in range(4))
    return (
        f"<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        f"<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About</a></li></ul></nav><!-- ad --><div class='ad'>Buy now.</div>"
        f"<{tag}><h1>Title {i}</h1>{body}{comments}</{tag}><footer>&copy; site {i}</footer></body></html>"
    )


def wanted(i):
    return "\n\n".join(
        [f"Title {i}"] + [f"Sentence {j} of page {i}, with a comma. It goes on & on, for a while." for j in range(4)]
    )


@pytest.fixture(scope="module")
def model(spark):
    pages = spark.createDataFrame([(i, page(i)) for i in range(60)], "page_id long, html string")
    return H.fit(pages)


def test_marked_and_unmarked_articles(spark, model):
    rows = [(i, f"u{i}", page(i)) for i in range(5)] + [(i, None, page(i, "div")) for i in range(5, 10)]
    rows += [(20, "u", page(20, comments="<section id='comments'><p>I like it, a lot. Thank you, all.</p></section>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = {r.page_id: r for r in H.extract(df, model).collect()}
    for i, url, _ in rows:
        assert got[i].text == wanted(i) and got[i].url == url and got[i].n_chars == len(wanted(i))


def test_awkward_pages(spark, model):
    rows = [(1, None), (2, ""), (3, "   "), (None, "<article><p>x &lt;y&gt; z</p></article>"), (4, "<article><p>cut of"), (4, "<p"), (5, "<")]
    rows += [(6, "<div>" * 3000 + "<article><p>Deep, but there. It is text.</p></article>"), (7, "<!-- open <p>no</p>")]
    rows += [(8, "<article><p>one<p>two<br>three <b>bold<i>er</b> end</article></div></div>"), (9, page(9) * 40)]
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(df.where("page_id is null or page_id != 4"), model).collect()}
    assert got[1] == got[2] == got[3] == got[7] == "" and got[None] == "x <y> z"
    assert got[6] == "Deep, but there. It is text."
    assert got[8] == "one\n\ntwo three bolder end"
    assert got[9].count("Title 9") == 40
    assert {r.text for r in H.extract(df.where("page_id = 4"), model).collect()} == {"cut of", ""}
    assert H.extract(df.limit(0), model).count() == 0


P = "<p>Sentence {} of the page, with a comma. It goes on, and on, for a while.</p>"
PARTS = {
    "title": "<div class='entry-header'><h1>The title of it</h1></div>",
    "heading": P.format(1) + "<h2 id='side-effects'>Side effects</h2>" + P.format(2),
    "section": "<section id='legal-framework'><h2>Law, in short</h2>" + P.format(3) + P.format(4) + "</section>",
    "notice": "<h2 id='related'>Related</h2><div class='notice'><p>Mind the gap, please. It is wide, and deep. Do not fall, "
    "and hold on to what stands near, as it is firm, mostly.</p></div>",
    "list": "<ul class='social-studies'><li>Schools, and what they teach.</li><li>Pupils, and what they learn.</li></ul>",
}
BODY = "".join(PARTS.values())


def around(open_, inner, close):
    return (
        f"<nav><ul><li><a href='/a'>Home</a></li></ul></nav><div class='ad'>Buy now.</div>{open_}{inner}{close}"
        "<div class='sidebar'><p>Look here, too.</p></div><footer>of the site</footer>"
    )


def plain(source):
    return " ".join(re.sub("<[^>]*>", " ", source).split())


@pytest.mark.parametrize("tag", ["article", "div"])
@pytest.mark.parametrize(
    "open_, close",
    [
        ("<body class='no-sidebar menu-open'>", "</body>"), ("<div class='has-menu'>", "</div>"), ("<div id='menu-layout'>", "</div>"),
        ("<div class='sidebar-left'>", "</div>"), ("", ""),
    ],
)
@pytest.mark.parametrize("own", [False, True])
def test_names_do_not_decide(model, tag, open_, close, own):
    source = open_ + around(f"<{tag}>", BODY, f"</{tag}>") + close
    if own:  # fitted on such pages themselves
        model = H.fit_pages([open_ + around("<article>", BODY.replace("page", f"page {i}"), "</article>") + close for i in range(30)])
    assert " ".join(H.extract_block([source], model)[0].split()) == plain(BODY)


def test_asides_by_name(model):
    inner = BODY + "<div class='related-posts'><p>Other page, here.</p></div><div id='comments'><p>I like it, a lot.</p></div>"
    for tag in ("article", "div"):
        assert " ".join(H.extract_block([around(f"<{tag}>", inner, f"</{tag}>")], model)[0].split()) == plain(BODY)


def test_long_sections_and_headers_of_articles(model):
    inner = "<div class='header'><h1>The title of it</h1></div>" + P.format(0) + "<section id='legal'>" + P.format(1) * 9 + "</section>"
    assert " ".join(H.extract_block([around("<article>", inner, "</article>")], model)[0].split()) == plain(inner)


def test_states_left_open_follow_from_the_given_ones():
    trees = H.Trees()
    H.parse(trees, 0, "<div><p>a, b.</p><ul><li>c</li></ul></div><footer>f</footer>")
    nodes = H.nodes_of(trees)
    rng = np.random.default_rng(0)
    model = H.Model([rng.normal(size=n) for n in H.FAMILIES], rng.normal(size=(2, 2, 2)))
    truth = rng.integers(-1, 2, len(nodes.page))
    beliefs, _ = model.marginals(nodes, truth)
    odds = sum(w[f] for w, f in zip(model.weights, nodes.features))
    total, norm = np.zeros(len(truth)), 0.0
    for states in itertools.product((0, 1), repeat=len(truth)):
        if all(t < 0 or s == t for s, t in zip(states, truth)):
            below = [i for i in range(len(truth)) if nodes.parent[i] >= 0]
            edges = sum(model.edges[int(nodes.leaf[i]), states[nodes.parent[i]], states[i]] for i in below)
            value = np.exp(np.dot(odds, states) + edges)
            norm += value
            total += value * np.array(states)
    assert np.allclose(1 / (1 + np.exp(np.clip(beliefs[:, 0] - beliefs[:, 1], -50, 50))), total / norm)


def test_without_labelled_pages(spark):
    none = spark.createDataFrame([(1, "u", "<div class='sidebar'>Links, more.</div><p>Some text, of course.</p>")], "page_id long, url string, html string")
    assert H.extract(none, H.fit(none)).first().text == "Some text, of course."


def shown(source):
    trees = H.Trees()
    H.parse(trees, 0, source)
    return " | ".join(t for t in trees.text if t)


@pytest.mark.parametrize(
    "attributes",
    [
        ' href="/hidden-costs"', ' title="The hidden life"', ' data-hidden="false"', " data-title='a hidden=b'", ' hidden-x="1"',
        ' alt="style=display:none"', ' style="--x: display; display:block"', ' aria-hidden="false"', ' data-role="dialog" title=a"hidden"',
    ],
)
def test_only_attributes_hide(attributes):
    assert shown(f"<article><p>a <a{attributes}>b</a> c</p><div{attributes}>d</div></article>") == "a b c | d"


@pytest.mark.parametrize(
    "attributes", [" hidden", ' HIDDEN=""', " class=x hidden/", ' style="color:red; display : NONE"', " aria-hidden=true", " style='display&#58;none'"]
)
def test_real_attributes_hide(attributes):
    assert shown(f"<article><p>a <a{attributes}>b</a> c</p><div{attributes}>d<div>e</div></div></article>") == "a c"


@pytest.mark.parametrize(
    "source, text",
    [
        ("<p hidden>a<p>b", "b"),
        ("<p hidden>a <i>x<p>b</p>", "b"),
        ("<p hidden>a<div>b</div>", "b"),
        ("<div><p hidden>a</div>b", "b"),
        ("<p>a <span hidden>x<p>b", "a | b"),
        ("<ul><li hidden>a<ul><li>x<li>y</ul>z<li>b</ul>c", "b | c"),
        ("<ul><li>a<div hidden>x<li>b</ul>", "a | b"),
        ("<dl><dt hidden>a<dd>b<dt>c</dl>", "b | c"),
        ("<table><tr hidden><td>a<td>x<tr><td>b</table>c", "b | c"),
        ("<table><tbody hidden><tr><td>a<tbody><tr><td>b</table>c", "b | c"),
        ("<table><tr><td hidden>a<table><tr><td>x</table>y<td>b</table>c", "b | c"),
        ("<div hidden><p>a<p>b<ul><li>c<li>d</ul><table><tr><td>e</div>f</table></div>g", "g"),
        ("<div hidden><svg><p></svg></section><p>a</div>g", "g"),
        ("a <ruby>b<rt hidden>c<rt>d<rp hidden>)</ruby> e", "a bd e"),
        ("<head><title>T</title><meta x><article>a</article>", "a"),
        ("<head><title>T</title>text", "text"),
    ],
)
def test_end_tags_left_out_in_hidden_parts(source, text):
    assert shown(source) == text


def test_sum_product_against_enumeration():
    trees = H.Trees()
    H.parse(trees, 0, "<div><p>a, b.</p><ul><li>c</li></ul></div><footer>f</footer>")
    H.parse(trees, 1, "<p>z</p>")
    nodes = H.nodes_of(trees)
    rng = np.random.default_rng(0)
    model = H.Model([rng.normal(size=n) for n in H.FAMILIES], rng.normal(size=(2, 2, 2)))
    n = len(nodes.page)
    odds = sum(w[f] for w, f in zip(model.weights, nodes.features))
    total = np.zeros(n)
    norm = 0.0
    for states in itertools.product((0, 1), repeat=n):
        value = sum(odds[i] for i in range(n) if states[i])
        value += sum(
            model.edges[int(nodes.leaf[i]), states[nodes.parent[i]], states[i]] for i in range(n) if nodes.parent[i] >= 0
        )
        norm += np.exp(value)
        total += np.exp(value) * np.array(states)
    assert np.allclose(model.content(nodes), total / norm)
