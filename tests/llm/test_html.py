"""Main text of pages, on templates with known articles and on broken markup."""

import html as html_
import json
import random

from causeway.llm import html


def page(r, host, n):
    para = lambda: " ".join(r.choice(["alpha", "beta & gamma", "delta", "x < y", "é"]) for _ in range(r.randrange(5, 20)))
    blocks = [para() for _ in range(r.randrange(1, 6))]
    items = "".join(f'<li><a href="/{i}">{para()}</a></li>' for i in range(r.randrange(2, 6)))
    side = '<aside><p>more</p></aside>' if r.random() < 0.5 else ""
    body = "".join(f"<p>{html_.escape(b)}</p>" for b in blocks)
    markup = f"""<!DOCTYPE html><html><head><title>t</title><script>var a = "</p>";</script></head><body><header><h1>Site</h1></header><nav><ul>{items}</ul></nav>
      <div class="ad">buy</div><{host[1]}>{body}</{host[1]}>{side}<div id="comments"><p>first!</p></div><form><p>name</p></form><footer>&copy; {host[0]}</footer></body></html>"""
    return n, f"http://{host[0]}/p/{n}", markup, "\n".join(" ".join(b.split()) for b in blocks)


def test_articles(spark):
    r = random.Random(3)
    hosts = [("a.example", "article"), ("b.example", "main"), ("c.example:80", "div")]
    made = [page(r, hosts[n % 3], n) for n in range(40)]
    rows = [(n, u, m, "x") for n, u, m, _ in made] + [made[0][:3] + ("x",), (100, None, None, "x"), (101, "http://a.example/", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    got = html.main_text(pages).collect()
    assert len(got) == len(rows)
    want = {n: t for n, _, _, t in made} | {100: "", 101: ""}
    assert {x.page_id: x.text for x in got} == want
    assert all(x.n_chars == len(x.text) for x in got)
    assert html.main_text(pages.filter("false")).collect() == []


def test_many_streams_of_a_host(spark, monkeypatch):
    """Alignment in several rounds covers what all pages have, and changes no text."""
    r = random.Random(4)
    made = [page(r, ("a.example", "article"), n) for n in range(40)]
    pages = spark.createDataFrame([x[:3] for x in made], "page_id long, url string, html string")
    monkeypatch.setattr(html, "ALIGNED", 4)
    assert {x.page_id: x.text for x in html.main_text(pages).collect()} == {n: t for n, _, _, t in made}
    whole = json.loads(html.wrappers(pages).first().expression)
    assert [(kind, label) for kind, label, _ in whole[0][2][0][2]] == [("", "*article")] and [(kind, label) for kind, label, _ in whole[0][2][0][2][0][2]] == [("+", "p")] or flat(whole) == [("", "html"), ("", "body"), ("", "*article"), ("*", "p"), ("", "#")] or flat(whole) == [("", "html"), ("", "body"), ("", "*article"), ("+", "p"), ("", "#")]


def flat(expression):
    return [x for kind, label, inside in expression for x in ((kind, label), *flat(inside))]


def texts(m):
    return [t for t, _ in html.parsed(m).texts()]


def test_broken_markup():
    assert texts("<p>a<p>b<ul><li>c<li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert texts("<article><p><b>x<br>y<p>z</article>tail") == ["x y", "z", "tail"]
    assert texts("<!-- <p>no</p> --><p title='a > b'>yes &amp; &#233;&nbsp;!") == ["yes & é !"]
    assert texts("<script>if (a < b) {}") == [] and texts("<p") == [] and texts("a </p> b") == ["a b"]
    assert texts("<div>" * 3000 + "deep" + "</div>" * 3000) == ["deep"]
    deep = "".join(f"<div>t{i}" for i in range(3000))
    assert texts(deep) == [f"t{i}" for i in range(3000)]
    items = html.fold(html.parsed(deep).inside)
    assert html.Wrapper(json.dumps(html.shape(items)), []).text(deep) == ""


def shape(markup):
    return html.shape(html.fold(html.parsed(markup).inside))


def test_expressions():
    a, b = shape("<h1>a</h1><p>b</p><p>c</p><ul><li>d<li>e</ul>"), shape("<h1>a</h1><ul><li>d</ul><h2>x</h2>")
    p, li = ["#"], ["#"]
    assert flat(a) == [("", "h1"), ("", "#"), ("+", "p"), ("", "#"), ("", "ul"), ("+", "li"), ("", "#")] and p == li
    assert flat(html.align(a, b)) == [("", "h1"), ("", "#"), ("*", "p"), ("", "#"), ("", "ul"), ("+", "li"), ("", "#"), ("?", "h2"), ("", "#")]
    assert html.align(html.align(a, b), a) == html.align(a, b)
    # A run of two elements repeats, with one of them repeated in turn, and an optional list in one of its rounds.
    c = shape("<h2>a</h2><p>b</p><h2>c</h2><p>d</p><p>e</p><h2>f</h2><p><ul><li>g</ul><p>h</p>")
    assert flat(c)[0] == ("+", "(h2 p)") and flat(c[0][2]) == [("", "h2"), ("", "#"), ("+", "p"), ("", "#")]
    long_ = [f"<p>{i}</p><h{i % 5 + 1}>{i}</h{i % 5 + 1}>" for i in range(900)]
    whole = html.align(shape("".join(long_)), shape("".join(long_[::3])))
    for m in ("".join(long_), "".join(long_[::3])):
        w = html.Wrapper(json.dumps(whole))
        assert [t for _, t, _ in w.texts(html.fold(html.parsed(m).inside))] == texts(m)


def texts_of(spark, markups, host="a.example"):
    pages = spark.createDataFrame([(n, f"http://{host}/{n}", m) for n, m in enumerate(markups)], "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in html.main_text(pages).collect()}


def test_slots_decide(spark):
    """Where no element says what the article is, the slots do: what differs is its text, and what stands in one element with
    that is part of it, constant or not, like all that an article element holds."""
    inside = lambda n: f"<p>Filed under news</p><h1>Title {n}</h1>{'<p>Odd</p>' if n == 7 else ''}<p>body {n}</p>" + f"<p>more {n}</p>" * (n % 3) + "<h2>Background</h2><ul><li>always</li></ul><p>Support us</p>"
    want = {n: "\n".join(["Filed under news", f"Title {n}"] + (["Odd"] if n == 7 else []) + [f"body {n}"] + [f"more {n}"] * (n % 3) + ["Background", "always", "Support us"]) for n in range(9)}
    for lead, end in (("<article>", "</article>"), ("<div>", "</div>"), ("<div class='post'>", "</div>"), ("<div id='page'><div class='x1'>", "</div></div>"), ("<section><main>", "</main></section>")):
        page = lambda n: f"<body><p>Our site</p>{lead}{inside(n)}{end}<div><p>Imprint</p></div><p>All rights</p></body>"  # noqa: B023, E731
        assert texts_of(spark, [page(n) for n in range(9)]) == want, lead
    # The same element is template on one host and text on another.
    assert texts_of(spark, [f"<div class='left'><p>same</p></div><div class='right'><p>own {n}</p></div>" for n in range(3)]) == {n: f"own {n}" for n in range(3)}
    assert texts_of(spark, [f"<div class='right'><p>same</p></div><div class='left'><p>own {n}</p></div>" for n in range(3)]) == {n: f"own {n}" for n in range(3)}
    assert texts_of(spark, ["<article><p>same</p></article><p>a</p>", "<article><p>same</p></article><p>b</p>"]) == {0: "same", 1: "same"}


def test_four_pages_with_a_constant_heading(spark):
    page = lambda n: f"<div class='post'><h1>Head {n}</h1><p>first {n}</p><h2>Background</h2><p>second {n}</p></div>"
    assert texts_of(spark, [page(n) for n in range(4)]) == {n: f"Head {n}\nfirst {n}\nBackground\nsecond {n}" for n in range(4)}


def test_match():
    expression = [["?", "b", []], ["", "a", []], ["?", "b", []], ["*", "b", []], ["?", "c", []]]
    assert html.match([("a", False), ("b", True)], expression) == [1, 3]
    assert html.match([("a", False), ("b", False)], [["?", "a", []], ["?", "b", []], ["?", "a", []], ["", "b", []]]) == [0, 3]
    r = random.Random(5)

    def made(depth):
        return "".join(r.choice([f"<div>{made(depth - 1)}</div>", "<p>t</p>", "<ul><li>x</li><li>y<p>z</p></li></ul>", "word <br>"]) for _ in range(r.randrange(1, 5))) if depth else "end"

    pages = [made(3) for _ in range(40)]
    whole = shape(pages[0])
    for m in pages[1:]:
        whole = html.align(whole, shape(m))
    w = html.Wrapper(json.dumps(whole))
    for m in pages:
        found = w.texts(html.fold(html.parsed(m).inside))
        assert [t for _, t, _ in found] == texts(m)
        own = html._slot_texts(html.fold(html.parsed(m).inside), shape(m))
        seen = {}
        for slot, t, _ in found:
            seen.setdefault(slot, []).append(t)
        assert {s: [t for t, _ in x] for s, x in zip(w.slots(json.dumps(shape(m))), own, strict=True)} == seen


def test_templates_of_a_host(spark):
    """A page with an article does not empty the pages of the host that have none."""
    got = texts_of(spark, ["<article><p>one</p></article><p>tail</p>"] + [f"<div class='content'><p>body {n}</p></div><p>imprint</p>" for n in range(4)])
    assert got == {0: "one"} | {n + 1: f"body {n}" for n in range(4)}


def test_copies_and_late_differences(spark):
    """Copies of a page are one page, and texts that differ late differ."""
    alone = "<h1>Title</h1><div class='content'><p>body</p></div>"
    assert texts_of(spark, [alone] * 3) == {n: "Title\nbody" for n in range(3)}
    assert texts_of(spark, [alone, "<nav>menu</nav>" + alone]) == {n: "Title\nbody" for n in range(2)}
    late = [f"<div class='content'><p>{'x' * 300}{n}</p></div><h2>ours</h2>" for n in range(4)]
    assert texts_of(spark, late) == {n: "x" * 300 + str(n) for n in range(4)}


def test_class_words():
    """Class words do not outrank articles, what holds them, and classes of content."""
    for name in ("site-content has-sidebar", "layout no-sidebar", "post comments-open", "article-content social", "header-fixed page", "nav-wrap"):
        for m in (f"<div class='{name}'><article><p>x</article></div>", f"<article class='{name}'><p>x</article>", f"<div class='{name}'><div><main><p>x</main></div></div>"):
            assert texts(m) == ["x"], m
        assert name == "nav-wrap" or texts(f"<div class='{name}'><p>x</div>") == ["x"], name
    assert texts("<article><header class='entry-header'><h1>head</h1></header><p>x<div class='comments-area'>no</div></article>") == ["head", "x"]
    assert texts("<div class='sidebar'><article>card</article></div><main>x<div class='related'><article>card</article></div></main>") == ["x"]
    # Inside an article, a related section is text unless it is mostly links.
    assert texts("<article><p>x</p><div class='related'><h2>Related work</h2><p>Smith showed this.</p></div><div class='related'><a href='/'>more</a></div><div class='ads'>buy</div></article>") == ["x", "Related work", "Smith showed this."]
    for name in ("ad", "site-footer", "comments", "sidebar left", "cookie-notice", "main-menu", "page-header"):
        assert texts(f"<div class='{name}'><p>no</div><p>x") == ["x"], name
