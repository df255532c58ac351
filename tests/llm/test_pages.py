from tarn.llm import pages as P


def text(html, path=None):
    return P.Page(html).text(path)


def test_blocks_and_what_is_dropped():
    html = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad-slot ad">buy</div><header>site</header>
    <main class="post-17"><h1>Title &amp; more</h1><p>One  <b>bold</b><br>two &lt;3&gt;<p>Three\n\tfour</p><form><input>no</form>
    <div id="comments"><p>reader</p></div><aside>side</aside><div class="cookie-notice">notice</div><p>L<i>a</i>st</main>
    <footer>&copy;</footer></body></html>"""
    assert text(html) == "Title & more\nOne bold two <3>\nThree four\nLast"
    page = P.Page(html)
    assert page.path(page.main()[0]) == "page>html>body>main.post-0"


def test_odd_pages():
    assert text(None) == "" and text("") == "" and text("<p>") == ""
    assert text("plain &eacute; text") == "plain é text"
    assert text("<div><p>cut off &am") == "cut off &am"
    assert text("<p>a<script>x") == "a"
    assert text("<li>a<li>b") == "a\nb"
    assert text("</div></p><p>x</p></body>") == "x"
    long = "<div>" * 3000 + "deep"
    assert text(long) == "deep"


def test_names():
    for name in ("has-sidebar", "content-with-sidebar", "formal", "navy", "advice", "reader", "search-results", "widget-body", "notice-of-motion", "header-of-the-day"):
        assert text(f"<div class='{name}'><p>x</p></div>") == "x", name
    for name in ("sidebar", "left-sidebar", "site-header wide", "ad", "ad-slot", "comments2", "cookie_notice", "big promo", "newsletter-signup", "cookie-consent-banner", "related-posts", "search-form"):
        assert text(f"<div class='{name}'><p>x</p></div>") == "", name
    assert text("<body class='sidebar'><article id=comments><p>x</p></article>") == "x"


def test_hosts_agree_on_a_path(spark):
    body = lambda n, side: f'<body><div class="story s{n}"><p>{"word " * 40}{n}</p></div><div class="extra"><p>{"more " * side}</p></div></body>'
    rows = [(i, f"http://a.com/{i}", body(i, 5), "x") for i in range(9)] + [(9, "http://A.com/9", body(9, 300), "x"), (10, "http://b.com/", body(10, 300), "x"), (11, None, None, "x"), (12, "", "", "x"), (12, "", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    got = {r["page_id"]: r["text"] for r in P.main_text(df).collect()}
    assert got[9].endswith(" 9")  # its own main container would be the extra one
    assert got[10] == " ".join(["more"] * 300)
    assert got[11] == "" and got[12] == ""
    assert P.main_text(df).count() == len(rows)
    assert P.main_text(df.limit(0)).collect() == []


def test_nothing_beside_the_body_is_lost():
    body, lead = "body " * 70, "lead " * 30
    for html, want in [
        (f"<article><div class=lead>{lead}</div><div class=body>{body}</div></article>", [lead, body]),
        (f"<article><h1>A title</h1><div class=content><p>{body}</div></article>", ["A title", body]),
        (f"<article><h1><a href=/x>A title</a></h1><div class=content><p>{body}</div></article>", ["A title", body]),
        (f"<article><p>Intro</p><ul><li>{body}<li>{lead}</ul></article>", ["Intro", body, lead]),
        (f"<article><p>Intro</p><table><tr><td>{body}<td>{lead}</table><p>After</article>", ["Intro", body, lead, "After"]),
        (f"<main><section><p>{lead}</section><section><p>{body}</section></main>", [lead, body]),
    ]:
        assert text(f"<body><nav>menu</nav><div class=menu>menu</div><div><a href=/>all links</a></div>{html}<footer>end</footer></body>") == "\n".join(t.strip() for t in want)


def test_hosts_keep_what_differs_and_lose_what_repeats(spark):
    page = lambda i: f"<body><div class=about><p>About this site.</p></div><article><div class=lead>{f'lead{i} ' * 30}</div><div class=body>{f'body{i} ' * 70}</div></article></body>"
    copies = [(i, f"http://c.com/{i}", page(0)) for i in range(20, 26)]
    rows = [(i, f"http://a.com/{i}", page(i)) for i in range(6)] + [(10, "http://b.com/", page(10)), (11, None, page(11)), *copies]
    got = {r["page_id"]: r["text"] for r in P.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = lambda i: f"{f'lead{i} ' * 30}".strip() + "\n" + f"{f'body{i} ' * 70}".strip()
    for i in range(6):
        assert got[i] == want(i)
    for i, of in [(10, 10), (11, 11), *((c[0], 0) for c in copies)]:
        assert got[i] == "About this site.\n" + want(of)


PROSE = "A sentence that is long enough to be told from a label, as it has a verb and an end."


def test_zones_are_judged_by_what_they_hold():
    whole = f"<form id=aspnetForm><input type=hidden><div class=menu>menu</div><div class=page><h1>Title</h1><p>{PROSE}</p><div class=search>Find</div></div></form>"
    assert text(f"<body><nav>menu</nav>{whole}<footer>end</footer></body>") == f"Title\n{PROSE}"
    assert text(f"<div class=header><form><div class=widget><p>{PROSE}</p></div><p>label</p></form><p>top</p></div>").splitlines()[-1] != ""
    # beside an article they go, however much they hold
    for zone in ("form", "header", "div class=widget", "div id=notice", "div class=comments"):
        assert text(f"<article><p>{PROSE}</p></article><{zone}><p>{PROSE * 20}</p></{zone.split()[0]}>") == PROSE
    # reader comments are no page
    assert text(f"<div class=comments><p>{PROSE}</p></div>") == ""


def test_an_article_keeps_its_own_header():
    assert text(f"<header><h1>Site</h1></header><article><header><h1>Title</h1><p>by me</p><p>{PROSE}</p></header><p>Body. {PROSE}</p></article>") == f"Title\n{PROSE}\nBody. {PROSE}"
    assert text(f"<article><p>{PROSE}</p></article><header><h1>Site</h1></header>") == PROSE


def test_quotes_that_are_never_closed():
    assert text('<p class="x>hello</p>') == "hello"
    assert text("<div id='a><p>one</p><p>two</p></div>") == "one\ntwo"
    assert text('<p title="a>b">c</p><p title=\'"\'>d') == "c\nd"


def test_deep_and_long_pages_take_memory_in_proportion():
    import time
    import tracemalloc

    deep = '<div class="a">' * 100_000 + "deep"
    for html, want in ((deep, "deep"), ("<p>x" * 100_000, "\n".join("x" * 100_000)), ("<form>" * 50_000 + PROSE, PROSE), ('<p "' * 20_000, "")):
        began = time.time()
        tracemalloc.start()
        assert text(html) == want
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 100e6 and time.time() - began < 60


def tree(r, depth=0):
    """(html, the lines that should stay) of a random page part without plain text between elements."""
    out, want = [], []
    for _ in range(r.randint(1, 4)):
        kind = r.randrange(7) if depth < 4 else r.randrange(3)
        word = f"w{r.randrange(10**6)} &lt;{r.randrange(9)}&gt; é. " * 9
        plain = word.replace("&lt;", "<").replace("&gt;", ">").strip()
        if kind < 2:
            tag = r.choice(["p", "h2", "li", "blockquote", "pre", "td"])
            out.append(f"<{tag}>{word}</{tag}>")
            want.append(plain)
        elif kind == 2:
            out.append(r.choice([f"<nav>{word}</nav>", f"<script>{word}</script>", f"<!-- {word} -->", f"<div class='ad'>{word}</div>", f"<aside><p>{word}</p></aside>", f"<form>{word}</form>"]))
        else:
            tag = r.choice(["div", "section", "div class=story", "table", "ul"])
            inner = tree(r, depth + 1)
            out.append(f"<{tag}>{inner[0]}</{tag.split()[0]}>")
            want += inner[1]
    return "".join(out), want


def test_random_pages_against_brute_force(spark):
    import random

    r = random.Random(5)
    rows, want = [], {}
    for i in range(300):
        html, lines = tree(r)
        first = f"Body {i}. {PROSE}"
        want[i] = "\n".join([first, *lines])
        rows.append((i, f"http://h{i % 7}.com/{i}", f"<html><body><header>site</header><article><p>{first}</p>{html}</article><footer>f</footer></body></html>"))
    got = {x["page_id"]: x["text"] for x in P.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == want


def test_time_grows_with_stray_end_tags():
    import time

    def took(n):
        at = time.process_time()
        P.Page("<div>" * n + "</x>" * n + "<p>text</p>")
        return time.process_time() - at

    assert took(100_000) < 40 * max(took(10_000), 0.02)  # 0.9 MB
    assert text("<div>" * 9 + "<b></x></p></div>" * 20 + "after") == "after"
