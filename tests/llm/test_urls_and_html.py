"""URL rules against a brute-force judgement; main texts of pages made by hand."""

import random

from pyspark.sql import functions as F

from spendspark.llm import html_text, url_filter


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("#")[0].split("?")[0]
    best = None
    for h, p, verdict in rules:
        if h and (host == h or host.endswith("." + h)) and path.startswith(p or ""):
            rank = (len(h) + len(p or ""), len(h), verdict == "block")
            if best is None or rank > best[0]:
                best = (rank, h + (p or ""), verdict)
    return host, path, best and best[1], best[2] if best else default


def test_rules_equal_brute_force(spark):
    random.seed(2)
    labels = ["org", "com", "example", "a", "b", "www", ""]
    hosts = [".".join(random.choice(labels) for _ in range(random.randrange(1, 5))) for _ in range(60)]
    paths = ["", "/", "/en/", "/en/1", "/en/12", "/es", "/es/x", "/EN/"]
    urls = [f"http://{random.choice(hosts)}{random.choice(paths)}{random.choice(['', '?q=://x', '#t'])}" for _ in range(400)]
    urls += [None, "", "no scheme/a", "x://", "http://EXAMPLE.org/En/", "http://example.org:80/en/", "ftp://a.b.example.org/en/1"] * 2
    urls += ["http://example.org/en/1"] * 300
    rules = [("org", "/", "allow"), ("example.org", "/en/", "block"), ("example.org", "/en/1", "allow"), ("www.example.org", "/en", "block"),
             ("com", None, "block"), ("a.com", "", "allow"), ("a.com", "", "block"), (None, "/", "block"), ("a.b", "/e", "block"), ("b", "/en/", "allow")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, table).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        assert got[i] == brute(url, rules), url


def test_no_rules_no_pages_and_repeats(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (None, None)], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert sorted((r.host, r.verdict) for r in url_filter.judge(pages, none).collect()) == [("", "allow"), ("a.org", "allow"), ("a.org", "allow")]
    rules = spark.createDataFrame([("org", "/", "block")], "host string, path string, verdict string")
    assert url_filter.judge(pages.limit(0), rules).collect() == []


LONG = "This is a long paragraph of the article that goes on and on for a good while, as articles do."


def test_article_is_kept_whole():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy this now, it is good.</div>
    <article><h1>Head &amp;amp; line</h1><p><b>First.<br>second&nbsp;  line<p>{LONG}</p><p>Be.</p><aside>aside text</aside>
    <form>Your name</form><p>Last <a href="/x">link</a> &lt;b&gt;</p><div class="comments"><p>a reader says so</p></div></article>
    <footer>&copy; host</footer></body></html>"""
    assert html_text.main_text(page) == f"Head &amp; line\nFirst. second line\n{LONG}\nBe.\nLast link <b>"


def test_cut_off_pages_and_odd_markup():
    assert html_text.main_text(f"<article><p>{LONG}<p>end &am") == f"{LONG}\nend &am"
    assert html_text.main_text(f"<article><p>{LONG}<p>end</p><foo") == f"{LONG}\nend"
    assert html_text.main_text(f"<article><p>{LONG}</p><script>never closed <p>x") == LONG
    assert html_text.main_text(f"<article><p>{LONG}</p><!-- open <p>x") == LONG
    assert [html_text.main_text(p) for p in (None, "", "<html><body></body></html>", "<nav>x</nav>")] == ["", "", "", ""]


def test_surge_and_dive_without_an_article():
    menu = "".join(f"<li><a href='/{i}'>entry {i}</a></li>" for i in range(8))
    page = f"<body><div id='top'><ul>{menu}</ul></div><div><h2>Head</h2><p>{LONG}</p><p>{LONG}</p><p class='notice'>We use cookies</p><p>{LONG}</p></div>" \
           f"<div><ul>{menu}</ul></div><div><p>Contact us</p></div></body>"
    assert html_text.main_text(page) == f"Head\n{LONG}\n{LONG}\n{LONG}"


def test_windows_find_what_a_mark_says():
    random.seed(6)
    words = lambda low, high: " ".join(random.choice(["and", "text", "é", "long", "über"]) for _ in range(random.randrange(low, high)))
    for _ in range(60):
        parts = [words(8, 60) for _ in range(random.randrange(2, 9))]
        links = "".join(f"<li><a href='/{i}'>{words(1, 4)}</a></li>" for i in range(random.randrange(1, 9)))
        body = "".join(f"<p>{p}" + random.choice(["", "</p>"]) + random.choice(["", "<div class='ad'>Buy this now.</div>"]) for p in parts)
        page = f"<title>t</title><body><nav><ul>{links}</ul></nav><article><h1>Head line</h1>{body}</article><footer>&copy; all of it</footer>"
        assert html_text.main_text(page) == "\n".join(["Head line", *parts])
        assert html_text.main_text(page.replace("article", "div")) == html_text.main_text(page)


def test_names_alone_do_not_take_the_articles_parts():
    page = f"<article><h2 id='comment-on-law'>On law</h2><p>{LONG}</p><div class='search related'><p>A search is related.</p></div><p id='notice'>Be.</p>" \
           f"<div class='related'><a href='/1'>See one</a></div><p>{LONG}</p><ul class='ad'>{'<li>Buy</li>' * 5}</ul><p>So.</p></article><p>Not this.</p>"
    assert html_text.main_text(page) == f"On law\n{LONG}\nA search is related.\nBe.\n{LONG}\nSo."
    menu = "".join(f"<li><a href='/{i}'>entry {i}</a></li>" for i in range(5))
    closing = "The short end of the text."
    page = f"<div><p>{LONG}</p><p><a href='/x'>a link alone</a></p><p>{LONG}</p></div><ul>{menu}</ul><div><p>{closing * 4}</p></div><ul>{menu}</ul>"
    assert html_text.main_text(page) == f"{LONG}\na link alone\n{LONG}\n{closing * 4}"


def test_deep_odd_markup_takes_time_in_proportion():
    n = 100_000
    for page in ("<b>" * n + "x" + "</i>" * n, "<span>" * n + "<hr>" * n + "x", "<div>" * n + "x" + "</p></div>" * n):
        assert html_text.main_text(f"<article>{page}") == "x"


def test_extract_keeps_rows_and_columns(spark):
    rows = [(1, "u", "<article><p>a  b</p></article>"), (1, "u", "<article><p>a  b</p></article>"), (2, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted((r.page_id, r.text) for r in html_text.extract(pages).collect()) == [(1, "a b"), (1, "a b"), (2, "")]
    assert [r.n_chars for r in html_text.report(pages.limit(0)).collect()] == []
