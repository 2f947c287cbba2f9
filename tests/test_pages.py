"""HTML, URLs, links and the crawl jobs."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import html as H, urls as U
from corpusloom.operators import crawl
from corpusloom.sources import ingest as ig

PAGE = """<html><head><title> A &amp; B </title><style>p{}</style></head><body>
<header><a href="/home">Home</a></header><nav><p>Menu of many links</p></nav>
<article><h1>Heading</h1><p>The first paragraph of the <b>story</b>.</p>
<p><a href="/x">Only a link here</a></p><!-- hidden > --><script>var a = "<p>no</p>";</script>
<p>Fish &amp; chips &lt;3</p></article><aside>Advert</aside><footer>Contact</footer></body></html>"""


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], [f"{k}" for k in values])
    return df.select(expression).first()[0]


def test_clean_html(spark):
    html = "<p>Hello<script>x()</script>  <b title='a > b'>world</b><!-- no --></p>&eacute;1 < 2"
    assert one(spark, H.clean_html(F.col("html")), html=html) == "Hello world é1 < 2"


def test_main_content(spark):
    text = one(spark, H.main_content(F.col("html")), html=PAGE)
    assert text == "Heading The first paragraph of the story . Fish & chips <3"
    plain = "<html><body><nav>Menu</nav></body></html>"
    assert one(spark, H.main_content(F.col("html")), html=plain) == "Menu"


def test_title(spark):
    t = H.title(F.col("html"), F.col("url"))
    assert one(spark, t, html=PAGE, url="u") == "A & B"
    assert one(spark, t, html="<title>  </title>", url="u") == "u"
    assert len(one(spark, t, html="<title>" + "x" * 900 + "</title>", url="u")) == 500


@pytest.mark.parametrize(
    "href, expected",
    [
        ("page.html", "https://h.org/a/b/page.html"),
        ("./page", "https://h.org/a/b/page"),
        ("../up?x=1#f", "https://h.org/a/up"),
        ("../../../top", "https://h.org/top"),
        ("/root/./c/..", "https://h.org/root/"),
        ("//other.org/z", "https://other.org/z"),
        ("http://x.org/q?a=1#b", "http://x.org/q"),
        ("?only=query", "https://h.org/a/b/c"),
        ("sub/", "https://h.org/a/b/sub/"),
    ],
)
def test_resolve(spark, href, expected):
    got = one(
        spark, U.resolve(F.col("href"), F.col("base")), href=href, base="https://h.org/a/b/c?q=1"
    )
    assert got == expected


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://h.org", True), ("https://h.org/", True), ("https://h.org/a.html", True),
        ("https://h.org/a.PDF", False), ("https://h.org/a.pdf?x=1", False),
        ("https://h.org/a?x=b.pdf", True), ("https://h.org/a.txt", True),
        ("https://h.org/a.xhtml", True), ("https://h.org/a.tar.gz", False),
        ("https://h.org/a.html.gz", True), ("https://h.org/.png", True),
        ("https://h.org/a.unknownext", True), ("https://h.org/x.jpg/page", True),
        ("https://h.org/a.tgz", False),
    ],
)
def test_is_crawlable(spark, url, expected):
    assert one(spark, U.is_crawlable(F.col("url")), url=url) is expected


def test_extract_links(spark):
    html = """<a class="x" href="/a?x=1&amp;y=2#z">1</a> <a href='b.html'>2</a> <a href=c>3</a>
    <a href="#top">4</a><a href="JavaScript:x()">5</a><a href="mailto:a@b.c">6</a>
    <a href="">7</a><a href="ftp://h/x">8</a><a href="pic.png">9</a><a name="n">10</a>
    <!-- <a href="/no">11</a> --><a href="/a">12</a><A HREF="https://o.org:80/d">13</A>"""
    pages = spark.createDataFrame([(1, "https://h.org/p/q", html)], "page_id bigint, url string, html string")
    links = crawl.extract_links(pages).first().links
    assert links == [
        "https://h.org/a", "https://h.org/p/b.html", "https://h.org/p/c", "https://h.org/a",
        "https://o.org:80/d",
    ]
    graph = crawl.link_graph(crawl.extract_links(pages), same_host=True, n=2).collect()
    assert [(r.pos, r.to_url) for r in graph] == [(0, "https://h.org/a"), (1, "https://h.org/p/b.html")]


def test_expand_frontier(spark):
    edges = [("a", "b", 0), ("a", "c", 1), ("b", "d", 0), ("c", "d", 0), ("d", "a", 0), ("d", "e", 1), ("e", "f", 0)]
    links = spark.createDataFrame(edges, "from_url string, to_url string, pos int")
    seeds = spark.createDataFrame([("a", 0)], "url string, pos int")
    got = {r.url: (r.depth, r.n) for r in crawl.expand_frontier(seeds, links, 3).collect()}
    assert got == {"a": (0, 1), "b": (1, 2), "c": (1, 3), "d": (2, 4), "e": (3, 5)}
    few = crawl.expand_frontier(seeds, links, 3, max_documents=3).collect()
    assert sorted(r.url for r in few) == ["a", "b", "c"]


def test_exclusion_rules(spark):
    rules = spark.createDataFrame(
        [("https://h.org", "*", 2, False, "/private"), ("https://h.org", "*", 1, True, "/private/ok"),
         ("https://b.org", "*", 1, False, "/"), ("https://b.org", "Loom", 1, False, ""),
         ("https://c.org", "other", 1, False, "/")],
        "origin string, agent string, rule_order int, allow boolean, path_prefix string",
    )
    urls = {
        "https://h.org/private/ok/1": True, "https://h.org/private/2": False, "https://h.org/": True,
        "https://b.org/x": True, "https://c.org/x": True, "https://none.org": True,
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    out = crawl.apply_exclusion_rules(df, rules, "loom")
    assert {r.url: r.allowed for r in out.collect()} == urls


def test_exclusion_rules_follow_the_standard_parser(spark):
    """Query strings, contained agents, encodings and the lone asterisk."""
    from urllib.robotparser import RobotFileParser

    groups = {
        "crawl": [(False, "/deep"), (True, "/")],
        "loom": [(False, "/search?q="), (True, "/a b/ok"), (False, "/a b"), (False, "/x%20y")],
        "bot": [(False, "/")],
        "*": [(False, "/search"), (False, "/tmp")],
    }
    lines, rows, order = [], [], 0
    for agent, listed in groups.items():
        lines.append(f"User-agent: {agent}")
        for allow, path in listed:
            order += 1
            lines.append(f"{'Allow' if allow else 'Disallow'}: {path.replace(' ', '%20')}")
            rows.append(("http://h.org", agent, order, allow, path))
        lines.append("")
    parser = RobotFileParser()
    parser.parse(lines)
    # the parser decodes the paths it reads, so the table holds them decoded
    rows = [(o, g, n, a, p.replace("%20", " ")) for o, g, n, a, p in rows]
    rules = spark.createDataFrame(
        rows, "origin string, agent string, rule_order int, allow boolean, path_prefix string"
    )
    urls = ["http://h.org" + u for u in (
        "", "/", "/search?q=1", "/search?p=1", "/search", "/a%20b/ok/1", "/a%20b/no", "/a b/no",
        "/x%20y", "/tmp/1", "/deep/er", "/%74mp", "/other?x=/tmp", "/a+b",
    )]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for agent in ("LoomBot/1.0", "loom", "Robot/2", "Crawler", "nobody", "Loom/x"):
        got = {r.url: r.allowed for r in crawl.apply_exclusion_rules(df, rules, agent).collect()}
        assert got == {u: parser.can_fetch(agent, u) for u in urls}, agent


def test_a_lone_asterisk_matches_all(spark):
    rules = spark.createDataFrame(
        [("http://h.org", "*", 1, False, "*")],
        "origin string, agent string, rule_order int, allow boolean, path_prefix string",
    )
    df = spark.createDataFrame([("http://h.org/any",)], "url string")
    assert not crawl.apply_exclusion_rules(df, rules, "loom").first().allowed


def test_elements_end_at_their_own_tag(spark):
    pages = [
        ("""<p>a</p><script>var t="</style>";go(1)</script><p>b</p>""", "a b", "a b"),
        ("<nav><header>Menu</header> more</nav><p>Main text stands here.</p>",
         "Menu more Main text stands here.", "Main text stands here."),
        ("<style>x</script></style>y<noscript><style>z</style>w</noscript>", "y", "y"),
    ]
    df = spark.createDataFrame(pages, "html string, text string, main string")
    for row in df.withColumns(
        {"t": H.clean_html(F.col("html")), "m": H.main_content(F.col("html"))}
    ).collect():
        assert (row.t, row.m) == (row.text, row.main)


def test_classify_and_count(spark):
    long = "x" * 200
    rows = [
        (False, None, long, False), (True, "timeout", None, False), (True, None, "short", False),
        (True, None, long, True), (True, None, long, False),
    ]
    df = spark.createDataFrame(rows, "allowed boolean, error string, text string, is_duplicate boolean")
    out = crawl.classify_pages(df)
    assert sorted((r.status, r.reason or "") for r in out.collect()) == [
        ("blocked", "excluded by rules"), ("failed", "timeout"), ("skipped", "duplicate"),
        ("skipped", "too short"), ("success", ""),
    ]
    row = crawl.crawl_counters(out.withColumn("job_id", F.lit(1))).first()
    assert tuple(row)[1:] == (1, 4, 1, 0)


def test_validation(spark):
    rows = [
        (1, " T ", " https://h.org/x ", " text "), (2, "  ", None, "t"), (3, "x" * 501, None, "t"),
        (4, "T", "ftp://h", "t"), (5, "T", "https://", "t"), (6, "T", "https://h/" + "x" * 2000, "t"),
        (7, "T", "  ", " \n "), (8, "T", "", "t"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, title string, url string, text string")
    accepted, rejected = ig.split_valid(ig.validate_documents(docs))
    assert {(r.doc_id, r.title, r.url, r.text) for r in accepted.collect()} == {
        (1, "T", "https://h.org/x", "text"), (8, "T", None, "t"),
    }
    assert {r.doc_id: r.reason for r in rejected.collect()} == {
        2: "title is empty", 3: "title is too long", 4: "url is not http(s)", 5: "url is not http(s)",
        6: "url is too long", 7: "text is empty",
    }


def test_insert_and_refresh(spark):
    schema = "doc_id bigint, collection int, url string, title string, fetched_at int"
    existing = spark.createDataFrame([(1, 1, "u", "old", 1), (2, 1, None, "anon", 1)], schema)
    incoming = spark.createDataFrame(
        [(5, 1, "u", "new", 2), (6, 1, "u", "newest", 3), (7, 2, "u", "other", 2),
         (8, 1, None, "anon2", 2), (9, 2, "u", "later", 1)],
        schema,
    )
    fresh = {r.doc_id for r in ig.insert_new(incoming, existing).collect()}
    assert fresh == {7, 8}
    out = {r.doc_id: (r.collection, r.url, r.title) for r in ig.refresh_documents(existing, incoming).collect()}
    assert out == {
        1: (1, "u", "newest"), 2: (1, None, "anon"), 7: (2, "u", "other"), 8: (1, None, "anon2"),
    }


def test_csv_quoting(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok', None)], "id int, text string, none string")
    ig.export_csv(df.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert text == 'id,text,none\n1,"say ""hi"", ok",\n'


def test_stale_needs_a_finished_index(spark):
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d)
    collections = spark.createDataFrame(
        [(1, day(5)), (2, day(1)), (3, day(9)), (4, None)], "collection int, documents_changed_at timestamp_ntz"
    )
    jobs = spark.createDataFrame(
        [(1, day(2)), (1, day(3)), (2, day(3)), (4, day(1))], "collection int, finished_at timestamp_ntz"
    )
    out = {r.collection: r.is_stale for r in ig.stale_collections(collections, jobs).collect()}
    assert out == {1: True, 2: False, 3: False, 4: False}


def test_dense_content_drops_long_boilerplate(spark):
    """Runs of short blocks outside any furniture element go, short lines in the article stay."""
    paragraph = "The laser was aligned with care before each of the long measurements began. " * 6
    notice = "".join(f"<div>Cookie notice {i}: we value your privacy.</div>" for i in range(30))
    listed = "".join(f"<li>Related story number {i} and more</li>" for i in range(30))
    links = "<p>" + "<a href='/x'>A link with a long text that goes on</a> " * 12 + "</p>"
    html = (
        f"<body>{notice}<div>{paragraph}</div><h2>A short heading</h2><div>{paragraph}</div>"
        f"{links}<p>{paragraph}</p><ul>{listed}</ul></body>"
    )
    rows = [(1, html), (2, "<p>one line</p>"), (3, ""), (4, None), (5, "<p><a href='/x'>only a link</a></p>")]
    df = spark.createDataFrame(rows, "page_id int, html string")
    got = {r.page_id: r.content for r in H.dense_content(df, "page_id").collect()}
    body = paragraph.strip()
    assert got[1] == f"{body} A short heading {body} {body}"
    assert (got[2], got[3], got[4], got[5]) == ("one line", "", None, "only a link")


def test_references_end_in_a_semicolon(spark):
    html = "<p>a &amp b &amp;amp; &copy2 &copy; &notit; &#65; &#x42; &eacute;</p>"
    got = one(spark, H.clean_html(F.col("html")), html=html)
    assert got == "a &amp b &amp; &copy2 © &notit; A B é"


def test_a_cut_reference_counts_in_the_length_of_a_page(spark):
    rows = [(1, "x" * 895 + " &amp", True, None, False, "j")]
    pages = spark.createDataFrame(
        rows, "page_id bigint, html string, allowed boolean, error string, is_duplicate boolean, "
        "job_id string",
    )
    texts = pages.withColumn("text", H.main_content(F.col("html"))).drop("html")
    assert crawl.classify_pages(texts, min_chars=900).first()["status"] == "success"
