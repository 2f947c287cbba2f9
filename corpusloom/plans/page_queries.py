"""Queries over stored pages and the link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import html as H, urls as U
from corpusloom.operators import crawl
from corpusloom.operators.skew import lookup_join
from corpusloom.plans import sql
from corpusloom.plans.catalog import query
from corpusloom.sources.tables import read_table, read_texts

# The rules of a page, written for DuckDB on their own; nothing is taken from the code they check.
_SILENT = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|"
    r"<noscript\b[^>]*>.*?</noscript\s*>"
)
_FURNITURE = (
    r"(?is)<nav\b[^>]*>.*?</nav\s*>|<header\b[^>]*>.*?</header\s*>|"
    r"<aside\b[^>]*>.*?</aside\s*>|<footer\b[^>]*>.*?</footer\s*>"
)
_TAGS = r"""<[/a-zA-Z!?](?:"[^"]*"|'[^']*'|[^'">])*>"""
_BLOCKS = (
    r"(?i)</?(?:article|blockquote|body|br|dd|div|dl|dt|figcaption|figure|form|h[1-6]|hr|html|li|"
    r"main|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>"
)
_ARTICLE, _MAIN = r"(?is)<article\b[^>]*>(.*)</article\s*>", r"(?is)<main\b[^>]*>(.*)</main\s*>"
_TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
_LINKED = r"(?is)<a\b[^>]*>.*?</a\s*>"
_TARGET = r"""(?is)<a(?:\s[^>]*?)?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _drop(expr: str, pattern: str, by: str = " ") -> str:
    return f"regexp_replace({expr}, {_q(pattern)}, '{by}', 'g')"


def _decode(expr: str) -> str:
    # the references that occur in the stored pages, "&" last
    for ref, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        expr = f"replace({expr}, '&{ref};', '{char}')"
    return expr


def _clean(expr: str) -> str:
    return sql.squeeze(_decode(_drop(_drop(expr, _SILENT), _TAGS)))


def _bare(expr: str) -> str:
    return sql.squeeze(_drop(expr, _TAGS))


@query("clean_html", f"SELECT page_id, {_clean('html')} AS text FROM pages")
def clean_html(spark, sf):
    return read_texts(spark, sf, "pages").select("page_id", H.clean_html(F.col("html")).alias("text"))


MAIN_SQL = (
    f"""h AS (SELECT page_id, url, html, {_drop('html', _SILENT)} AS heard FROM pages)""",
    f"""r AS (SELECT *, CASE
        WHEN {_bare(f"regexp_extract(heard, {_q(_ARTICLE)}, 1)")} <> ''
        THEN regexp_extract(heard, {_q(_ARTICLE)}, 1)
        WHEN {_bare(f"regexp_extract(heard, {_q(_MAIN)}, 1)")} <> ''
        THEN regexp_extract(heard, {_q(_MAIN)}, 1)
        ELSE {_drop('heard', _FURNITURE)} END AS region FROM h)""",
    f"""bl AS (SELECT page_id, url, html, list_transform(string_split_regex(
        {_drop(_drop('region', _TITLE), _FURNITURE)}, {_q(_BLOCKS)}),
        lambda b: {{'text': {_bare('b')}, 'linked': length({_bare(
            f"array_to_string(regexp_extract_all(b, {_q(_LINKED)}), ' ')")})}}) AS blocks
        FROM r)""",
    f"""main AS (SELECT page_id, url, html, {sql.squeeze('''coalesce(nullif(''' + _decode(
        "array_to_string(list_transform(list_filter(blocks, lambda b: b.text <> '' "
        "AND b.linked * 2 <= length(b.text)), lambda b: b.text), ' ')")
        + f", ''), {_clean('html')})")} AS content FROM bl)""",
)


@query("main_content", sql.with_(*MAIN_SQL) + "SELECT page_id, content FROM main")
def main_content(spark, sf):
    return read_texts(spark, sf, "pages").select(
        "page_id", H.main_content(F.col("html")).alias("content")
    )


DENSE_SQL = (
    "db AS (SELECT page_id, list_filter(blocks, lambda b: b.text <> '') AS b FROM bl)",
    """dd AS (SELECT page_id, b, list_transform(b, lambda x:
        greatest(length(x.text) - x.linked, 0)) AS d FROM db)""",
    """dk AS (SELECT page_id, list_filter(list_transform(b, lambda x, i: CASE WHEN
        x.linked * 2 <= length(x.text) AND 3 * list_sum(d) * greatest(d[i], least(
        coalesce(d[i - 1], 0), coalesce(d[i + 1], 0))) >= list_sum(list_transform(d, lambda v: v * v))
        THEN x.text END), lambda t: t IS NOT NULL) AS texts FROM dd)""",
)


@query(
    "dense_content",
    sql.with_(*MAIN_SQL, *DENSE_SQL)
    + f"""SELECT page_id, coalesce(nullif({sql.squeeze(_decode("array_to_string(texts, ' ')"))},
    ''), content) AS content FROM dk JOIN main USING (page_id)""",
)
def dense_content(spark, sf):
    """The text of pages by the density of their blocks."""
    return H.dense_content(read_texts(spark, sf, "pages"), "page_id")


@query(
    "page_titles",
    f"""SELECT page_id, substr(coalesce(nullif({sql.strip(_decode(
        f"regexp_extract({_drop('html', _SILENT)}, {_q(_TITLE)}, 1)"))}, ''), url), 1, 500)
    AS title FROM pages""",
)
def page_titles(spark, sf):
    return read_texts(spark, sf, "pages").select(
        "page_id", H.title(F.col("html"), F.col("url")).alias("title")
    )


_BLOCKED = ", ".join(f"'{e}'" for e in U.BLOCKED_EXTENSIONS)
_ARCHIVES = ", ".join(f"'{e}'" for e in U.ARCHIVE_EXTENSIONS)
_PACKED = ", ".join(f"'{e}'" for e in U.PACKED_EXTENSIONS)
_EXT = r"'[^/.][^/]*?(\.[^./]*)$'"
# every link of the stored pages starts with one slash
LINKS_SQL = (
    f"""raw AS (SELECT page_id, url, list_transform(regexp_extract_all(
        {_drop('html', _SILENT)}, {_q(_TARGET)}, 1),
        lambda x: {_decode(_drop('x', chr(94) + "[\"']|[\"']$", ''))}) AS l FROM pages)""",
    """each AS (SELECT page_id, url, unnest(l) AS href, generate_subscripts(l, 1) - 1 AS pos
        FROM raw)""",
    r"""abs_ AS (SELECT page_id, url, pos, CASE WHEN href LIKE '/%' THEN
        regexp_extract(url, '^(https?://[^/?#]*)', 1) || regexp_replace(href, '[?#].*$', '') END
        AS link FROM each WHERE href <> '' AND NOT regexp_matches(lower(href),
        '^(?:#|javascript:|mailto:|tel:)'))""",
    rf"""pth AS (SELECT *, regexp_extract(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)
        AS p FROM abs_)""",
    rf"""ext AS (SELECT *, regexp_extract(p, {_EXT}, 1) AS e, regexp_extract(
        regexp_replace(p, '\.[^./]*$', ''), {_EXT}, 1) AS e2 FROM pth)""",
    f"""links AS (SELECT page_id, url, link, pos FROM ext
        WHERE lower(CASE WHEN e IN ({_PACKED}) THEN e2 ELSE e END) NOT IN ({_BLOCKED})
        AND lower(e) NOT IN ({_ARCHIVES}))""",
)


@query(
    "extract_links",
    sql.with_(*LINKS_SQL)
    + "SELECT page_id, list(link ORDER BY pos) AS links FROM links GROUP BY page_id",
)
def extract_links(spark, sf):
    return (
        crawl.extract_links(read_texts(spark, sf, "pages"))
        .filter(F.size("links") > 0)
        .select("page_id", "links")
    )


@query(
    "crawlable_urls",
    rf"""WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 7
        WHEN 0 THEN '.pdf' WHEN 1 THEN '.HTML' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '.txt?a.png'
        WHEN 4 THEN '.html.gz' WHEN 5 THEN '/x.unknown' ELSE '' END AS url FROM pages),
    p AS (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM u),
    e AS (SELECT *, regexp_extract(p, {_EXT}, 1) AS e, regexp_extract(
        regexp_replace(p, '\.[^./]*$', ''), {_EXT}, 1) AS e2 FROM p)
    SELECT page_id, url, NOT (lower(CASE WHEN e IN ({_PACKED}) THEN e2 ELSE e END)
        IN ({_BLOCKED}) OR lower(e) IN ({_ARCHIVES})) AS crawlable FROM e""",
)
def crawlable_urls(spark, sf):
    """Page addresses with various endings."""
    endings = (".pdf", ".HTML", ".tar.gz", ".txt?a.png", ".html.gz", "/x.unknown")
    ending = F.lit("")
    for i, text in enumerate(endings):
        ending = F.when(F.col("page_id") % 7 == i, text).otherwise(ending)
    urls = read_table(spark, sf, "pages").select(
        "page_id", F.concat(U.without_query(F.col("url")), ending).alias("url")
    )
    return urls.withColumn("crawlable", U.is_crawlable(F.col("url")))


_GRAPH_SQL = (
    *LINKS_SQL,
    r"""g0 AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS from_url, link AS to_url,
        min(pos) AS at_ FROM links GROUP BY ALL)""",
    r"""graph AS (SELECT page_id, from_url, to_url, row_number() OVER (PARTITION BY page_id
        ORDER BY at_) - 1 AS pos FROM g0 QUALIFY pos < 50)""",
)


@query(
    "restrict_domain",
    sql.with_(*LINKS_SQL)
    + r"""SELECT host, count(*) AS links, count(DISTINCT link) AS targets FROM (SELECT *,
    regexp_extract(link, '^https?://([^/?#]*)', 1) AS host FROM links)
    WHERE host = regexp_extract(url, '^https?://([^/?#]*)', 1) GROUP BY host""",
)
def restrict_domain(spark, sf):
    links = crawl.extract_links(read_texts(spark, sf, "pages"))
    same = F.filter("links", lambda u: U.host(u) == U.host(F.col("url")))
    return (
        links.select(F.explode(same).alias("link"))
        .groupBy(U.host(F.col("link")).alias("host"), "link")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("host")
        .agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("targets"))
    )


@query(
    "cap_links_per_page",
    sql.with_(*_GRAPH_SQL) + "SELECT from_url, to_url, pos::INT AS pos FROM graph",
)
def cap_links_per_page(spark, sf):
    """At most fifty distinct links per page, the first ones."""
    return crawl.link_graph(crawl.extract_links(read_texts(spark, sf, "pages")))


@query(
    "expand_frontier",
    """WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b
        FROM lineitem),
    edges AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r AS (SELECT 's' || s_suppkey AS url, 0 AS depth FROM supplier WHERE s_nationkey = 3
        UNION SELECT b, depth + 1 FROM r JOIN edges ON a = r.url WHERE depth < 3)
    SELECT url, min(depth) AS depth FROM r GROUP BY url""",
)
def expand_frontier(spark, sf):
    """Three levels of the graph of suppliers and parts, from the suppliers of one nation."""
    pairs = read_table(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("a"),
        F.concat(F.lit("p"), "l_partkey").alias("b"),
        F.col("l_partkey").alias("pa"),
        F.col("l_suppkey").alias("pb"),
    ).distinct()
    links = pairs.select(
        F.col("a").alias("from_url"), F.col("b").alias("to_url"), F.col("pa").alias("pos")
    ).unionByName(
        pairs.select(
            F.col("b").alias("from_url"), F.col("a").alias("to_url"), F.col("pb").alias("pos")
        )
    )
    seeds = read_table(spark, sf, "supplier").filter("s_nationkey = 3").select(
        F.concat(F.lit("s"), "s_suppkey").alias("url"), F.col("s_suppkey").alias("pos")
    )
    return crawl.expand_frontier(seeds, links, 3).select("url", "depth")


@query(
    "crawl_frontier",
    sql.with_(*_GRAPH_SQL)
    + r""", seeds AS (SELECT from_url AS url, min(page_id) AS pos FROM (SELECT page_id,
        regexp_replace(url, '[?#].*$', '') AS from_url FROM pages) GROUP BY 1),
    s AS (SELECT url, row_number() OVER (ORDER BY pos, url) AS n FROM seeds),
    f AS (SELECT to_url AS url, min((n, pos)) AS first FROM graph JOIN s ON s.url = from_url
        WHERE to_url NOT IN (SELECT url FROM s) GROUP BY to_url),
    a AS (SELECT url, 0 AS depth, n FROM s UNION ALL SELECT url, 1, (SELECT count(*) FROM s)
        + row_number() OVER (ORDER BY first, url) FROM f)
    SELECT url, depth, n FROM a""",
)
def crawl_frontier(spark, sf):
    """The whole frontier of all stored pages. No stored page links to another, so it has one
    level; ``expand_frontier`` follows several."""
    pages = read_texts(spark, sf, "pages")
    links = crawl.link_graph(crawl.extract_links(pages))
    seeds = pages.select(
        U.without_query(F.col("url")).alias("url"), F.col("page_id").alias("pos")
    )
    # pages sharing an address bring the same links, once
    links = links.groupBy("from_url", "to_url").agg(F.min("pos").alias("pos"))
    return crawl.expand_frontier(seeds, links, 5)


# One rule set per origin: general rules, and rules of our own agent for blogs.
_RULES_SQL = (
    """o AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin
        FROM pages)""",
    """rules AS (SELECT origin, '*' AS agent, 1 AS rule_order, true AS allow, '/fr/1' AS prefix
        FROM o UNION ALL SELECT origin, '*', 2, false, '/fr' FROM o
        UNION ALL SELECT origin, 'Loom', 1, false, '/en' FROM o WHERE origin LIKE '%blog.%'
        UNION ALL SELECT origin, 'other', 0, false, '/' FROM o)""",
    r"""verdict AS (SELECT page_id, url, coalesce((SELECT arg_min(allow, rule_order) FROM rules r
        WHERE r.origin = regexp_extract(p.url, '^(https?://[^/?#]*)', 1)
        AND r.agent = CASE WHEN r.origin LIKE '%blog.%' THEN 'Loom' ELSE '*' END
        AND starts_with(regexp_extract(p.url, '^https?://[^/?#]*(.*)$', 1), r.prefix)), true)
        AS allowed FROM pages p)""",
)


def exclusion_rules(pages):
    origins = pages.select(U.origin(F.col("url")).alias("origin")).distinct()
    rule = lambda agent, order, allow, prefix: F.struct(
        F.lit(agent).alias("agent"),
        F.lit(order).alias("rule_order"),
        F.lit(allow).alias("allow"),
        F.lit(prefix).alias("path_prefix"),
    )
    general = [rule("*", 1, True, "/fr/1"), rule("*", 2, False, "/fr"), rule("other", 0, False, "/")]
    blog = F.contains(F.col("origin"), F.lit("blog."))
    rules = F.when(blog, F.array(*general, rule("Loom", 1, False, "/en"))).otherwise(
        F.array(*general)
    )
    return origins.select("origin", F.inline(rules))


@query("exclusion_rules", sql.with_(*_RULES_SQL) + "SELECT * FROM verdict")
def exclusion_rules_query(spark, sf):
    pages = read_table(spark, sf, "pages").select("page_id", "url")
    out = crawl.apply_exclusion_rules(pages, exclusion_rules(pages), "loom")
    return out.select("page_id", "url", "allowed")


_STATUS_SQL = (
    *_RULES_SQL,
    *MAIN_SQL,
    r"""kept AS (SELECT m.page_id, allowed, content, CASE WHEN m.url LIKE '%.html%'
        THEN 'timeout' END AS error, count(*) OVER (PARTITION BY regexp_replace(m.url,
        '[?#].*$', '') ORDER BY m.page_id) > 1 AS dup, regexp_extract(m.url,
        '^https?://[^/?#]*/([a-z]+)', 1) AS job_id FROM main m JOIN verdict USING (page_id))""",
    """status AS (SELECT page_id, job_id, CASE WHEN NOT allowed THEN 'blocked'
        WHEN error IS NOT NULL THEN 'failed' WHEN length(content) < 900 OR dup THEN 'skipped'
        ELSE 'success' END AS status, CASE WHEN NOT allowed THEN 'excluded by rules'
        WHEN error IS NOT NULL THEN error WHEN length(content) < 900 THEN 'too short'
        WHEN dup THEN 'duplicate' END AS reason FROM kept)""",
)


def _classified(spark, sf):
    pages = read_texts(spark, sf, "pages")
    first = pages.groupBy(U.without_query(F.col("url")).alias("_u")).agg(
        F.min("page_id").alias("_first")
    )
    verdicts = crawl.apply_exclusion_rules(pages, exclusion_rules(pages), "loom")
    placed = verdicts.withColumn("_u", U.without_query(F.col("url")))
    # copies of one page may be many, so the lookup spreads them
    rows = lookup_join(placed, first, ["_u"], ["page_id"], "inner").select(
        "page_id",
        "allowed",
        H.main_content(F.col("html")).alias("text"),
        F.when(F.contains("url", F.lit(".html")), F.lit("timeout")).alias("error"),
        (F.col("page_id") > F.col("_first")).alias("is_duplicate"),
        F.regexp_extract("url", r"^https?://[^/?#]*/([a-z]+)", 1).alias("job_id"),
    )
    return crawl.classify_pages(rows, min_chars=900)


@query("classify_pages", sql.with_(*_STATUS_SQL) + "SELECT * FROM status")
def classify_pages(spark, sf):
    return _classified(spark, sf).select("page_id", "job_id", "status", "reason")


@query(
    "crawl_counters",
    sql.with_(*_STATUS_SQL)
    + """, log AS (SELECT job_id, status FROM status UNION ALL
        SELECT event_type, CASE WHEN value > 20 THEN 'queued' ELSE 'failed' END FROM events)
    SELECT job_id, count(*) FILTER (status = 'success') AS documents_fetched,
    count(*) FILTER (status IN ('success', 'skipped', 'blocked')) AS urls_visited,
    count(*) FILTER (status = 'failed') AS urls_failed,
    count(*) FILTER (status = 'queued') AS urls_queued FROM log GROUP BY job_id""",
)
def crawl_counters(spark, sf):
    log = _classified(spark, sf).select("job_id", "status").unionByName(
        read_table(spark, sf, "events").select(
            F.col("event_type").alias("job_id"),
            F.when(F.col("value") > 20, "queued").otherwise("failed").alias("status"),
        )
    )
    return crawl.crawl_counters(log)
