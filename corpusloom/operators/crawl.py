"""Batch forms of crawling over stored pages: frontier, exclusion rules, page status."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import html as H, urls as U
from corpusloom.operators.skew import lookup_join, position_in_group
from corpusloom.sources.shared import materialise

# Limits of a crawl.
LINKS_PER_PAGE, MIN_CHARS = 50, 200


def extract_links(pages: DataFrame) -> DataFrame:
    """``(page_id, url, links)``: resolved links of every page, in document order.

    Character references are decoded once per page, in an array that still sits in its row.
    """
    sep = "\u0001"
    joined = H.unescape(F.array_join(H.hrefs(F.col("html")), sep))
    found = pages.select("page_id", "url", F.split(joined, sep).alias("raw"))
    return found.select("page_id", "url", H.resolved_links(F.col("raw"), F.col("url")).alias("links"))


def link_graph(
    links: DataFrame, same_host: bool = False, n: int = LINKS_PER_PAGE
) -> DataFrame:
    """``(from_url, to_url, pos)``: at most ``n`` distinct links per page."""
    allowed = U.host(F.col("url")) if same_host else None
    return links.select(
        U.without_query(F.col("url")).alias("from_url"),
        F.posexplode(H.capped_links(F.col("links"), allowed, n)).alias("pos", "to_url"),
    )


def expand_frontier(
    seeds: DataFrame, links: DataFrame, max_depth: int, max_documents: int | None = None
) -> DataFrame:
    """``(url, depth, n)``: every reachable URL once, at its smallest depth, in discovery order.

    Breadth first: one join per level with the links, and one with what is known already. Every
    level is written to the shared folder, so lost executors cost no earlier level. Stops when a
    level is empty or the document budget is reached.
    """
    level = materialise(
        _number(
            seeds.groupBy("url").agg(F.min("pos").alias("pos")).withColumn("parent", F.lit(0)), 0
        ).withColumn("depth", F.lit(0)),
        "frontier",
    )
    known = level
    total = level.count()
    for depth in range(1, max_depth + 1):
        if max_documents is not None and total >= max_documents:
            break
        found = (
            level.select(F.col("url").alias("from_url"), F.col("n").alias("parent"))
            .join(links, "from_url")
            .groupBy(F.col("to_url").alias("url"))
            .agg(F.min(F.struct("parent", "pos")).alias("first"))
            .select("url", "first.parent", "first.pos")
            .join(known.select("url"), "url", "left_anti")
        )
        level = materialise(_number(found, total).withColumn("depth", F.lit(depth)), "frontier")
        size = level.count()
        if size == 0:
            break
        known, total = known.unionByName(level), total + size
    return known if max_documents is None else known.filter(F.col("n") <= max_documents)


def _number(found: DataFrame, offset: int) -> DataFrame:
    """Discovery numbers after ``offset``, by parent and place on the parent's page."""
    block = F.floor((F.col("parent") + F.col("pos")) / (1 << 16)) if offset == 0 else F.floor(
        F.col("parent") / (1 << 14)
    )
    numbered = position_in_group(
        found, [], block, [F.col("parent"), F.col("pos"), F.col("url")], "_n"
    )
    return numbered.select("url", (F.col("_n") + offset).alias("n"))


def apply_exclusion_rules(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Add ``allowed``: the first rule of the applying group that matches decides, none allows.

    The applying group of an origin is the first, by its first rule, whose agent is contained in
    our agent's name before any slash, or else the general one. A rule matches when the decoded
    path, with its query, begins with the rule's path, or when that is a lone asterisk. An origin
    has few rules, so they travel as one array and no pair of URL and rule is ever a row.
    """
    name = F.lit(agent.split("/")[0].lower())
    general = F.col("agent") == "*"
    groups = (
        rules.filter(general | F.contains(name, F.lower("agent")))
        .groupBy("origin", "agent")
        .agg(
            F.min("rule_order").alias("first"),
            F.array_sort(F.collect_list(F.struct("rule_order", "allow", "path_prefix"))).alias("rules"),
        )
    )
    # named groups come before the general one
    chosen = groups.groupBy("origin").agg(
        F.min_by("rules", F.struct(general.alias("g"), "first", "agent")).alias("rules")
    )
    placed = urls.withColumn("origin", U.origin(F.col("url"))).withColumn(
        "_path", F.coalesce(F.nullif(U.decoded_target(F.col("url")), F.lit("")), F.lit("/"))
    )
    joined = lookup_join(placed, chosen, ["origin"], ["url"])
    hit = F.try_element_at(
        F.filter(
            "rules",
            lambda r: (r["path_prefix"] == "*") | F.startswith(F.col("_path"), r["path_prefix"]),
        ),
        F.lit(1),
    )
    # an empty disallow rule allows everything
    return joined.withColumn(
        "allowed",
        F.coalesce(hit["allow"] | (hit["path_prefix"] == ""), F.lit(True)),
    ).drop("rules", "_path")


def classify_pages(pages: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Status and reason of each fetched page.

    Takes ``allowed``, ``error``, ``text`` and ``is_duplicate``.
    """
    short = F.length("text") < min_chars
    blocked, failed = ~F.col("allowed"), F.col("error").isNotNull()
    status = (
        F.when(blocked, "blocked")
        .when(failed, "failed")
        .when(short | F.col("is_duplicate"), "skipped")
        .otherwise("success")
    )
    reason = (
        F.when(blocked, F.lit("excluded by rules"))
        .when(failed, F.col("error"))
        .when(short, F.lit("too short"))
        .when(F.col("is_duplicate"), F.lit("duplicate"))
    )
    return pages.withColumn("status", status).withColumn("reason", reason)


def crawl_counters(log: DataFrame) -> DataFrame:
    """Documents fetched, URLs visited, failed and queued per job."""
    status = F.col("status")
    return log.groupBy("job_id").agg(
        F.count_if(status == "success").alias("documents_fetched"),
        F.count_if(status.isin("success", "skipped", "blocked")).alias("urls_visited"),
        F.count_if(status == "failed").alias("urls_failed"),
        F.count_if(status == "queued").alias("urls_queued"),
    )
