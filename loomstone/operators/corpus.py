"""Graphs of several pages: namespaces, crawled links, rewiring, continuation and frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.config import CONFIG, Config
from loomstone.functions.text import slug_of_url, wiki_slug
from loomstone.operators import graph, tiling
from loomstone.operators.sectioning import section_units


def namespaced(df: DataFrame, *ids: str) -> DataFrame:
    return df.withColumns({c: F.concat_ws("::", "unit", c) for c in ids})


def continues(units: DataFrame) -> DataFrame:
    """(unit, src, dst) between consecutive sections of a page."""
    nxt = F.lead("section_unit").over(Window.partitionBy("unit").orderBy("section"))
    return units.select("unit", F.concat("section_unit", F.lit("::page")).alias("src"), F.concat(nxt, F.lit("::page")).alias("dst")).filter("dst IS NOT NULL")


def crawl(links: DataFrame, most: int = CONFIG.max_crawled_pages) -> DataFrame:
    """(page_id, n, href): each page's first `most` distinct targets in first-seen order."""
    first = links.groupBy("page_id", "href").agg(F.min("seq").alias("seq"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("seq")) - 1).filter(F.col("n") < most).select("page_id", "n", "href")


def unit_slugs(pages: DataFrame) -> DataFrame:
    """pages(page_id, url) with slug; further pages of a slug get _2, _3 in page order."""
    x = pages.withColumn("base", slug_of_url(F.col("url")))
    n = F.row_number().over(Window.partitionBy("base").orderBy("page_id"))
    return x.withColumn("slug", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("_", "base", n.cast("string")))).drop("base")


def rewired(links: DataFrame, entries: DataFrame) -> DataFrame:
    """links(page_id, seq, key) onto entries(key, entry_node): the entry node where the target is known, else the placeholder."""
    return links.join(entries, "key", "left").select("page_id", "seq", F.coalesce("entry_node", F.concat(F.lit("ext::"), "key")).alias("dst"), F.col("entry_node").isNotNull().alias("resolved"))


def frontier(edges: DataFrame, node_types: DataFrame) -> DataFrame:
    """(src, dst): elements reachable across documents. An element's link to a page, or its page's continuation, and that page's elements.

    edges(src, dst, relation); node_types(node, type). Links to unresolved pages lead nowhere."""
    contains = edges.filter("relation = 'contains'").select(F.col("src").alias("page"), F.col("dst").alias("el"))
    pages = node_types.filter("type = 'page'").select(F.col("node").alias("page"))
    linked = edges.filter("relation = 'links_to'").select("src", F.col("dst").alias("page")).join(pages, "page", "left_semi")
    onward = contains.select(F.col("el").alias("src"), F.col("page").alias("from")).join(edges.filter("relation = 'continues'").select(F.col("src").alias("from"), F.col("dst").alias("page")), "from").select("src", "page")
    return linked.unionByName(onward).join(contains, "page").select("src", F.col("el").alias("dst")).distinct()


def containing_page(edges: DataFrame) -> DataFrame:
    """(unit, node, page): the page that contains an element."""
    return edges.filter("relation = 'contains'").select("unit", F.col("dst").alias("node"), F.col("src").alias("page"))


def rewired_wiki(links: DataFrame, entries: DataFrame) -> DataFrame:
    """links(..., href) with dst: the page node of entries(slug) named by the decoded address after /wiki/, else the placeholder."""
    x = links.withColumn("slug", wiki_slug(F.col("href")))
    known = entries.select("slug").distinct().withColumn("node", F.concat("slug", F.lit("::page")))
    return x.join(known, "slug", "left").withColumn("dst", F.coalesce("node", F.concat(F.lit("ext::"), "href"))).drop("node", "slug")


def chain_order(units: DataFrame, *keys: str) -> DataFrame:
    """units(..., unit, section_unit, section) with place: pages in order of their name, each followed along its chain of sections."""
    return units.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("unit", "section")) - 1)


def page_graph(elements: DataFrame, config: Config = CONFIG, semantic: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of pages from elements with boxes: tiles, their graph, and for pages that are too high a graph a section, chained by `continues`.

    Node ids of sections are `page__secN::id`; the entry page of a unit is its first page node."""
    t = tiling.build_section_tiles(elements, config).select("unit", F.col("tile_seq").alias("seq"), F.col("dom_tag").alias("tag"), "x", "y", F.col("width").alias("w"), F.col("height").alias("h"), F.col("text_preview").alias("text"), "links")
    t = graph.reading_order(t, config.row_tolerance)
    links = t.select("unit", "seq", F.posexplode("links").alias("nth", "l")).select("unit", "seq", "nth", "l.href", "l.anchor_text")
    n, e = graph.nodes(t), graph.edges(t.drop("links"), links, semantic)
    part = F.contains("unit", F.lit("__sec"))
    own = lambda c: F.when(part & ~F.startswith(F.col(c), F.lit("ext::")), F.concat_ws("::", "unit", c)).otherwise(F.col(c))
    page = F.substring_index("unit", "__sec", 1)
    n = n.withColumn("node_id", own("node_id")).withColumn("section", F.when(part, F.substring_index("unit", "__sec", -1).cast("int")).otherwise(0)).withColumn("unit", page)
    e = e.withColumn("src", own("src")).withColumn("dst", own("dst")).withColumn("unit", page)
    chain = continues(section_units(elements, config.max_page_height)).select("unit", "src", "dst", F.lit("continues").alias("relation"))
    return n, e.unionByName(chain, allowMissingColumns=True)


def corpus_edges(edges: DataFrame, crawled: DataFrame, targets: DataFrame) -> DataFrame:
    """(seed, src, dst, relation) of each seed page with the pages it was crawled to.

    edges(unit, src, dst, relation) of single pages; crawled(unit, page): pages of a seed's corpus besides itself;
    targets(href, page): which page an address is. The seed's links lead to the entry of a crawled page, else to the
    placeholder; edges of crawled pages stay as they are."""
    members = crawled.select(F.col("unit").alias("seed"), F.col("page").alias("unit")).unionByName(edges.select(F.col("unit").alias("seed"), "unit").distinct()).distinct()
    x = edges.join(members, "unit")
    inside = crawled.select(F.col("unit").alias("seed"), F.col("page").alias("target")).distinct().withColumn("known", F.lit(True))
    x = x.join(targets.select(F.concat(F.lit("ext::"), "href").alias("dst"), F.col("page").alias("target")), "dst", "left").join(inside, ["seed", "target"], "left")
    named = lambda c: F.when(F.startswith(F.col(c), F.lit("ext::")), F.col(c)).otherwise(F.concat_ws("::", "unit", c))
    dst = F.when((F.col("unit") == F.col("seed")) & (F.col("relation") == "links_to") & F.coalesce("known", F.lit(False)), F.concat("target", F.lit("::page"))).otherwise(named("dst"))
    return x.select("seed", named("src").alias("src"), dst.alias("dst"), "relation")


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, near, back): reading-order neighbours, those before first."""
    r = edges.filter("relation = 'reading_order'")
    return r.select("unit", F.col("dst").alias("node"), F.col("src").alias("near"), F.lit(0).alias("side")).union(r.select("unit", F.col("src").alias("node"), F.col("dst").alias("near"), F.lit(1).alias("side")))
