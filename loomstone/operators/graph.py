"""The typed graph of a page as node and edge tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.config import CONFIG
from loomstone.functions.text import heading_level
from loomstone.operators.scoring import similar_pairs
from loomstone.operators.whole import map_units, unit_codes

EDGE = ("unit", "src", "dst", "relation", "direction", "similarity", "anchor_text")


def reading_order(tiles: DataFrame, tolerance: float = CONFIG.row_tolerance) -> DataFrame:
    """tiles with row_idx, col_idx and read_pos. A row is all that lies within the tolerance of its topmost tile.

    A gap above the tolerance starts a row in any case, so the ordered fold runs over the tiles between two gaps only."""
    order = Window.partitionBy("unit").orderBy("y", "seq")
    gap = F.coalesce(F.col("y") - F.lag("y").over(order) > tolerance, F.lit(True))
    x = tiles.repartition("unit").withColumn("gap", gap).withColumn("part", F.sum(F.col("gap").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.struct(F.lit(None).cast("double").alias("top"), F.expr("cast(array() as array<int>)").alias("starts"))

    def step(s, i):
        new = s["top"].isNull() | (i["y"] - s["top"] > tolerance)
        return F.struct(F.when(new, i["y"]).otherwise(s["top"]).alias("top"), F.when(new, F.array_append(s["starts"], i["seq"])).otherwise(s["starts"]).alias("starts"))

    # a part's tiles go through the fold together and come out again, so nothing is joined
    rest = [c for c in tiles.columns if c not in ("unit", "y", "seq")]
    items = F.sort_array(F.collect_list(F.struct(F.col("y").cast("double").alias("y"), F.col("seq").cast("int").alias("seq"), F.struct(F.col("y").alias("y"), *rest).alias("rest"))))
    folded = x.groupBy("unit", "part").agg(items.alias("items")).select("unit", F.explode("items").alias("i"), F.aggregate("items", start, step, lambda s: s["starts"]).alias("starts"))
    x = folded.select("unit", F.col("i.seq").cast(tiles.schema["seq"].dataType).alias("seq"), "i.rest.*", F.array_contains("starts", F.col("i.seq")).cast("int").alias("start"))
    x = x.withColumn("row_idx", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).select(*tiles.columns, "row_idx")
    x = x.withColumn("row_idx", F.col("row_idx").cast("int")).withColumn("col_idx", F.row_number().over(Window.partitionBy("unit", "row_idx").orderBy("x", "y", "seq")) - 1)
    return x.withColumn("read_pos", F.row_number().over(Window.partitionBy("unit").orderBy("row_idx", "col_idx")) - 1)


def reading_edges(t: DataFrame) -> DataFrame:
    nxt = F.lead("seq").over(Window.partitionBy("unit").orderBy("read_pos"))
    return t.select("unit", F.col("seq").alias("src"), nxt.alias("dst")).filter("dst IS NOT NULL")


def side_edges(t: DataFrame) -> DataFrame:
    """Neighbours in a row, both ways."""
    nxt = F.lead("seq").over(Window.partitionBy("unit", "row_idx").orderBy("col_idx"))
    right = t.select("unit", F.col("seq").alias("src"), nxt.alias("dst"), F.lit("right").alias("direction")).filter("dst IS NOT NULL")
    return right.union(right.select("unit", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("left").alias("direction")))


def below_edges(t: DataFrame) -> DataFrame:
    """Each tile and the nearest of the next row that overlaps it in x, both ways."""
    a = t.select("unit", F.col("seq").alias("src"), (F.col("row_idx") + 1).alias("row_idx"), F.col("x").alias("ax"), F.col("w").alias("aw"))
    b = t.select("unit", F.col("seq").alias("dst"), "row_idx", "x", "w")
    j = a.join(b, ["unit", "row_idx"]).filter((F.col("x") < F.col("ax") + F.col("aw")) & (F.col("ax") < F.col("x") + F.col("w")))
    gap = F.abs((F.col("ax") + F.col("aw") / 2) - (F.col("x") + F.col("w") / 2))
    n = F.row_number().over(Window.partitionBy("unit", "src").orderBy(gap, "x", "dst"))
    down = j.withColumn("n", n).filter("n = 1").select("unit", "src", "dst", F.lit("below").alias("direction"))
    return down.union(down.select("unit", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("above").alias("direction")))


def section_parent():
    """seq of the heading above a tile, over tiles in reading order."""
    order = Window.partitionBy("unit").orderBy("read_pos").rowsBetween(Window.unboundedPreceding, -1)
    level = heading_level(F.col("tag"))
    up = [F.last(F.when(level <= k, F.col("seq")), ignorenulls=True).over(order) for k in range(1, 5)]
    parent = F.when(level.isNull(), up[3])
    for k in range(2, 5):
        parent = parent.when(level == k, up[k - 2])
    return parent


def section_edges(t: DataFrame) -> DataFrame:
    """Parent: the nearest heading before of a smaller level; for content the nearest heading before."""
    return t.select("unit", section_parent().alias("src"), F.col("seq").alias("dst")).filter("src IS NOT NULL")


def link_edges(t: DataFrame, links: DataFrame, most: int = CONFIG.max_linked_tiles) -> DataFrame:
    """(unit, src, dst, anchor_text): links(unit, seq, nth, href, anchor_text) of the first `most` tiles that have links, in reading order."""
    having = t.join(links.select("unit", "seq").distinct(), ["unit", "seq"], "left_semi")
    first = having.withColumn("n", F.row_number().over(Window.partitionBy("unit").orderBy("read_pos"))).filter(F.col("n") <= most)
    return first.select("unit", "seq").join(links, ["unit", "seq"]).select("unit", F.col("seq").alias("src"), F.col("href").alias("dst"), "anchor_text")


def capped_neighbours(pairs: DataFrame, most: int = CONFIG.max_semantic_neighbours) -> DataFrame:
    """Pairs taken greedily by similarity while both ends have fewer than `most`; pairs(unit, i, j, similarity) of one unit go to Python together, many units at a time."""

    def run(t: pa.Table) -> pa.Table:
        unit, i, j = unit_codes(t), t["i"].to_numpy(), t["j"].to_numpy()
        order = np.lexsort((j, i, -t["similarity"].to_numpy(), unit))
        degree: dict[tuple[int, int], int] = {}
        keep = []
        for k, u, a, b in zip(order.tolist(), unit[order].tolist(), i[order].tolist(), j[order].tolist()):
            if degree.get((u, a), 0) < most and degree.get((u, b), 0) < most:
                degree[u, a], degree[u, b] = degree.get((u, a), 0) + 1, degree.get((u, b), 0) + 1
                keep.append(k)
        return t.select(["unit", "i", "j", "similarity"]).take(pa.array(keep, "int64"))

    pair = [F.col(c).cast("int").alias(c) for c in ("i", "j")]
    return map_units(pairs.select("unit", *pair, "similarity"), run, "unit string, i int, j int, similarity double", "i", "j", "similarity")


def tile_id(seq):
    """tile_ and at least four digits."""
    s = seq.cast("string")
    return F.concat(F.lit("tile_"), F.when(F.length(s) < 4, F.lpad(s, 4, "0")).otherwise(s))


def _edge(df: DataFrame, relation: str, src=None, dst=None) -> DataFrame:
    node = tile_id
    have = {c: F.col(c) if c in df.columns else F.lit(None).cast("double" if c == "similarity" else "string") for c in EDGE[4:]}
    return df.select("unit", (node(F.col("src")) if src is None else src).alias("src"), (node(F.col("dst")) if dst is None else dst).alias("dst"), F.lit(relation).alias("relation"), *[v.alias(k) for k, v in have.items()])


def edges(t: DataFrame, links: DataFrame | None = None, semantic: bool = False) -> DataFrame:
    """All relations of tiles in reading order; equal edges are kept apart."""
    # what windows tell of a tile goes out in one pass; only the row below needs a join
    nxt = F.lead("seq").over(Window.partitionBy("unit").orderBy("read_pos"))
    right = F.lead("seq").over(Window.partitionBy("unit", "row_idx").orderBy("col_idx"))
    x = t.withColumn("nxt", nxt).withColumn("right", right).withColumn("parent", section_parent())
    edge = lambda src, dst, relation, direction: F.struct(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), F.lit(direction).cast("string").alias("direction"))
    own, n, r = tile_id(F.col("seq")), tile_id(F.col("nxt")), tile_id(F.col("right"))
    found = F.array(edge(F.lit("page"), own, "contains", None), edge(own, n, "reading_order", None), edge(own, r, "layout_adjacency", "right"), edge(r, own, "layout_adjacency", "left"), edge(tile_id(F.col("parent")), own, "section_hierarchy", None))
    x = x.select("unit", F.explode(F.filter(found, lambda e: e["src"].isNotNull() & e["dst"].isNotNull())).alias("e"))
    out = x.select("unit", "e.src", "e.dst", "e.relation", "e.direction", F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("string").alias("anchor_text"))
    out = out.unionByName(_edge(below_edges(t), "layout_adjacency"))
    if links is not None:
        e = link_edges(t, links)
        out = out.unionByName(_edge(e, "links_to", dst=F.concat(F.lit("ext::"), F.col("dst"))))
    if semantic:
        p = capped_neighbours(similar_pairs(t.select("unit", F.col("read_pos").alias("pos"), "text")))
        at = t.select("unit", "read_pos", "seq")
        p = p.join(at.select("unit", F.col("read_pos").alias("i"), F.col("seq").alias("src")), ["unit", "i"]).join(at.select("unit", F.col("read_pos").alias("j"), F.col("seq").alias("dst")), ["unit", "j"])
        out = out.unionByName(_edge(p, "semantic_neighbor"))
    return out


def nodes(t: DataFrame) -> DataFrame:
    page = t.groupBy("unit").agg(F.min("seq").alias("k")).select("unit", F.lit("page").alias("node_id"), F.lit(-1).alias("pos"), F.lit("page").alias("type"), F.lit(None).cast("string").alias("tag"), F.lit(None).cast("string").alias("text"), F.lit("active").alias("state"))
    tile = t.select("unit", tile_id(F.col("seq")).alias("node_id"), F.col("read_pos").alias("pos"), F.lit("element").alias("type"), "tag", F.substring("text", 1, CONFIG.preview_chars).alias("text"), F.lit("inactive").alias("state"))
    return page.unionByName(tile)


def _xml(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def to_xml(n: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One document a page: a page element with its tiles in reading order. pages(unit, url, title): what the page element says; by default no address, and the unit as title."""
    line = F.concat(F.lit('  <element id="'), "node_id", F.lit('" tag="'), "tag", F.lit('" state="'), "state", F.lit('">'), _xml(F.col("text")), F.lit("</element>"))
    body = n.filter("type = 'element'").groupBy("unit").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("l")))), lambda s: s["l"]), "\n").alias("body"))
    if pages is None:
        body = body.withColumn("url", F.lit("")).withColumn("title", F.col("unit"))
    else:
        body = body.join(pages.select("unit", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("title", F.lit("")).alias("title")), "unit")
    return body.select("unit", F.concat(F.lit('<?xml version="1.0" ?>\n<page url="'), _xml(F.col("url")), F.lit('" title="'), _xml(F.col("title")), F.lit('">\n'), "body", F.lit("\n</page>\n")).alias("xml"))


def edge_ids(e: DataFrame) -> DataFrame:
    """Edges with id src__dst__key, key counting equal (src, dst) from 0."""
    key = F.row_number().over(Window.partitionBy("unit", "src", "dst").orderBy("relation", "direction")) - 1
    return e.withColumn("id", F.concat_ws("__", "src", "dst", key.cast("string")))


def graph_json(n: DataFrame, e: DataFrame) -> DataFrame:
    """(unit, json): nodes in page order and edges with their ids, as one object a page."""
    node = F.struct("pos", F.to_json(F.struct(F.col("node_id").alias("id"), "type", "tag", "text", "state")).alias("j"))
    edge = F.struct("id", F.to_json(F.struct("id", F.col("src").alias("source"), F.col("dst").alias("target"), "relation", "direction", "similarity", "anchor_text")).alias("j"))
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda s: s["j"]), ","), F.lit("]"))
    a, b = n.groupBy("unit").agg(listed(node).alias("nodes")), edge_ids(e).groupBy("unit").agg(listed(edge).alias("edges"))
    return a.join(b, "unit", "left").select("unit", F.concat(F.lit('{"nodes":'), "nodes", F.lit(',"edges":'), F.coalesce("edges", F.lit("[]")), F.lit("}")).alias("json"))


def relation_stats(e: DataFrame) -> DataFrame:
    """Edges of each relation, and their median over pages that have any."""
    per = e.groupBy("unit", "relation").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("relation").agg(F.sum("k").alias("n_edges"), F.percentile("k", 0.5).alias("median_per_unit"))


def page_links(contains: DataFrame, links: DataFrame) -> DataFrame:
    """Element links lifted to pages: distinct (unit, target) with the first position."""
    return contains.join(links, ["unit", "seq"]).groupBy("unit", "href").agg(F.min(F.struct("seq", "nth")).alias("f")).select("unit", "href", F.col("f.seq").alias("first_seq"))
