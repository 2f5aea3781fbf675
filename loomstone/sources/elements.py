"""Elements with boxes: from tables of boxes, from HTML, and from plain text by a deterministic flow layout."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Protocol
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.config import CONFIG, ELEMENT_TAGS, NOISE_SELECTORS, NOISE_TAGS, VOID_TAGS


class LayoutProvider(Protocol):
    """Gives elements their boxes; a browser's measurements can stand in for `flow_layout`."""

    def __call__(self, elements: DataFrame) -> DataFrame: ...


def html_elements(pages: DataFrame, preview: int = CONFIG.preview_chars) -> DataFrame:
    """(page_id, seq, tag, text_preview) of block elements in document order, noise removed first; JVM expressions only."""
    gone = "|".join((*NOISE_TAGS, "head"))
    h = F.regexp_replace(F.col("html"), rf"(?si)<!--.*?-->|<({gone})[ >].*?</\1>", "")
    h = F.regexp_replace(h, r"(?i)<(h1|h2|h3|h4|p|table|figure|ul|ol|blockquote|pre)( [^>]*)?>", "\x01$1\x02")
    part = F.split(h, "\x01")
    rows = pages.select("page_id", F.posexplode(F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0)))).alias("seq", "raw"))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.substring_index("raw", "\x02", -1), r"<[^>]*>", ""), r"[ \t\n\r]+", " "))
    return rows.select("page_id", "seq", F.lower(F.substring_index("raw", "\x02", 1)).alias("tag"), F.substring(text, 1, preview).alias("text_preview"))


_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section table ul".split())


class _Elements(HTMLParser):
    """Collects [tag, depth, texts, links] of element tags outside noise, in document order. Text counts for every element that holds it."""

    def __init__(self, url: str, tags: tuple[str, ...], noise: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.base, self.based, self.tags = url, False, frozenset(tags)
        self.noise_tags = frozenset(s for s in noise if s[0] not in "#.")
        self.noise_ids, self.noise_classes = frozenset(s[1:] for s in noise if s[0] == "#"), frozenset(s[1:] for s in noise if s[0] == ".")
        self.found: list[list] = []
        self.stack: list[tuple[str, list | None, bool]] = []  # tag, element, noise
        self.quiet = 0
        self.anchor: list | None = None

    def handle_starttag(self, tag, attrs):
        attrs = dict(reversed(attrs))
        if tag == "base" and not self.based and attrs.get("href"):
            self.base, self.based = urljoin(self.base, attrs["href"].strip()), True
        if tag in _CLOSES_P and any(t == "p" for t, _, _ in self.stack):
            self.handle_endtag("p")
        elif tag in ("li", "dt", "dd", "tr", "td", "th") and self.stack and self.stack[-1][0] == tag:
            self.handle_endtag(tag)
        noise = tag in self.noise_tags or attrs.get("id") in self.noise_ids or bool(self.noise_classes & set((attrs.get("class") or "").split()))
        element = None
        if tag in self.tags and not noise and not self.quiet:
            element = [tag, len(self.stack), [], []]
            self.found.append(element)
        if tag == "a" and not self.quiet and not noise:
            holder = next((e for t, e, _ in reversed(self.stack) if e is not None and t == "p"), None)
            href = (attrs.get("href") or "").strip()
            if holder is not None and href and not href.startswith("#"):
                self.anchor = [href, []]
                holder[3].append(self.anchor)
        if tag not in VOID_TAGS:
            self.stack.append((tag, element, noise))
            self.quiet += noise
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag == "a":
            self.anchor = None
        if any(t == tag for t, _, _ in self.stack):
            while True:
                t, _, noise = self.stack.pop()
                self.quiet -= noise
                if t == tag:
                    break

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if self.quiet or any(t in ("title", "head", "template") for t, _, _ in self.stack):
            return
        for _, e, _ in self.stack:
            if e is not None:
                e[2].append(data)
        if self.anchor is not None:
            self.anchor[1].append(data)


#: A character reference without its semicolon, other than &amp.
_OPEN_REFERENCE = re.compile(r"&(?!amp)(?=#?[A-Za-z0-9]++(?!;))")


def page_elements(html: str, url: str, preview: int = CONFIG.preview_chars, tags: tuple[str, ...] = ELEMENT_TAGS, noise: tuple[str, ...] = NOISE_SELECTORS) -> list[tuple[str, int, str, list[dict]]]:
    """(tag, depth, text, links) of a page's elements; links, from paragraphs only, are absolute http(s) addresses with the anchor's text."""
    page = _Elements(url, tags, noise)
    page.feed(html)
    page.close()
    out = []
    for tag, depth, texts, found in page.found:
        links = []
        for href, text in found:
            try:
                full = urljoin(page.base, href)
            except ValueError:
                continue  # no URL
            if full.lower().startswith(("http://", "https://")):
                links.append({"href": full, "anchor_text": " ".join("".join(text).split())[:100]})
        out.append((tag, depth, " ".join("".join(texts).split())[:preview], links))
    return out


def parsed_elements(pages: DataFrame, preview: int = CONFIG.preview_chars, closed_references: bool = False) -> DataFrame:
    """(page_id, seq, tag, depth, text, links) by a parser: nested and unclosed tags, references, all noise selectors, links of paragraphs.

    closed_references: what lacks the semicolon is text and no reference (&amp excepted); by default it is read as browsers do."""
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, seq int, tag string, depth int, text string, links array<struct<href:string,anchor_text:string>>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            htmls = [_OPEN_REFERENCE.sub("&amp;", h) if h and closed_references else h for h in part["html"]]
            rows = [(i, k, *x) for i, h, u in zip(part["page_id"], htmls, part["url"]) if h for k, x in enumerate(page_elements(h, u or "", preview))]
            yield pd.DataFrame(rows, columns=["page_id", "seq", "tag", "depth", "text", "links"])

    return pages.select("page_id", "html", "url").mapInPandas(run, schema)


def html_page_elements(pages: DataFrame, layout: LayoutProvider | None = None) -> DataFrame:
    """Elements with boxes of html pages: (unit, seq, tag, x, y, w, h, depth, text, links). layout: by default the flow layout, over whole texts."""
    x = parsed_elements(pages, 1 << 30).filter("text != ''").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("unit"), F.lit(0).cast("long").alias("part"), F.col("seq").alias("i"), "text", "tag", "links")
    boxes = (layout or flow_layout)(x)
    order = Window.partitionBy("unit").orderBy("i")
    links = x.withColumn("seq", (F.row_number().over(order) - 1).cast("int")).select("unit", "seq", "links")
    return boxes.join(links, ["unit", "seq"])


class _Anchors(HTMLParser):
    """Collects [href, text] of a[href] in document order, and the page's first base target."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.base, self.found, self.open, self.hidden = "", [], None, 0

    def handle_starttag(self, tag, attrs):
        if tag == "base" and not self.base:
            self.base = (dict(reversed(attrs)).get("href") or "").strip()
        elif tag in ("script", "style"):
            self.hidden += 1
        elif tag == "a":
            attrs = dict(reversed(attrs))  # of a repeated attribute the first counts
            self.open = None
            if "href" in attrs:
                self.open = [(attrs["href"] or "").strip(), []]
                self.found.append(self.open)
        elif tag in ("br", "p", "div", "li", "td") and self.open:
            self.open[1].append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a":
            self.open = None

    def handle_data(self, data):
        if self.open and not self.hidden:
            self.open[1].append(data)


def anchors(html: str, url: str) -> list[tuple[int, str, str]]:
    """(seq, href, anchor text) of each a[href] that leads to http or https, resolved against the page's base."""
    page = _Anchors()
    page.feed(html)
    page.close()
    out = []
    for seq, (href, text) in enumerate(page.found):
        if not href or href.startswith("#"):
            continue
        try:
            full = urljoin(urljoin(url, page.base), href)
        except ValueError:
            continue  # no URL
        if full.lower().startswith(("http://", "https://")):
            out.append((seq, full, " ".join("".join(text).split())[:100]))
    return out


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, seq, href, anchor_text) of all anchors; seq counts every a[href], fragments, empty and other than http(s) targets are skipped."""
    out = pages.select("page_id").schema.add("seq", "integer").add("href", "string").add("anchor_text", "string")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, *x) for i, h, u in zip(part["page_id"], part["html"], part["url"]) if h for x in anchors(h, u or "")]
            yield pd.DataFrame(rows, columns=out.names)

    return pages.select("page_id", "html", "url").mapInPandas(run, out)


def document_lines(documents: DataFrame) -> DataFrame:
    lines = documents.select(F.concat(F.lit("d"), F.col("doc_id")).alias("unit"), F.lit(0).cast("long").alias("part"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return lines.withColumn("tag", F.lit("p"))


def conversation_lines(conversations: DataFrame) -> DataFrame:
    """Turns as a page: system h1, user h2, others p."""
    tag = F.when(F.col("role") == "system", "h1").when(F.col("role") == "user", "h2").otherwise("p")
    return conversations.select(F.concat(F.lit("c"), F.col("conv_id")).alias("unit"), F.col("turn").cast("long").alias("part"), tag.alias("tag"), F.posexplode(F.split("text", "\n")).alias("i", "text")).select("unit", "part", "i", "text", "tag")


def flow_layout(lines: DataFrame) -> DataFrame:
    """(unit, seq, tag, x, y, w, h, depth, text) of lines(unit, part, i, text, tag): text flows down, each fifth paragraph floats beside its predecessor."""
    order = Window.partitionBy("unit").orderBy("seq")
    x = lines.filter(F.col("text") != "").withColumn("seq", (F.row_number().over(Window.partitionBy("unit").orderBy("part", "i")) - 1).cast("int"))
    x = x.withColumn("floats", (F.col("tag") == "p") & (F.col("seq") % 5 == 4)).withColumn("n", F.length("text").cast("long"))
    cap = F.when(F.col("floats"), 40).otherwise(120).cast("long")
    x = x.withColumn("h", F.when(F.col("tag") == "p", 24).otherwise(40) * F.greatest(F.lit(1), F.floor((F.col("n") + cap - 1) / cap))).withColumn("w", F.greatest(F.lit(40).cast("long"), 8 * F.least("n", cap)))
    flow = F.coalesce(F.sum(F.when(~F.col("floats"), F.col("h") + 8).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("flow", flow).withColumn("y", F.when(F.col("floats"), F.lag("flow").over(order)).otherwise(F.col("flow")).cast("long"))
    left = F.when(~F.col("floats"), 0).when(F.col("seq") % 10 == 9, 800).otherwise(1000).cast("long")
    depth = F.when(F.col("floats"), 4).otherwise(3)
    return x.select("unit", "seq", "tag", left.alias("x"), "y", "w", F.col("h").cast("long").alias("h"), depth.alias("depth"), "text")


def elements(spark: SparkSession, sf_dir: str, layout: LayoutProvider = flow_layout) -> DataFrame:
    """Lines of documents and of conversations as elements of pages."""
    lines = document_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).unionByName(conversation_lines(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return layout(lines)
