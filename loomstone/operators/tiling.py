"""The tile packer: sequential by nature, so a pure function of one section of a page, run on column batches of whole units.

Roles come first: a heading takes the group after it along, elements that overlap are one tile, low ones in a row are
gathered, all else stands alone. Only the gathering of low ones and the numbering of slices walk over the groups.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomstone.config import CONFIG, HEADING_TAGS, Config
from loomstone.operators.sectioning import split_sections
from loomstone.operators.whole import map_units, pages_of

NO_LINKS = "cast(array() as array<struct<href:string,anchor_text:string>>)"


def _inside(a: dict, b: dict, t: float) -> bool:
    return a["x"] >= b["x"] - t and a["y"] >= b["y"] - t and a["x"] + a["w"] <= b["x"] + b["w"] + t and a["y"] + a["h"] <= b["y"] + b["h"] + t


def prune(items: list[dict], tolerance: float = 1.0) -> list[dict]:
    """Drop what lies in something kept that is no deeper; page order stays. Kept boxes are held by their top, so that only those whose reach can cover an element are tried."""
    kept: list[tuple[float, int, dict]] = []
    tallest = 0.0
    for e in sorted(items, key=lambda e: (e["depth"], e["seq"])):
        # an outer box starts at most `tallest` above what it holds
        low = bisect.bisect_left(kept, (e["y"] + e["h"] - tallest - tolerance, -1))
        high = bisect.bisect_right(kept, (e["y"] + tolerance, math.inf))
        if not any(_inside(e, k, tolerance) for _, _, k in kept[low:high]):
            bisect.insort(kept, (e["y"], e["seq"], e))
            tallest = max(tallest, e["h"])
    return sorted((k for _, _, k in kept), key=lambda e: e["seq"])


def _ratio(a: dict, b: dict) -> float:
    w = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
    h = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    small = min(a["w"] * a["h"], b["w"] * b["h"])
    return w * h / small if w > 0 and h > 0 and small > 0 else 0.0


def overlap_groups(items: list[dict], least: float = 0.15) -> list[list[dict]]:
    """Connected components of sufficient overlap, each by (y, x); headings stand alone."""
    flat = sorted((e for e in items if e["tag"] not in HEADING_TAGS), key=lambda e: e["y"])
    root = list(range(len(flat)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    open_: list[int] = []
    for j, e in enumerate(flat):  # a sweep over y: only boxes that still reach e can overlap it
        open_ = [i for i in open_ if flat[i]["y"] + flat[i]["h"] > e["y"]]
        for i in open_:
            if _ratio(flat[i], e) >= least:
                root[find(i)] = find(j)
        open_.append(j)
    groups: dict[int, list[dict]] = {}
    for i, e in enumerate(flat):
        groups.setdefault(find(i), []).append(e)
    by_place = lambda e: (e["y"], e["x"], e["seq"])
    out = [sorted(g, key=by_place) for g in groups.values()] + [[e] for e in items if e["tag"] in HEADING_TAGS]
    return sorted(out, key=lambda g: by_place(g[0]))


def _tags(members: list[dict]) -> str:
    return "+".join(dict.fromkeys(e["tag"] for e in members))


def _gathered(low: list[dict], least: float) -> Iterator[list[dict]]:
    """Low elements in a row, closed as soon as together they are high enough; a rest stays a tile of its own."""
    part: list[dict] = []
    top, bottom = math.inf, -math.inf
    for e in low:
        part.append(e)
        top, bottom = min(top, e["y"]), max(bottom, e["y"] + e["h"])
        if bottom - top >= least:
            yield part
            part, top, bottom = [], math.inf, -math.inf
    if part:
        yield part


def assembled(groups: list[list[dict]], min_height: float) -> Iterator[tuple[str, list[dict]]]:
    """(tag, members) of each tile, before it is sliced, in emission order."""
    heading = [g[0]["tag"] in HEADING_TAGS for g in groups]
    units: list[tuple[str, list[dict]]] = []
    for i, g in enumerate(groups):
        led = i > 0 and heading[i - 1]
        if heading[i]:
            if i + 1 == len(groups) or heading[i + 1]:
                units.append(("alone", g))
        elif led:
            head = groups[i - 1][0]
            units.append((f"{head['tag']}+{_tags(g)}", [head, *g]))
        elif len(g) == 1 and g[0]["h"] < min_height:
            units.append(("low", g))
        else:
            units.append(("alone", g))
    for kind, run in groupby(units, key=lambda u: u[0] if u[0] == "low" else "other"):
        if kind == "low":
            for part in _gathered([g[0] for _, g in run], min_height):
                yield "merged", part
        else:
            for tag, members in run:
                yield _tags(members) if tag == "alone" else tag, members


def slices(members: list[dict], max_height: int, page_width: float, page_height: float) -> Iterator[tuple[int, int, int, int]]:
    """(x, y, width, height) in whole pixels of the box around the members, in equal slices of at most max_height, clipped to the page."""
    x, y = min(e["x"] for e in members), min(e["y"] for e in members)
    w, h = max(e["x"] + e["w"] for e in members) - x, max(e["y"] + e["h"] for e in members) - y
    n = max(1, math.ceil(h / max_height))
    left, right = max(0, int(x)), int(min(page_width, int(x + w)))
    for k in range(n):
        top = int(y + k * (h / n))
        high = int(min(h / n, page_height - top))
        end = min(int(page_height), top + high)
        if high > 0 and right > left and end > max(0, top):
            yield left, max(0, top), right - left, end - max(0, top)


def pack_page(items: list[dict], config: Config = CONFIG, size: tuple[float, float] | None = None) -> list[dict]:
    """Tiles of one section; size: the page's width and height, by default what its elements reach."""
    width, height = size or (max((e["x"] + e["w"] for e in items), default=0), max((e["y"] + e["h"] for e in items), default=0))
    groups = overlap_groups(prune(items, config.containment_tolerance), config.min_overlap_ratio)
    out = []
    for tag, members in assembled(groups, config.min_tile_height):
        text = " ".join(e["text"][: config.preview_chars] for e in members)[: config.preview_chars]
        rest = {"dom_tag": tag, "text_preview": text, "source_ids": [e["seq"] for e in members], "links": [link for e in members for link in (e.get("links") if e.get("links") is not None else ())]}
        out += [{"x": a, "y": b, "width": c, "height": d, **rest} for a, b, c, d in slices(members, config.max_tile_height, width, height)]
    return out


def pruned(e: DataFrame, tolerance: float = CONFIG.containment_tolerance) -> DataFrame:
    """Elements of each unit without those nested in something kept: exact for any tolerance, since containment with one is not transitive. Only boxes go to Python."""

    def run(t: pa.Table) -> pa.Table:
        kept = [(page[0]["unit"], k["seq"]) for page in pages_of(t) for k in prune(page, tolerance)]
        return pa.table({"unit": pa.array([u for u, _ in kept], "string"), "seq": pa.array([k for _, k in kept], "int32")})

    kept = map_units(e.select("unit", "seq", "x", "y", "w", "h", "depth"), run, "unit string, seq int", "seq", "x", "y", "w", "h", "depth")
    return e.join(kept, ["unit", "seq"], "left_semi")


SCHEMA = "unit string, tile_seq int, tile_id string, x int, y int, width int, height int, dom_tag string, text_preview string, source_ids array<int>, links array<struct<href:string,anchor_text:string>>"


def build_tiles(e: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Tiles of each unit of elements(unit, seq, tag, x, y, w, h, depth, text[, links]).

    Units go to Python whole and many at a time; texts are clipped to previews before they leave the JVM, so a batch holds boxes and previews only."""
    links = F.col("links") if "links" in e.columns else F.expr(NO_LINKS).alias("links")

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(t: pa.Table) -> pa.Table:
        rows = []
        for page in pages_of(t):
            page.sort(key=lambda r: r["seq"])
            rows += [{"unit": page[0]["unit"], "tile_seq": i, "tile_id": f"tile_{i:04d}", **r} for i, r in enumerate(pack_page(page, config))]
        return pa.Table.from_pylist(rows, schema)

    box = ("seq", "tag", "x", "y", "w", "h", "depth")
    x = e.select("unit", *box, F.substring("text", 1, config.preview_chars).alias("text"), links)
    return map_units(x, run, SCHEMA, *box, "text", "links")


def build_section_tiles(e: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Tiles of pages of any height: pages higher than max_page_height are cut in sections first, and each section is a unit `page__secN` of its own."""
    page = e.groupBy("unit").agg((F.max(F.col("y") + F.col("h")) - F.min("y")).alias("page_h"))
    s = split_sections(e, config.max_page_height).join(page, "unit")
    unit = F.when(F.col("page_h") > config.max_page_height, F.concat("unit", F.lit("__sec"), F.col("section").cast("string"))).otherwise(F.col("unit"))
    return build_tiles(s.select(unit.alias("unit"), *[c for c in e.columns if c != "unit"]), config)
