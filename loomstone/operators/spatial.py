"""Joins and aggregates over boxes of one page (unit). Pairs are always equi-joined on the unit first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.config import CONFIG
from loomstone.functions.geometry import contained, overlap_ratio, visual_tokens

BOX = ("x", "y", "w", "h")


def _side(e: DataFrame, name: str) -> DataFrame:
    return e.select("unit", *[F.col(c).alias(f"{name}_{c}") for c in e.columns if c != "unit"])


def _box(name: str) -> list[Column]:
    return [F.col(f"{name}_{c}") for c in BOX]


def unnested(e: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Elements not contained in an earlier one by (depth, seq): the anti-join form, exact for tolerance 0."""
    band = CONFIG.band_height
    reach = F.sequence(F.floor((F.col("y") - tolerance) / band), F.floor((F.col("y") + F.col("h") + tolerance) / band))
    a, b = _side(e.withColumn("band", F.floor(F.col("y") / band)), "a"), _side(e.select("unit", "seq", "depth", *BOX, F.explode(reach).alias("band")), "b")
    before = (F.col("b_depth") < F.col("a_depth")) | ((F.col("b_depth") == F.col("a_depth")) & (F.col("b_seq") < F.col("a_seq")))
    out = a.join(b, (a.unit == b.unit) & (a.a_band == b.b_band) & before & contained(*_box("a"), *_box("b"), tolerance), "left_anti")
    return out.select("unit", *[F.col(f"a_{c}").alias(c) for c in e.columns if c != "unit"])


def overlap_pairs(e: DataFrame, least: float = CONFIG.min_overlap_ratio) -> DataFrame:
    """(unit, i, j, ratio), i < j, headings left out. Bands of y make the join an equi-join beyond the unit."""
    flat = e.filter(~F.col("tag").isin("h1", "h2", "h3", "h4")).select("unit", "seq", *BOX)
    banded = flat.withColumn("band", F.explode(F.sequence(F.floor(F.col("y") / CONFIG.band_height), F.floor((F.col("y") + F.col("h")) / CONFIG.band_height))))
    a, b = _side(banded, "a"), _side(banded, "b")
    ratio = overlap_ratio(*_box("a"), *_box("b"))
    j = a.join(b, (a.unit == b.unit) & (a.a_band == b.b_band) & (F.col("a_seq") < F.col("b_seq")) & (ratio >= least))
    # a pair that shares bands counts in the first of them
    first = F.col("a_band") == F.greatest(F.floor(F.col("a_y") / CONFIG.band_height), F.floor(F.col("b_y") / CONFIG.band_height))
    return j.filter(first).select(a.unit, F.col("a_seq").alias("i"), F.col("b_seq").alias("j"), ratio.alias("ratio"))


def union_boxes(e: DataFrame, *keys: str) -> DataFrame:
    """The box around each group, its distinct tags in order and its elements."""
    tags = F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("seq", "tag"))), lambda s: s["tag"])), "+")
    return e.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), tags.alias("tags"), F.count(F.lit(1)).alias("n_elements"))


def page_heights(e: DataFrame, most: int = CONFIG.max_page_height) -> DataFrame:
    height = F.max(F.col("y") + F.col("h")) - F.min("y")
    return e.groupBy("unit").agg(height.alias("height")).withColumn("oversized", F.col("height") > most)


def grid_bands(e: DataFrame, band: int = CONFIG.band_height, width: int = CONFIG.band_width) -> DataFrame:
    """Equal bands of a page, centred in its width, with the text of the elements that they meet."""
    page = e.groupBy("unit").agg(F.max(F.col("y") + F.col("h")).alias("height"), F.max(F.col("x") + F.col("w")).alias("page_w"))
    bands = page.withColumn("band", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("height") / band) - 1).cast("int"))))
    met = e.filter(F.trim("text") != "").withColumn("band", F.explode(F.sequence(F.floor(F.col("y") / band), F.floor((F.col("y") + F.col("h") - 1) / band))))
    text = met.groupBy("unit", F.col("band").cast("int").alias("band")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.substring("text", 1, CONFIG.preview_chars).alias("t")))), lambda s: s["t"]), " ").alias("t"))
    out = bands.join(text, ["unit", "band"], "left")
    return out.select("unit", "band", F.greatest(F.lit(0), F.floor((F.col("page_w") - width) / 2)).cast("long").alias("x"), (F.col("band") * band).cast("long").alias("y"), F.least(F.lit(band), F.col("height") - F.col("band") * band).cast("long").alias("h"), F.substring(F.coalesce("t", F.lit("")), 1, CONFIG.preview_chars).alias("text_preview"))


def text_chunks(e: DataFrame, cutoff: int | None = None, size: int = CONFIG.chunk_chars) -> DataFrame:
    """The page's text above the cutoff in windows of `size` code points."""
    kept = e.filter(F.trim("text") != "") if cutoff is None else e.filter((F.trim("text") != "") & (F.col("y") < cutoff))
    page = kept.groupBy("unit").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), " ").alias("t"))
    x = page.withColumn("chunk", F.explode(F.sequence(F.lit(0), (F.ceil(F.length("t") / size) - 1).cast("int"))))
    return x.select("unit", "chunk", F.substring(F.col("t"), (F.col("chunk") * size + 1).cast("int"), F.lit(size)).alias("chunk_text"))


def patches(e: DataFrame, most: int = 300) -> DataFrame:
    """Equal slices of at most `most` height of tall boxes, clipped to the page; top and height are cut to whole pixels each, empty slices dropped."""
    n = F.greatest(F.lit(1), F.ceil(F.col("h") / most)).cast("int")
    page = Window.partitionBy("unit")
    x = e.withColumn("page_h", F.max(F.col("y") + F.col("h")).over(page)).withColumn("page_w", F.max(F.col("x") + F.col("w")).over(page))
    x = x.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("slice", F.col("h") / F.col("n"))
    x = x.withColumn("top", (F.col("y") + F.col("k") * F.col("slice")).cast("long"))
    x = x.withColumn("high", F.least("slice", F.col("page_h") - F.col("top")).cast("long")).withColumn("left", F.greatest(F.lit(0), F.col("x").cast("long")))
    right = F.least(F.col("page_w"), (F.col("x") + F.col("w")).cast("long")).cast("long")
    return x.select("unit", "seq", F.col("k").alias("patch"), F.col("left").alias("x"), F.greatest(F.lit(0), F.col("top")).alias("y"), (right - F.col("left")).alias("w"), F.col("high").alias("h")).filter("h > 0 AND w > 0")


def large_enough(e: DataFrame, least: float = 2.0) -> DataFrame:
    """Elements wider and higher than `least` pixels."""
    return e.filter((F.col("w") > least) & (F.col("h") > least))


def contained_pairs(e: DataFrame, tolerance: float = CONFIG.containment_tolerance, band: int = CONFIG.band_height) -> DataFrame:
    """(unit, i, j): element i lies in element j, up to the tolerance. An outer box reaches over the inner one's top edge, so the join is on the band of that edge beyond the unit."""
    inner = _side(e.select("unit", "seq", *BOX), "a").withColumn("band", F.floor(F.col("a_y") / band))
    reach = F.sequence(F.floor((F.col("y") - tolerance) / band), F.floor((F.col("y") + F.col("h") + tolerance) / band))
    outer = _side(e.select("unit", "seq", *BOX, F.explode(reach).alias("band")), "b").withColumnRenamed("b_band", "band")
    found = inner.join(outer, ["unit", "band"]).filter((F.col("a_seq") != F.col("b_seq")) & contained(*_box("a"), *_box("b"), tolerance))
    return found.select("unit", F.col("a_seq").alias("i"), F.col("b_seq").alias("j"))


def size_means(e: DataFrame) -> DataFrame:
    """(kind, units_per_page, pixels_per_unit, pixels_per_page) by elements' kind: means over pages of each page's own count and means."""
    page = e.groupBy("kind", "unit").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("w") * F.col("h")).alias("mean"), F.sum(F.col("w") * F.col("h")).alias("sum"))
    return page.groupBy("kind").agg(F.round(F.avg("n"), 4).alias("units_per_page"), F.round(F.avg("mean"), 4).alias("pixels_per_unit"), F.round(F.avg("sum"), 4).alias("pixels_per_page"))


def pixel_budget(e: DataFrame, cap: int = 1_000_000) -> DataFrame:
    """Pixels and visual tokens of each page, uncapped and with a cap a tile."""
    w, h = F.col("w"), F.col("h")
    x = e.groupBy("unit").agg(F.count(F.lit(1)).alias("n_units"), F.sum(w * h).cast("long").alias("pixels"), F.sum(F.least(w * h, F.lit(cap))).cast("long").alias("capped_pixels"))
    return x.withColumn("visual_tokens", F.round(visual_tokens(F.col("pixels"), F.lit(1), CONFIG.patch_px), 4))
