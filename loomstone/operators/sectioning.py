"""Sections of long pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.config import CONFIG


def heading_sections(e: DataFrame) -> DataFrame:
    """Elements with sec_idx and title: a section starts at each h1 or h2, what stands before has title ''."""
    order = Window.partitionBy("unit").orderBy("y", "seq").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("tag").isin("h1", "h2")
    n = F.sum(starts.cast("int")).over(order)
    first = F.first(starts).over(order)
    title = F.coalesce(F.last(F.when(starts, F.col("text")), ignorenulls=True).over(order), F.lit(""))
    return e.withColumn("sec_idx", (n - first.cast("int")).cast("int")).withColumn("title", title)


def height_chunks(e: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Elements with chunk: a new chunk starts where an element ends more than `most` below the chunk's first one.

    An ordered fold over each group's elements, inside the JVM."""
    items = F.sort_array(F.collect_list(F.struct(F.col("y").cast("double").alias("y"), F.col("seq").cast("int").alias("seq"), F.col("h").cast("double").alias("h"))))
    start = F.struct(F.lit(None).cast("double").alias("top"), F.expr("cast(array() as array<int>)").alias("starts"))

    def step(s, i):  # only where a chunk starts is there something to keep
        new = s["top"].isNull() | (i["y"] + i["h"] - s["top"] > most)
        return F.struct(F.when(new, i["y"]).otherwise(s["top"]).alias("top"), F.when(new, F.array_append(s["starts"], i["seq"])).otherwise(s["starts"]).alias("starts"))

    folded = e.groupBy(*keys).agg(items.alias("items")).select(*keys, F.aggregate("items", start, step, lambda s: s["starts"]).alias("starts"))
    order = Window.partitionBy(*keys).orderBy("y", "seq").rowsBetween(Window.unboundedPreceding, 0)
    x = e.join(folded, keys).withColumn("chunk", (F.sum(F.array_contains("starts", F.col("seq")).cast("int")).over(order) - 1).cast("int"))
    return x.drop("starts")


def split_sections(e: DataFrame, most: int = CONFIG.max_page_height) -> DataFrame:
    """Elements with section (dense from 0) and section_title: sections higher than `most` are cut again, later parts called (suite n)."""
    x = height_chunks(heading_sections(e), ["unit", "sec_idx"], most)
    index = F.dense_rank().over(Window.partitionBy("unit").orderBy("sec_idx", "chunk")) - 1
    title = F.when(F.col("chunk") == 0, F.col("title")).otherwise(F.concat("title", F.lit(" (suite "), (F.col("chunk") + 1).cast("string"), F.lit(")")))
    return x.withColumn("section", index.cast("int")).withColumn("section_title", title)


def section_units(e: DataFrame, most: int) -> DataFrame:
    """(unit, section_unit, section, section_title, url_suffix, top, height, n_elements); only oversized pages are split."""
    page = e.groupBy("unit").agg((F.max(F.col("y") + F.col("h")) - F.min("y")).alias("page_h"))
    s = split_sections(e, most).join(page, "unit")
    over = F.col("page_h") > most
    s = s.withColumn("section", F.when(over, F.col("section")).otherwise(0)).withColumn("section_title", F.when(over, F.col("section_title")).otherwise(""))
    g = s.groupBy("unit", "section", "section_title", over.alias("over")).agg(F.min("y").cast("long").alias("top"), (F.max(F.col("y") + F.col("h")) - F.min("y")).cast("long").alias("height"), F.count(F.lit(1)).alias("n_elements"))
    name = F.when(F.col("over"), F.concat("unit", F.lit("__sec"), F.col("section").cast("string"))).otherwise(F.col("unit"))
    return g.select("unit", name.alias("section_unit"), "section", "section_title", F.when(F.col("over") & (F.col("section") > 0), F.concat(F.lit("#section-"), F.col("section").cast("string"))).otherwise("").alias("url_suffix"), "top", "height", "n_elements")
