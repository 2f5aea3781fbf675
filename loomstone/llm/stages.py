"""The operators as stages (spark, docs, sf_dir) -> DataFrame of a pipeline over documents.

Defined cases, for all stages: docs has doc_id and text, and source and lang where the operator reads them; every column
of docs comes out of all stages but the last under its own name with its own values, whatever it is called (only text,
and n_chars if there is one, change with the lines that go); an empty table gives an empty result. Null and empty texts
have no language, so the first stage drops them; the later stages keep them if they get them, mixing takes them as texts
of size 0, and packing as the one id that ends a document. Null ids are no one's copy. Repeated rows are documents of
their own, but for near copies, which leave one id of a group and all of its rows, and mixing, which takes as many of
the rows of one id as fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op02_language, op04_packing, op05_lines, op08_mixing, op10_jaccard
from .scratch import Scratch

#: A document goes if it has no letters, or if no language gets this share of its positions.
LEAST_SCORE = 0.3


def _named(x: DataFrame, names: list[str]) -> DataFrame:
    """c0, c1, ... under their names again."""
    return x.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language."""
    net = op02_language.fit(docs)
    x = op02_language.labelled(docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]), net, text=f"c{docs.columns.index('text')}")
    return _named(x.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages of lines; a document goes if nothing of its text is left."""
    text = f"c{docs.columns.index('text')}"
    x = op05_lines.without_repeats(docs)
    x = x.filter(~((F.col("w_removed") > 0) & (F.trim(text) == "")))
    return x.select(*[F.coalesce(F.length(text), F.lit(0)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, that of the least doc_id. Unlinked documents and null ids stay."""
    found = op10_jaccard.linked(docs)
    gone = Scratch(spark, "copies").keep(found.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    x = op08_mixing.drawn(docs).filter(F.col("m_taken_copies") > 0)
    return _named(x.withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.col("m_taken_copies").cast("int")))), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in training windows."""
    return op04_packing.packed(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
