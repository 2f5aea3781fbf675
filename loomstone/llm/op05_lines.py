"""Line deduplication by overlapping three-line windows, in DataFrame functions alone.

A text's lines are cut at \\n. Each three consecutive lines make a window, except three blank ones. Windows are hashed
to two 64-bit numbers; of the windows of one hash, that of the least (doc_id, text, position) is the first, and each
later one covers its three positions. Covered positions are merged and their lines removed.

Windows are counted by hash with partial sums before the shuffle, and only windows that repeat come back; a window
that a third of all documents hold meets one row of its hash in a join that Spark can split. Both joins are merge
joins at every size, since what they join grows with the input.

Defined cases: null text stays null; texts of fewer than three lines have no window and stay; a null doc_id sorts
last; rows with equal doc_id and text are one place, so what one keeps all keep; a text that loses every line becomes
empty; an empty table gives an empty result; other columns, whatever their names, are passed on by `deduplicated`, whose
n_lines and n_removed replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, read_table

SPAN = 3
_LAST = (1 << 63) - 1


def windows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(w_id, w_text, w_pos, w_h1, w_h2) of every window."""
    lines = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("w_id"), F.xxhash64(F.col(text)).alias("w_text"), F.split(F.col(text), "\n", -1).alias("l")).filter(F.size("l") >= SPAN)
    at = [F.col("l")[F.col("w_pos") + k] for k in range(SPAN)]
    rows = lines.withColumn("w_pos", F.explode(F.sequence(F.lit(0), F.size("l") - SPAN)))
    rows = rows.filter(F.trim(F.concat(*at)) != "")
    return rows.select("w_id", "w_text", "w_pos", F.xxhash64(*at).alias("w_h1"), F.xxhash64(F.lit(977), *at[::-1]).alias("w_h2"))


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs' columns as c0, c1, ... with the text's repeated windows removed, and w_lines and w_removed, the numbers of its lines and of those removed."""
    scratch = Scratch(docs.sparkSession, "lines")
    held = scratch.keep(windows(docs, text, doc_id), "windows")
    again = held.groupBy("w_h1", "w_h2").agg(F.min(F.struct("w_id", "w_text", "w_pos")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = held.join(again.hint("merge"), ["w_h1", "w_h2"]).filter(F.struct("w_id", "w_text", "w_pos") != F.col("first"))
    covered = later.groupBy("w_id", "w_text").agg(F.collect_set("w_pos").alias("w_at"))
    covered = covered.select("w_id", "w_text", F.array_distinct(F.flatten(F.transform("w_at", lambda p: F.sequence(p, p + SPAN - 1)))).alias("w_gone"))
    covered = scratch.keep(covered, "covered")
    scratch.drop(held)
    names = docs.columns
    x = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("w_key"), F.xxhash64(F.col(text)).alias("w_own"))
    own = F.col(f"c{names.index(text)}")
    x = x.join(covered.hint("merge"), (F.col("w_key") == F.col("w_id")) & (F.col("w_own") == F.col("w_text")), "left").withColumn("w_split", F.split(own, "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("w_split") - 1), "w_gone")
    new = F.when(F.col("w_gone").isNull(), own).otherwise(F.array_join(F.transform(kept, lambda i: F.col("w_split")[i]), "\n"))
    count = F.when(own.isNull(), 0).otherwise(F.size("w_split")).cast("long")
    return x.select(*[new.alias(f"c{i}") if c == text else F.col(f"c{i}") for i, c in enumerate(names)], count.alias("w_lines"), F.coalesce(F.size("w_gone"), F.lit(0)).cast("long").alias("w_removed"))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the text's repeated windows removed, and with n_lines and n_removed."""
    x = without_repeats(docs, text, doc_id)
    return x.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ("n_lines", "n_removed")], F.col("w_lines").alias("n_lines"), F.col("w_removed").alias("n_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, text, i - 1 AS pos, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS win
      FROM (SELECT doc_id, text, ls, unnest(range(1, len(ls) - 1)) AS i FROM l WHERE len(ls) >= 3)
      WHERE trim(ls[i] || ls[i + 1] || ls[i + 2]) <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS LAST, pos) AS nth FROM w),
c AS (SELECT DISTINCT doc_id, text, unnest([pos, pos + 1, pos + 2]) AS pos FROM n WHERE nth > 1),
k AS (SELECT doc_id, text, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM l),
j AS (SELECT k.doc_id, k.text, string_agg(CASE WHEN c.pos IS NULL THEN k.line END, chr(10) ORDER BY k.pos) AS new_text,
             count(*) AS n_lines, count(c.pos) AS n_removed
      FROM k LEFT JOIN c ON k.doc_id = c.doc_id AND k.text = c.text AND k.pos = c.pos GROUP BY k.doc_id, k.text)
SELECT l.doc_id, CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(j.new_text, '') END AS text, coalesce(j.n_lines, 0)::BIGINT AS n_lines, coalesce(j.n_removed, 0)::BIGINT AS n_removed
FROM l LEFT JOIN j ON l.doc_id = j.doc_id AND l.text = j.text
"""
