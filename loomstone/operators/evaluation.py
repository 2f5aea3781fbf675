"""Retrieval and answer metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import anls, contains_answer, exact_match, token_f1


def recall_and_mrr(ranks: DataFrame, *keys: str, at: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """ranks(rank from 0)."""
    return ranks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg((F.col("rank") < k).cast("double")), 4).alias(f"recall_at_{k}") for k in at], F.round(F.avg(1 / (F.col("rank") + 1)), 4).alias("mrr"))


def percentile_rank(rank, n):
    """Of a rank from 1 among n: 1 for the first, 0 for the last, 1 for a single one."""
    return F.when(n <= 1, 1.0).otherwise(1 - (rank - 1) / F.nullif(n - 1, F.lit(0)))


def attachment(ranked: DataFrame, answers: DataFrame) -> DataFrame:
    """(condition, question, best, n): the best rank (from 1) of an item that holds the answer, null if none does.

    ranked(condition, unit, rank, text); answers(unit, question, answer)."""
    return best_ranks(ranked.join(answers, "unit").withColumn("holds", contains_answer(F.col("answer"), F.col("text"))))


def best_ranks(ranked: DataFrame) -> DataFrame:
    """As attachment, of ranked(condition, question, rank, holds), where it is told already which items hold the answer."""
    return ranked.groupBy("condition", "question").agg(F.min(F.when(F.col("holds"), F.col("rank") + 1)).alias("best"), F.count(F.lit(1)).alias("n"))


def attachment_summary(found: DataFrame, *keys: str) -> DataFrame:
    rank = percentile_rank(F.col("best"), F.col("n"))
    share = lambda k: F.round(F.avg(F.when(F.col("best").isNotNull(), (F.col("best") <= k).cast("double"))), 4)
    return found.groupBy("condition", *keys).agg(F.count(F.lit(1)).alias("questions"), F.count("best").alias("attributable"), F.round(F.count("best") / F.count(F.lit(1)), 4).alias("attachment_rate"), share(1).alias("recall_at_1"), share(5).alias("recall_at_5"), F.round(F.avg(F.when(F.col("best").isNotNull(), rank)), 4).alias("percentile_rank"))


def paired(found: DataFrame, conditions: int) -> DataFrame:
    """Only questions attributable in every condition."""
    both = found.filter("best IS NOT NULL").groupBy("question").agg(F.countDistinct("condition").alias("k")).filter(F.col("k") == conditions)
    return found.join(both.select("question"), "question", "left_semi")


def coverage_rates(covered: DataFrame) -> DataFrame:
    """(method, questions, full_coverage, mean_opened) of covered(method, pages, covered, opened): how often all pages of a question are covered."""
    return covered.groupBy("method").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg((F.col("covered") == F.col("pages")).cast("double")), 4).alias("full_coverage"), F.round(F.avg("opened"), 4).alias("mean_opened"))


def answer_means(scored: DataFrame, *keys: str) -> DataFrame:
    """Means of em, f1 and anls."""
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in ("em", "f1", "anls")])


def answer_metrics(predictions: DataFrame) -> DataFrame:
    """predictions(predicted, gold) with em, f1 and anls."""
    p, g = F.coalesce("predicted", F.lit("")), F.coalesce("gold", F.lit(""))
    return predictions.withColumns({"em": exact_match(p, g), "f1": F.round(token_f1(p, g), 6), "anls": F.round(anls(p, g), 6)})
