"""Hard negatives, contrastive rows, splits and multi-hop examples."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.config import CONFIG, STOP_WORDS
from loomstone.functions.text import article_root, category_of_last, contains_answer, title_slug, tokens
from loomstone.operators.scoring import question_scores, with_questions


def hard_negatives(scores: DataFrame, tiles: DataFrame, qa: DataFrame, n: int = CONFIG.n_hard_negatives, judged: DataFrame | None = None, leak_filter: bool = True) -> DataFrame:
    """(unit, pos, nth): the best-scored tiles of a question's page that are not its positive, do not hold the answer and are not judged relevant.

    scores(unit, pos, score); qa(unit, question, answer, positive); judged(unit, pos, relevant)."""
    x = scores.join(tiles.select("unit", "pos", "text"), ["unit", "pos"]).join(qa.select("unit", "answer", "positive"), "unit").filter(F.col("pos") != F.col("positive"))
    if leak_filter:
        x = x.filter(~F.coalesce(contains_answer(F.col("answer"), F.col("text"), trim=False), F.lit(False)))
    if judged is not None:
        x = x.join(judged, ["unit", "pos"], "left").filter(~F.coalesce("relevant", F.lit(False)))
    order = Window.partitionBy("unit").orderBy(F.col("score").desc(), "pos")
    return x.withColumn("nth", F.row_number().over(order) - 1).filter(F.col("nth") < n).select("unit", "pos", "nth")


def asked_negatives(asked: DataFrame, n: int = CONFIG.n_hard_negatives, judged: DataFrame | None = None, leak_filter: bool = True, score: Callable[[DataFrame], DataFrame] = question_scores) -> DataFrame:
    """As hard_negatives, of asked(unit, pos, text, question, answer, positive[, relevant]): which tiles may be negatives is told before they are scored, so their texts are read once."""
    fit = F.col("pos") != F.col("positive")
    if leak_filter:
        fit &= ~F.coalesce(contains_answer(F.col("answer"), F.col("text"), trim=False), F.lit(False))
    x = asked
    if judged is not None:
        x = x.join(judged.select("unit", "pos", "relevant"), ["unit", "pos"], "left")
    if "relevant" in x.columns:
        fit &= ~F.coalesce("relevant", F.lit(False))
    s = score(with_questions(x.withColumn("fit", fit), "fit")).filter("fit")
    order = Window.partitionBy("unit").orderBy(F.col("score").desc(), "pos")
    return s.withColumn("nth", F.row_number().over(order) - 1).filter(F.col("nth") < n).select("unit", "pos", "nth")


def contrastive(negatives: DataFrame, qa: DataFrame) -> DataFrame:
    """(unit, question, answer, positive, negatives array): questions without negatives keep an empty list."""
    lists = negatives.groupBy("unit").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "pos"))), lambda s: s["pos"]).alias("negatives"))
    return qa.join(lists, "unit", "left").withColumn("negatives", F.coalesce("negatives", F.expr("cast(array() as array<int>)")))


def uniform_negatives(examples: DataFrame, n: int) -> DataFrame:
    """Examples of fewer negatives go, longer lists are cut to n."""
    return examples.filter(F.size("negatives") >= n).withColumn("negatives", F.slice("negatives", 1, n))


def resolvable(examples: DataFrame, manifest: DataFrame) -> DataFrame:
    """Examples whose positive and negatives are all in manifest(unit, pos)."""
    need = examples.select("unit", F.explode(F.concat(F.array("positive"), "negatives")).alias("pos"))
    missing = need.join(manifest.select("unit", "pos"), ["unit", "pos"], "left_anti").select("unit").distinct()
    return examples.join(missing, "unit", "left_anti")


def batch_offsets(examples: DataFrame, batch: int) -> DataFrame:
    """(unit, batch_no, positive_index): where each positive stands among its batch's flattened images."""
    x = numbered(examples, "unit", F.substring("unit", 1, 5)).withColumn("batch_no", F.floor(F.col("i") / batch))
    k = 1 + F.size("negatives")
    return x.select("unit", "batch_no", (F.sum(k).over(Window.partitionBy("batch_no").orderBy("i")) - k).alias("positive_index"))


def numbered(rows: DataFrame, key: str, prefix) -> DataFrame:
    """rows with i, their place from 0 in the order of key. prefix: of the key, in its order; rows are counted by prefix and only numbered inside one."""
    x = rows.withColumn("prefix", prefix)
    counts = x.groupBy("prefix").agg(F.count(F.lit(1)).alias("k"))
    start = F.coalesce(F.sum("k").over(Window.partitionBy(F.lit(0)).orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a prefix
    x = x.join(counts.select("prefix", start.alias("start")), "prefix")
    return x.withColumn("i", F.col("start") + F.row_number().over(Window.partitionBy("prefix").orderBy(key)) - 1).drop("prefix", "start")


def split_articles(spark: SparkSession, examples: DataFrame, share: float = 0.2, seed: int = 0, most: int = 100_000) -> DataFrame:
    """examples with split: whole articles go to val, in a seeded order, until it has round(n * share) rows. The articles, not the rows, are listed on the driver; beyond `most` of them take split_articles_hashed."""
    if examples.select(article_root(F.col("unit"))).distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} articles; use split_articles_hashed")
    counts = {r["a"]: r["n"] for r in examples.groupBy(article_root(F.col("unit")).alias("a")).agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(counts)
    random.Random(seed).shuffle(names)
    want, have, val = round(sum(counts.values()) * share), 0, []
    for a in names:
        if have >= want:
            break
        val.append((a,))
        have += counts[a]
    marks = spark.createDataFrame(val, "article string").withColumn("split", F.lit("val"))
    return examples.withColumn("article", article_root(F.col("unit"))).join(marks, "article", "left").withColumn("split", F.coalesce("split", F.lit("train")))


def split_articles_hashed(examples: DataFrame, share: float = 0.2) -> DataFrame:
    """The same rule with articles in md5 order, for any number of articles."""
    per = examples.groupBy(article_root(F.col("unit")).alias("article")).agg(F.count(F.lit(1)).alias("n"))
    x = per.withColumn("digest", F.md5("article")).withColumn("bucket", F.substring("digest", 1, 3))
    sums = x.groupBy("bucket").agg(F.sum("n").alias("k"))  # 4096 rows at most, so one window may hold them
    every = Window.partitionBy(F.lit(0))
    sums = sums.select("bucket", F.coalesce(F.sum("k").over(every.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("k").over(every).alias("all"))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("inner", inner).join(F.broadcast(sums), "bucket").withColumn("before", F.col("start") + F.col("inner"))
    return x.select("article", "n", F.when(F.col("before") < F.bround(F.col("all") * share), "val").otherwise("train").alias("split"))


def supporting_sentences(records: DataFrame) -> DataFrame:
    """(id, title, sent_id, sentence) of the supporting facts; the first context of a title counts, ids out of range are dropped."""
    facts = records.select("id", F.explode(F.arrays_zip("supporting_facts.title", "supporting_facts.sent_id")).alias("f"), "context")
    at = F.array_position("context.title", F.col("f.title"))
    sentence = F.get(F.get(F.col("context.sentences"), (at - 1).cast("int")), F.col("f.sent_id"))
    return facts.filter(at > 0).select("id", F.col("f.title").alias("title"), F.col("f.sent_id").alias("sent_id"), sentence.alias("sentence")).filter("sentence IS NOT NULL")


def new_records(records: DataFrame, known: DataFrame, split: str | None = None, limit: int | None = None) -> DataFrame:
    """records(id, pos[, split]) of a split that are not known(id), the first `limit` in order of pos."""
    x = records if split is None else records.filter(F.col("split") == split)
    x = x.join(known.select("id"), "id", "left_anti")
    return x if limit is None else x.orderBy("pos").limit(limit)


def with_tile(qa: DataFrame, tiles: DataFrame) -> DataFrame:
    """Questions whose tile (page_slug, tile_id) is there; orphans go."""
    return qa.join(tiles.select("page_slug", "tile_id"), ["page_slug", "tile_id"], "left_semi")


def of_category(manifest: DataFrame, category: str) -> DataFrame:
    """Manifest rows whose tag is of a category, by its last part."""
    return manifest.filter(category_of_last(F.col("dom_tag")) == category)


def sampled(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a seeded digest of the key: a sample without replacement that reruns repeat."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def cross_page_negatives(questions: DataFrame, pages: DataFrame, tiles: DataFrame, positives: DataFrame, n: int = CONFIG.n_hard_negatives) -> DataFrame:
    """(id, nth, page_slug, tile_id): the best-scored tiles of all pages of a question together, its positives left out before anything is counted.

    questions(id, question); pages(id, page_slug, page_pos); tiles(page_slug, tile_id, text); positives(id, page_slug, tile_id)."""
    pool = pages.join(tiles, "page_slug").join(positives.select("id", "page_slug", "tile_id"), ["id", "page_slug", "tile_id"], "left_anti")
    pool = pool.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("page_pos", "tile_id")) - 1)
    s = question_scores(pool.select(F.col("id").alias("unit"), "pos", "text"), questions.select(F.col("id").alias("unit"), F.col("question").alias("text")), fit_question=True)
    best = F.row_number().over(Window.partitionBy("unit").orderBy(F.col("score").desc(), "pos")) - 1
    s = s.withColumn("nth", best).filter(F.col("nth") < n)
    return s.select(F.col("unit").alias("id"), "pos", "nth").join(pool.select("id", "pos", "page_slug", "tile_id"), ["id", "pos"]).select("id", "nth", "page_slug", "tile_id")


def sentence_overlaps(sentence, text, ratio: float = 0.5):
    """Whether enough of the sentence's distinct content tokens stand in the text."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    s = F.array_except(F.array_distinct(tokens(sentence)), stop)
    common = F.size(F.array_intersect(s, F.array_except(F.array_distinct(tokens(text)), stop)))
    return F.when(F.size(s) == 0, False).otherwise(common >= ratio * F.size(s))


def multihop(records: DataFrame, tiles: DataFrame, negatives: int = CONFIG.n_hard_negatives) -> DataFrame:
    """(id, question, answer, hop_type, status, positive_tiles, hard_negative_tiles): tiles(page_slug, tile_id, text) that a supporting sentence of their page overlaps, and the best others.

    status: single_page, unavailable (a page without tiles), unmatched (a page without positive), ok."""
    s = supporting_sentences(records).withColumn("page_slug", title_slug(F.col("title")))
    pages = s.select("id", "page_slug").distinct()
    have = pages.join(tiles.select("page_slug").distinct(), "page_slug", "left_semi").withColumn("have", F.lit(True))
    hits = s.join(tiles, "page_slug").filter(sentence_overlaps(F.col("sentence"), F.col("text"))).select("id", "page_slug", "tile_id").distinct()
    per = pages.join(have, ["id", "page_slug"], "left").join(hits.groupBy("id", "page_slug").agg(F.count(F.lit(1)).alias("n")), ["id", "page_slug"], "left")
    g = per.groupBy("id").agg(F.count(F.lit(1)).alias("pages"), F.bool_and(F.coalesce("have", F.lit(False))).alias("all_have"), F.bool_and(F.coalesce(F.col("n") > 0, F.lit(False))).alias("all_hit"))
    lists = hits.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("page_slug", "tile_id"))).alias("positive_tiles"))
    status = F.when(F.coalesce("pages", F.lit(0)) < 2, "single_page").when(~F.col("all_have"), "unavailable").when(~F.col("all_hit"), "unmatched").otherwise("ok")
    out = records.join(g, "id", "left").join(lists, "id", "left").select("id", "question", "answer", F.col("type").alias("hop_type"), status.alias("status"), "positive_tiles")
    place = F.row_number().over(Window.partitionBy("id").orderBy("page_slug")).alias("page_pos")
    ok = out.filter("status = 'ok'").select("id", "question")
    found = cross_page_negatives(ok, pages.join(ok.select("id"), "id", "left_semi").select("id", "page_slug", place), tiles, hits, negatives)
    worst = found.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "page_slug", "tile_id"))), lambda s: F.struct(s["page_slug"].alias("page_slug"), s["tile_id"].alias("tile_id"))).alias("hard_negative_tiles"))
    return out.join(worst, "id", "left")
