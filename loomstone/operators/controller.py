"""The budgeted best-first evidence controller and what is read off its result."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomstone.config import CONFIG, STATES, Config
from loomstone.operators.whole import map_units, pages_of

LOG = "unit string, step int, pos int, action string, score double, state_before string, state_after string"


def run_controller(scores: list[float], near: dict[int, list[int]], config: Config = CONFIG) -> tuple[list[tuple], list[str]]:
    """(log of (node, action, score, before, after), final states) for nodes 0.. in order; near: neighbours in the order they are tried."""
    state, log = ["inactive"] * len(scores), []

    def move(i: int, action: str, to: str) -> None:
        log.append((i, action, scores[i], state[i], to))
        state[i] = to

    for i in sorted(range(len(scores)), key=lambda i: (-scores[i], i))[: config.seed_top_k]:
        move(i, "seed", "active")
    opened = 0
    while opened < config.budget:
        active = [i for i, s in enumerate(state) if s == "active"]
        if not active:
            break
        i = max(active, key=lambda i: (scores[i], -i))
        if scores[i] < config.open_threshold:
            move(i, "prune", "pruned")
            continue
        move(i, "open", "opened")
        opened += 1
        for j in near.get(i, []):
            if state[j] == "inactive" and scores[j] >= config.activate_threshold:
                move(j, "activate", "active")
    for i, s in enumerate(state):
        if s == "active":
            move(i, "prune", "pruned")
    return log, state


def controller_log(scores: DataFrame, near: DataFrame | None = None, config: Config = CONFIG) -> DataFrame:
    """LOG rows of each unit: scores(unit, pos, score), near(unit, pos, other, rank); without near, of tiles numbered in reading order, the one before and the one after. A unit is one question over its pages.

    Units go to Python whole and many at a time."""
    schema = to_arrow_schema(StructType.fromDDL(LOG))
    names, reading = schema.names[1:], near is None

    def run(t: pa.Table) -> pa.Table:
        of, told = [], []
        for page in pages_of(t):
            left = sorted((r["pos"], r["score"]) for r in page if r["other"] is None)
            order = {p: i for i, (p, _) in enumerate(left)}
            about: dict[int, list[int]] = {}
            if reading:
                pairs = [(p, o) for p in order for o in (p - 1, p + 1)]
            else:
                pairs = [(p, o) for p, _, o in sorted((r["pos"], r["rank"], r["other"]) for r in page if r["other"] is not None)]
            for p, o in pairs:
                if p in order and o in order:
                    about.setdefault(order[p], []).append(order[o])
            log, _ = run_controller([s for _, s in left], about, config)
            of += [page[0]["unit"]] * len(log)
            told += [(k, left[i][0], a, s, b, to) for k, (i, a, s, b, to) in enumerate(log)]
        columns = list(zip(*told)) if told else [[] for _ in names]
        return pa.table([pa.array(c, f.type) for c, f in zip([of, *columns], schema)], schema=schema)

    x = scores.select("unit", "pos", "score")
    if near is None:
        x = x.withColumn("other", F.lit(None).cast("int")).withColumn("rank", F.lit(None).cast("int"))
    else:
        near = near.filter("other IS NOT NULL").select("unit", "pos", "other", "rank")
        x = x.unionByName(near, allowMissingColumns=True)
    return map_units(x, run, LOG, "pos", "score", "other", "rank")


def reading_neighbours(tiles: DataFrame) -> DataFrame:
    """(unit, pos, other, rank) of tiles numbered in reading order: the one before, then the one after."""
    around = F.array(F.struct((F.col("pos") - 1).alias("other"), F.lit(0).alias("rank")), F.struct((F.col("pos") + 1).alias("other"), F.lit(1).alias("rank")))
    return tiles.select("unit", "pos", F.explode(around).alias("a")).select("unit", "pos", "a.other", "a.rank")


def static_top_k(scores: DataFrame, k: int = CONFIG.budget) -> DataFrame:
    """The rows of a unit's k best scores, with all their columns."""
    return scores.withColumn("n", F.row_number().over(Window.partitionBy("unit").orderBy(F.col("score").desc(), "pos"))).filter(F.col("n") <= k).drop("n")


def evidence(opened: DataFrame, tiles: DataFrame | None = None, responses: DataFrame | None = None) -> DataFrame:
    """(unit, evidence): texts of opened tiles, or a model's readings of them, in page order between blank lines. Without tiles, opened(unit, pos, text[, response]) has them, and no text is read or moved again."""
    x = opened if tiles is None else opened.select("unit", "pos").join(tiles.select("unit", "pos", "text"), ["unit", "pos"])
    if responses is not None:
        x = x.join(responses, ["unit", "pos"], "left")
    preview = F.substring("text", 1, CONFIG.preview_chars)
    x = x.select("unit", "pos", (F.coalesce("response", preview) if "response" in x.columns else preview).alias("t"))
    return x.groupBy("unit").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda s: s["t"]), "\n\n").alias("evidence"))


def state_counts(states: DataFrame) -> DataFrame:
    """(unit, state, n) with all four states."""
    every = states.groupBy("unit").agg(*[F.count(F.when(F.col("state") == s, 1)).alias(s) for s in STATES])
    return every.select("unit", F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).alias("n")) for s in STATES])).alias("s")).select("unit", "s.*")


def coverage(positives: DataFrame, opened: DataFrame) -> DataFrame:
    """(question, pages, covered): pages of a question of which an opened tile is positive."""
    hit = positives.join(opened.select("question", "unit", "pos").withColumn("hit", F.lit(1)), ["question", "unit", "pos"], "left")
    return hit.groupBy("question").agg(F.countDistinct("unit").alias("pages"), F.countDistinct(F.when(F.col("hit") == 1, F.col("unit"))).alias("covered"))


def external_links(links: DataFrame, opened: DataFrame) -> DataFrame:
    """First of equal (unit, href) links, those of opened tiles first; links(unit, seq, nth, href, anchor_text)."""
    x = links.join(opened.select("unit", F.col("pos").alias("seq")).distinct().withColumn("used", F.lit(True)), ["unit", "seq"], "left")
    first = F.row_number().over(Window.partitionBy("unit", "seq", "href").orderBy("nth"))
    x = x.withColumn("k", first).filter("k = 1").withColumn("used_as_evidence", F.coalesce("used", F.lit(False)))
    place = F.row_number().over(Window.partitionBy("unit").orderBy(F.col("used_as_evidence").desc(), "seq", "nth")) - 1
    return x.select("unit", "href", "anchor_text", F.col("seq").alias("source_seq"), "used_as_evidence", place.alias("place"))
