"""Model calls as tables: prompts go out keyed by their content, replies come in from a cache, a table or a provider."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.config import CONFIG, Config
from loomstone.functions.text import cache_key, parsed_qa
from loomstone.operators import controller, corpus, graph, scoring
from loomstone.sources import elements as el
from loomstone.sources.stores import cached

ASK_QUESTION = 'You see one part of a web page. Write one question that this part alone answers, as JSON {"question": "...", "answer": "..."}. If it holds nothing to ask for, write SKIP.'
JUDGE = "Question: {question}\nExpected answer: {answer}\nCan this part of the page alone answer the question, in whatever words or pictures? Write OUI or NON."
SYNTHESIS = "Parts of a web page:\n{evidence}\n\nQuestion: {question}\nAnswer from these parts only; if they do not tell, say so."
NOTHING_FOUND = "No part of this page answers the question."

#: asks(key, prompt[, image]) -> replies(key, reply)
Provider = Callable[[DataFrame], DataFrame]


def table_provider(replies: DataFrame) -> Provider:
    """Replies from a table (key, reply); a request without one has none."""
    return lambda requests: requests.join(replies.select("key", "reply"), "key").select("key", "reply")


def provider(backend: str, **backends: Provider) -> Provider:
    if backend not in backends:
        raise ValueError(f"unknown backend {backend!r}; there are {sorted(backends)}")
    return backends[backend]


def formatted(template: str, **values: Column) -> Column:
    """The template with {name} replaced by columns; braces in values stay as they are."""
    parts, rest = [], template
    while rest:
        at = min((rest.find("{" + n + "}") for n in values if "{" + n + "}" in rest), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        name = rest[at + 1 : rest.index("}", at)]
        parts += [F.lit(rest[:at]), F.coalesce(values[name].cast("string"), F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def asked(requests: DataFrame, ask: Provider, cache: DataFrame | None = None, model: str = "model") -> tuple[DataFrame, DataFrame]:
    """(requests with key and reply, new cache rows (key, value)) of requests(prompt[, image_key], ...). Equal requests are asked once; a request without reply has a null."""
    parts = [F.lit(model), F.col("prompt")] + ([F.coalesce("image_key", F.lit(""))] if "image_key" in requests.columns else [])
    keyed = requests.withColumn("key", cache_key(*parts))
    if cache is None:
        new = ask(keyed.dropDuplicates(["key"])).dropDuplicates(["key"])
        return keyed.join(new, "key", "left"), new.select("key", F.col("reply").alias("value"))
    _, misses = cached(keyed, cache.select("key", "value"))
    new = ask(misses).dropDuplicates(["key"])
    known = cache.select("key", F.col("value").alias("reply")).unionByName(new.select("key", "reply")).dropDuplicates(["key"])
    return keyed.join(known, "key", "left"), new.select("key", F.col("reply").alias("value"))


def generated_qa(tiles: DataFrame, ask: Provider, existing: DataFrame | None = None, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(all question-answer pairs, those made now) of tiles(page_url, page_slug, tile_id, tile_seq, text_preview, image_path).

    A pair has the id slug__tile__qa; tiles that have one are not asked again; SKIP and replies that cannot be read make none."""
    ids = tiles.withColumn("id", F.concat("page_slug", F.lit("__"), "tile_id", F.lit("__qa")))
    todo = ids if existing is None else ids.join(existing.select("id"), "id", "left_anti")
    prompt = F.concat(F.lit(ASK_QUESTION + "\n"), F.coalesce("text_preview", F.lit("")))
    replies, _ = asked(todo.withColumn("prompt", prompt).withColumn("image_key", F.col("image_path")), ask, cache)
    made = replies.withColumn("qa", parsed_qa(F.col("reply"))).filter("qa IS NOT NULL")
    columns = ("id", "page_url", "page_slug", "tile_id", "question", "answer", "image_path")
    made = made.select("id", "page_url", "page_slug", "tile_id", "qa.question", "qa.answer", "image_path")
    return (made if existing is None else existing.select(*columns).join(ids.select("id"), "id", "left_semi").select(*columns).unionByName(made)), made


def judged_relevant(candidates: DataFrame, ask: Provider) -> DataFrame:
    """(unit, pos, relevant) of candidates(unit, pos, question, answer, text): replies that begin with OUI; no reply is no."""
    replies, _ = asked(candidates.withColumn("prompt", F.concat(formatted(JUDGE, question=F.col("question"), answer=F.col("answer")), F.lit("\n"), F.coalesce("text", F.lit("")))), ask)
    return replies.select("unit", "pos", F.coalesce(F.startswith(F.upper(F.trim("reply")), F.lit("OUI")), F.lit(False)).alias("relevant"))


def read_evidence(opened: DataFrame, tiles: DataFrame | None, ask: Provider) -> DataFrame:
    """(unit, evidence): a model's reading of each opened tile, or its text where there is none. Without tiles, opened(unit, pos, text) has the texts.

    A tile goes to its reply with its preview, and the whole text only to the model."""
    x = opened if tiles is None else opened.select("unit", "pos").join(tiles.select("unit", "pos", "text"), ["unit", "pos"])
    x = x.select("unit", "pos", F.substring("text", 1, CONFIG.preview_chars).alias("preview"), F.col("text").alias("prompt"))
    replies, _ = asked(x, ask)
    return controller.evidence(replies.select("unit", "pos", F.col("preview").alias("text"), F.col("reply").alias("response")))


def embedded(texts: DataFrame, vectors: DataFrame, key: str = "key") -> DataFrame:
    """texts with the vectors(key, vector) of a model, scaled to length 1; a text without a vector has a null."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return texts.join(vectors.select(key, F.when(norm > 0, F.transform("vector", lambda v: v.cast("double") / norm)).alias("vector")), key, "left")


def alike(pairs: DataFrame, a: str, b: str, least: float = 0.99) -> DataFrame:
    """pairs with similarity and whether it reaches `least`: two ways to embed the same input must agree."""
    x = scoring.dense_cosine(pairs, a, b, "similarity")
    return x.withColumn("agrees", F.coalesce(F.col("similarity") >= least, F.lit(False)))


@dataclass(frozen=True)
class Answer:
    """What a question about a page gives: one row of answers, and the tables behind it."""

    answer: DataFrame
    nodes: DataFrame
    edges: DataFrame
    log: DataFrame
    links: DataFrame


def answer(spark: SparkSession, pages: DataFrame, question: str, ask: Provider, config: Config = CONFIG) -> Answer:
    """Answer one question about each of pages(page_id, url, html): elements, tiles, graph, evidence, then a model's synthesis.

    A blank question is an error; a page without evidence gets NOTHING_FOUND and no model is asked for it."""
    if not question.strip():
        raise ValueError("the question is blank")
    nodes, edges = corpus.page_graph(el.html_page_elements(pages), config)
    t = nodes.filter("type = 'element'").select("unit", F.row_number().over(_order()).alias("n"), "node_id", "text").select("unit", (F.col("n") - 1).alias("pos"), "node_id", "text")
    q = t.select("unit").distinct().withColumn("text", F.lit(question))
    scores = scoring.question_scores(t, q, fit_question=True)
    log = controller.controller_log(scores, controller.reading_neighbours(t), config)
    opened = log.filter("action = 'open'").select("unit", "pos", "score")
    evidence = read_evidence(opened, t, ask)
    found = evidence.filter(F.trim("evidence") != "").withColumn("prompt", formatted(SYNTHESIS, evidence=F.col("evidence"), question=F.lit(question)))
    replies, _ = asked(found, ask)
    every = pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("unit"), F.col("url").alias("page_url"))
    out = every.join(replies.select("unit", "reply"), "unit", "left").join(found.select("unit", F.lit(True).alias("some")), "unit", "left")
    text = F.when(F.col("some").isNull(), F.lit(NOTHING_FOUND)).otherwise(F.col("reply"))
    ids = t.join(opened.select("unit", "pos"), ["unit", "pos"], "left_semi").select("unit", F.col("node_id").alias("src"), F.lit(True).alias("used"))
    links = edges.filter("relation = 'links_to'").join(ids, ["unit", "src"], "left").groupBy("unit", "src", "dst").agg(F.min("anchor_text").alias("anchor_text"), F.first(F.coalesce("used", F.lit(False))).alias("used_as_evidence"))
    return Answer(out.select("unit", "page_url", F.lit(question).alias("question"), text.alias("answer")), nodes, graph.edge_ids(edges), log, links)


def _order():
    from pyspark.sql import Window

    return Window.partitionBy("unit").orderBy("section", "pos")
