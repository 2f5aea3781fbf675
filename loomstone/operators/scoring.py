"""Lexical and dense relevance. Texts are rows (unit, pos, text); all scoring stays within a unit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomstone.config import CONFIG
from loomstone.functions.text import content_tokens, tokens
from loomstone.operators.whole import bags, map_units, unit_codes

MEETINGS = 4_000_000


def with_questions(asked: DataFrame, *carry: str) -> DataFrame:
    """(unit, pos, text, asks, carry) of asked(unit, pos, text, question, positive, carry): each question stands beside the tile that it asks for, so rows stay as they are dealt and sorted."""
    return asked.select("unit", "pos", "text", F.when(F.col("pos") == F.col("positive"), F.coalesce("question", F.lit(""))).alias("asks"), *carry)


def _against_question(texts: DataFrame, stop: bool, fit_question: bool, plain: bool) -> DataFrame:
    """(unit, pos, score) of texts(unit, pos, text[, asks]), where asks or the text of pos -1 is the unit's question; further columns of texts come along.

    The rows are dealt by unit once and their terms counted in column batches of whole units, so nothing is joined, no
    text is read twice and no row a term is sorted or kept."""
    carry = [c for c in texts.columns if c not in ("unit", "pos", "text", "asks")]
    schema = StructType([texts.schema[c] for c in ("unit", "pos", *carry)] + [StructField("score", DoubleType())])

    def run(t: pa.Table) -> pa.Table:
        unit, pos, words = unit_codes(t), t["pos"].to_numpy(), t.select(["terms"])
        if "asks" in t.column_names:  # questions beside tiles become rows after all others
            asking = np.flatnonzero(t["asks"].is_valid().to_numpy())
            unit, pos = np.append(unit, unit[asking]), np.append(pos, np.full(len(asking), -1, pos.dtype))
            words = pa.concat_tables([words, t.select(["asks"]).take(pa.array(asking)).rename_columns(["terms"]).cast(words.schema)])
        tile = (pos >= 0).astype(np.float64)
        n = np.bincount(unit, tile)
        # rows of one place are one text
        _, first, own_of = np.unique((unit * (int(pos.max()) - int(pos.min()) + 1)) + (pos - pos.min()), return_index=True, return_inverse=True)
        unit, tile = unit[first], tile[first]
        text, term, tf, terms = bags(words, "terms", own_of)
        _, at = np.unique(unit[text] * terms + term, return_inverse=True)
        asks = tile[text] == 0
        qf = np.zeros(len(at))
        qf[at[asks]] = tf[asks]
        idf = np.ones(len(at))
        if not plain:
            df = np.bincount(at, None if fit_question else tile[text])[at]
            idf = np.where(df > 0, np.log((1 + n[unit[text]] + fit_question) / (1 + df)) + 1, 0.0)
        w, q = tf * idf, qf[at] * idf
        own, dot = np.bincount(text, w * w, len(first)), np.bincount(text, w * q, len(first))
        # the question's own product with itself is the square of its length
        asked = np.full(len(n), -1.0)
        asked[unit[tile == 0]] = dot[tile == 0]
        length = np.sqrt(own) * np.sqrt(np.maximum(asked[unit], 0))
        score = np.divide(dot, length, out=np.zeros(len(dot)), where=length > 0)
        keep = np.flatnonzero((tile > 0) & (asked[unit] >= 0))
        found = t.select(["unit", "pos", *carry]).take(pa.array(first[keep]))
        return found.append_column("score", pa.array(score[keep]))

    read = content_tokens if stop else tokens
    lists = [read(F.col(c)).alias(to) for c, to in (("text", "terms"), ("asks", "asks")) if c in texts.columns]
    x = map_units(texts, run, schema, "pos", *carry, *lists)
    return x.select("unit", "pos", F.round("score", 6).alias("score"), *carry)


def _both(tiles: DataFrame, questions: DataFrame) -> DataFrame:
    return tiles.select("unit", "pos", "text").unionByName(questions.select("unit", F.lit(-1).alias("pos"), "text"))


def question_scores(tiles: DataFrame, questions: DataFrame | None = None, fit_question: bool = False) -> DataFrame:
    """(unit, pos, score) of tiles(unit, pos, text) for one question(unit, text) a unit, or of texts with questions (with_questions, or pos -1); tiles without common terms score 0.

    fit_question: the question counts in n and df; else terms that no tile has are dropped."""
    return _against_question(tiles if questions is None else _both(tiles, questions), True, fit_question, False)


def count_cosine(tiles: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """As question_scores, on plain token counts without stop words or idf."""
    return _against_question(tiles if questions is None else _both(tiles, questions), False, True, True)


def similar_pairs(texts: DataFrame, least: float = CONFIG.semantic_threshold) -> DataFrame:
    """(unit, i, j, similarity) of texts of one unit, by an inverted index on (unit, term) in column batches of whole units, a bounded number of meetings at a time. Terms of one text alone meet nothing and are left out."""
    schema = StructType([texts.schema["unit"], StructField("i", texts.schema["pos"].dataType), StructField("j", texts.schema["pos"].dataType), StructField("similarity", DoubleType())])

    def run(t: pa.Table) -> pa.Table:
        unit, pos = unit_codes(t), t["pos"].to_numpy()
        order = np.lexsort((pos, unit))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        unit, pos = unit[order], pos[order]
        n = np.bincount(unit)
        text, term, tf, terms = bags(t, "terms", place)
        _, at, df = np.unique(unit[text] * terms + term, return_inverse=True, return_counts=True)
        raw = tf * (np.log((1 + n[unit[text]]) / (1 + df[at])) + 1)
        w = raw / np.sqrt(np.bincount(text, raw * raw, len(order)))[text]
        # postings of each term by text; one meets those after it
        by_term = np.argsort(at, kind="stable")
        text, w, at = text[by_term], w[by_term], at[by_term]
        after = (np.cumsum(df)[at] - np.arange(len(at)) - 1).astype(np.int64)
        own = np.argsort(text, kind="stable")  # all meetings of a text in one part
        met = np.cumsum(after[own])
        ends = np.flatnonzero(np.append(text[own][1:] != text[own][:-1], True)) + 1 if len(own) else own
        out, start = [], 0
        while start < len(own):
            base = met[start - 1] if start else 0
            within = ends[(ends > start) & (met[ends - 1] <= base + MEETINGS)]
            end = int(within[-1]) if len(within) else int(ends[np.searchsorted(ends, start, "right")])
            p = own[start:end]
            k = after[p]
            a = np.repeat(p, k)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
            pair, which = np.unique(text[a] * len(order) + text[b], return_inverse=True)
            s = np.bincount(which, w[a] * w[b], len(pair))
            near = s >= least - 1e-6  # told exactly after rounding
            out.append((pair[near] // len(order), pair[near] % len(order), s[near]))
            start = end
        i, j, s = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 2 + (np.empty(0),)
        units = t["unit"].take(pa.array(order[i]))
        return pa.table({"unit": units, "i": pos[i], "j": pos[j], "similarity": s})

    x = map_units(texts, run, schema, "pos", content_tokens(F.col("text")).alias("terms"))
    return x.withColumn("similarity", F.round("similarity", 6)).filter(F.col("similarity") >= least)


def ranked(scores: DataFrame) -> DataFrame:
    """scores with rank from 0: score descending, then position."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("unit").orderBy(F.col("score").desc(), "pos")) - 1)


def dense_cosine(pairs: DataFrame, a: str, b: str, out: str = "score") -> DataFrame:
    """Cosine of two array columns, in doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(F.col(x), F.col(y), lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return pairs.withColumn(out, F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def info_nce(scored: DataFrame, temperature: float = CONFIG.temperature) -> DataFrame:
    """(batch, loss): scored(batch, q, score, positive) over all of a batch's tiles; mean cross-entropy of the positives."""
    s = F.col("score") / temperature
    top = Window.partitionBy("batch", "q")
    x = scored.withColumn("s", s).withColumn("m", F.max("s").over(top))
    q = x.groupBy("batch", "q").agg((F.log(F.sum(F.exp(F.col("s") - F.col("m")))) + F.first("m") - F.max(F.when(F.col("positive"), F.col("s")))).alias("l"))
    return q.groupBy("batch").agg(F.round(F.avg("l"), 4).alias("loss"), F.count(F.lit(1)).alias("n"))
