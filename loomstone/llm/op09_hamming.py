"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Vectors are scaled by the largest norm and given one more coordinate, so that the largest inner product is the least
angle. A rotation learned on a bounded sample (principal axes, then iterative quantisation) makes BITS signs of each.
A code is cut into four substrings of 16 bits, each with an index from its values to the rows that hold them. If two
codes differ in at most r = 4 a + b bits, then one of the first b + 1 substrings differs in at most a, or one of the
others in at most a - 1; so these buckets hold every code within r. They are looked up by flipping bits of the query's
substring, or, if that makes more values than are there, by trying the values that are there. The codes found are taken
to the exact distance r, and what is within is ranked by inner products of the original vectors in double precision. r
is that of a QUANTILE of true neighbours, measured on the sample at the depth that TOP neighbours of all rows have
there. Each vector is indexed, none is sampled away.

A query for which fewer than TOP codes lie within r is asked again with a radius of its own: the distance of its
TOP-th nearest code among all rows. So each query gets TOP rows, or all its candidates, whatever the shards.

Work units are (at most SHARD vectors, at most BLOCK queries): each holds a bounded part in memory and sends on TOP
rows a query. A query meets every shard, since a row of any shard may be near.

Scores are sums in one fixed order, so equal vectors have equal scores; a matrix product only tells which rows may be
among the TOP.

Defined cases: vectors null, empty, zero, of another length than most, or holding null or non-finite numbers take no
part, nor do rows without vec_id; ties go to the smaller vec_id; rows with a query's own vec_id are no candidates of
it; of several rows with a query's vec_id the least vector asks; repeated candidate rows stay; fewer candidates than
TOP give fewer rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, read_table

TOP, BITS, PART, SHARD, BLOCK, SAMPLE, QUANTILE = 20, 64, 16, 131_072, 32_768, 4000, 0.97
PARTS = BITS // PART
POPCOUNT = np.bitwise_count(np.arange(1 << PART, dtype=np.uint32)).astype(np.uint8)
_flips: dict[int, np.ndarray] = {}


def flips(most: int) -> np.ndarray:
    """All substrings with at most `most` bits set."""
    if most not in _flips:
        _flips[most] = np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(PART), k)], np.uint32)
    return _flips[most]


def number_of_flips(most: int) -> int:
    return int(np.count_nonzero(POPCOUNT <= most))


class Codes:
    """mean and projection (dim + 1, BITS) learned from rows x; top is the largest norm of all rows."""

    def __init__(self, x: np.ndarray, top: float, rounds: int = 25, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.top = top
        y = self.lifted(x)
        self.mean = y.mean(0)
        y = y - self.mean
        _, _, axes = np.linalg.svd(y, full_matrices=False)
        if len(axes) < BITS:  # fewer axes than bits: random ones besides
            axes = np.concatenate((axes, rng.normal(size=(BITS - len(axes), y.shape[1])) / y.shape[1] ** 0.5))
        axes = axes[:BITS].T
        v = y @ axes
        r = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(v.T @ np.where(v @ r > 0, 1.0, -1.0))
            r = u @ w
        self.matrix = axes @ r

    def lifted(self, x: np.ndarray) -> np.ndarray:
        y = x / self.top
        return np.column_stack((y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))))

    def of(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """uint64 codes; a query lies on the sphere itself."""
        y = np.column_stack((x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x)))) if query else self.lifted(x)
        return np.packbits((y - self.mean) @ self.matrix > 0, axis=1).view(">u8").astype(np.uint64).ravel()

    def radius(self, x: np.ndarray, rows: int) -> int:
        """Bits within which QUANTILE of the nearest lie: the sample's own, at the depth that corresponds to TOP of all rows."""
        q = x[: min(len(x), 400)]
        s = q @ x.T
        s[np.arange(len(q)), np.arange(len(q))] = -np.inf
        depth = min(len(x) - 1, max(1, round(TOP * len(x) / max(rows, 1))))
        if depth < 1:
            return BITS
        near = np.argpartition(-s, depth - 1, axis=1)[:, :depth]
        d = np.bitwise_count(self.of(q, True)[:, None] ^ self.of(x)[near])
        return int(np.ceil(np.quantile(d, QUANTILE))) + 1


class MultiIndex:
    """Of codes, for each substring the rows by value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.parts = []
        for k in range(PARTS):
            x = self.substring(codes, k)
            rows = np.argsort(x, kind="stable")
            values, start = np.unique(x[rows], return_index=True)
            place = np.full(1 << PART, -1, np.int32)
            place[values] = np.arange(len(values))
            self.parts.append((values, np.append(start, len(x)), rows, place))

    @staticmethod
    def substring(codes, k: int):
        return (codes >> np.uint64(PART * k)).astype(np.uint32) & np.uint32((1 << PART) - 1)

    def within(self, q: np.uint64, r: int) -> np.ndarray:
        """The places of every code within r bits of q, in ascending order."""
        if r >= BITS:
            return np.arange(len(self.codes))
        a, b = divmod(r, PARTS)
        spans, size = [], 0
        for k, (values, start, rows, place) in enumerate(self.parts):
            most, own = (a if k <= b else a - 1), self.substring(q, k)
            if most < 0:
                continue
            if number_of_flips(most) < len(values):
                at = place[own ^ flips(most)]
                at = at[at >= 0]
            else:
                at = np.flatnonzero(POPCOUNT[values ^ own] <= most)
            spans.append((rows, start[at], start[at + 1]))
            size += int((start[at + 1] - start[at]).sum())
        if size >= len(self.codes):  # the buckets hold as much as the shard, so its codes are read in order
            return np.flatnonzero(np.bitwise_count(self.codes ^ q) <= r)
        found = []
        for rows, s, e in spans:
            n = e - s
            found.append(rows[np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
        at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return at[np.bitwise_count(self.codes[at] ^ q) <= r]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, v as doubles."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    x = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    return x.filter("fine").drop("fine")


def _array(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def best(v: np.ndarray, ids: np.ndarray, at: np.ndarray, q: np.ndarray, top: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows `at`, the places and scores of the top by score, then vec_id; reach: no product is larger."""
    if len(at) > 4 * top:
        rough = v[at] @ q
        edge = np.partition(rough, len(rough) - top)[len(rough) - top]
        # no order of summing moves a product by more than this; reach is at least |q| |v|
        at = at[rough >= edge - 4 * len(q) * np.finfo(float).eps * reach]
    score = (v[at] * q).sum(1)
    order = np.lexsort((ids[at], -score))[:top]
    return at[order], score[order]


def search(vectors: DataFrame, is_query, top: int = TOP, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for vectors(vec_id, embedding); is_query: a condition on vec_id."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hamming")
    result = "query_id long, rank int, vec_id long, score double"
    x = scratch.keep(usable(vectors).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    common = x.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], result)
    x = x.filter(F.size("v") == common["n"])
    square = F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)
    rows, largest = x.agg(F.count(F.lit(1)), F.max(square)).first()
    sample = x.orderBy(F.xxhash64("vec_id"), "vec_id", "uid").limit(SAMPLE).select("v").toPandas()["v"]
    seen = np.stack(sample.to_numpy())
    codes = Codes(seen, float(largest) ** 0.5)
    r = codes.radius(seen, rows)
    # small tables are cut finer, so that every core has work; what is found does not depend on it
    shards = max(-(-rows // shard), min(spark.sparkContext.defaultParallelism, -(-rows // 4096)))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    wanted = x.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("times"))
    wanted = scratch.keep(wanted.withColumn("r", F.lit(r)), "queries")

    def met(asked: DataFrame, work: Callable) -> DataFrame:
        """work(vec_ids, vectors, index, own ids, queries, codes, radii) on each unit of shard and block."""
        blocks = max(1, -(-asked.count() // block))
        base = x.select("vec_id", "v", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int").alias("shard")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        sent = asked.select("query_id", "v", "r", F.pmod(F.xxhash64("query_id", F.lit(9)), F.lit(blocks)).cast("int").alias("block")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            found: list[tuple] = []
            if len(left) and len(right):
                q = _array(right["v"])
                found = list(work(np.asarray(left["vec_id"]), _array(left["v"]), np.asarray(right["query_id"]), q, codes.of(q, True), np.asarray(right["r"])))
            kinds = (np.int64, np.int64, np.float64)
            return pa.table([pa.array(np.concatenate([np.zeros(0, t), *[f[i] for f in found]])) for i, t in enumerate(kinds)], ["query_id", "vec_id", "score"])

        return base.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInArrow(run, "query_id long, vec_id long, score double")

    def nearest(ids, v, own, q, qc, radius):
        index = MultiIndex(codes.of(v))
        for k in range(len(q)):
            at = index.within(qc[k], int(radius[k]))
            at, score = best(v, ids, at[ids[at] != own[k]], q[k], top, codes.top * float(np.linalg.norm(q[k])))
            yield np.full(len(at), own[k]), ids[at], score

    def distances(ids, v, own, q, qc, radius):
        """The least distances of codes, as scores."""
        c = codes.of(v)
        for k in range(len(q)):
            d = np.bitwise_count(c[ids != own[k]] ^ qc[k])
            d = np.partition(d, top - 1)[:top] if len(d) > top else d
            yield np.full(len(d), own[k]), np.zeros(len(d), np.int64), d.astype(float)

    ranked = lambda f: f.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
    first = scratch.keep(ranked(met(wanted, nearest)), "first")
    short = wanted.join(first.groupBy("query_id").agg(F.count(F.lit(1)).alias("found")), "query_id", "left")
    short = scratch.keep(short.filter(F.coalesce("found", F.lit(0)) < F.least(F.lit(top), F.lit(rows) - F.col("times"))).select("query_id", "v"), "short")
    if not short.limit(1).count():
        return first
    closest = Window.partitionBy("query_id").orderBy("score")
    radii = met(short.withColumn("r", F.lit(r)), distances).withColumn("nth", F.row_number().over(closest)).filter(F.col("nth") <= top)
    radii = radii.groupBy("query_id").agg(F.max("score").cast("int").alias("r"))
    again = scratch.keep(short.join(radii, "query_id"), "again")
    second = scratch.keep(ranked(met(again, nearest)), "second")
    return first.join(short.select("query_id"), "query_id", "left_anti").unionByName(second)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
