"""Mix sources to target weights by Pareto order sampling.

Each source gets a target of words by water-filling: its weight's share of all words, at most `cap` times its
own words, the excess shared again by weight. A document expects m = target * w / (sum of w * size) copies. Its
floor(m) whole copies are certain. What is then left of the source's target is filled in ascending Pareto order,
(u / (1 - u)) / (p / (1 - p)) with p = m - floor(m) and u a number in (0, 1) hashed from seed and doc_id, as
long as the documents fit; one later document, that whose size is nearest to what is still missing, closes the gap if
the sum comes nearer with it.

No window holds a source: the order is cut in BUCKETS of the key, words are summed by (source, bucket) with partial
sums, and only the bucket in which the target is reached, about 1/BUCKETS of the source, is ordered, rows of equal
(key, doc_id, size) being counted as one step. What comes out is, a source, the step at the cut with the number of its
rows that fit, and the step that closes the gap with one row. Only if such a step has more rows than it may take are
its rows written and numbered, task by task, so that a doc_id of very many rows needs no window of its own.

Defined cases: null text has size 0 and is taken 0 times a size of 0; a null source is a source of its own, last in
order; a null doc_id hashes as '' and sorts as -1; rows that share a doc_id share their place in the order, and of
those of equal size as many are taken as fit; an empty table gives an empty result; other columns, whatever their
names, are passed on by `mixed_rows`, whose four columns m_... replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, read_table

WEIGHTS, CAP, SEED, BUCKETS, BROADCAST_SOURCES = (1, 2, 3), 3, 17, 4096, 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """In (0, 1), from 52 bits of a digest."""
    hexed = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(hexed, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """totals(source, source_size) with target; the sources alone, so one small partition."""
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, len(weights)) + 1).cast("int"))
    x = totals.withColumn("weight", pick).withColumn("full", F.col("source_size") * cap)
    x = x.withColumn("ratio", F.col("full") / F.col("weight"))
    order = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("level", (F.sum("source_size").over(Window.partitionBy(F.lit(0))) - F.coalesce(F.sum("full").over(before), F.lit(0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    x = x.withColumn("open", F.max((F.col("ratio") >= F.col("level")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    level = F.first(F.when(F.col("open") == 1, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return x.select("source", "source_size", F.when(F.col("open") == 1, F.col("weight") * level).otherwise(F.col("full").cast("double")).alias("target"))


def _keyed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows(m_source, m_id, m_size, m_u, m_w, ...) with copies, key and bucket; plan has one row a source."""
    plan = plan.select(F.col("source").alias("p_source"), F.col("source_size").alias("m_source_size"), F.col("target").alias("m_target"), F.col("spread").alias("m_spread"))
    m = F.when(F.col("m_spread") > 0, F.col("m_target") * F.col("m_w") / F.col("m_spread")).otherwise(0.0)
    x = rows.join(_few(plan), F.col("m_source").eqNullSafe(F.col("p_source"))).drop("p_source").withColumn("m_m", F.least(m, F.lit(float(CAP))))
    x = x.withColumn("m_copies", F.floor("m_m")).withColumn("m_p", F.col("m_m") - F.col("m_copies"))
    q = F.col("m_u") * (1 - F.col("m_p")) / ((1 - F.col("m_u")) * F.col("m_p"))
    return x.withColumn("m_key", F.when(F.col("m_p") > 0, q / (1 + q))).withColumn("m_bucket", F.least(F.floor(F.col("m_key") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))


def _few(plan: DataFrame) -> DataFrame:
    """Broadcast behind a check of its rows; beyond it, Spark joins as it finds best."""
    return F.broadcast(plan) if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else plan


def _step(*names: str):
    """Where a row stands in the order; equal for the rows of one step."""
    return F.struct(*[F.col(n).alias(k) for n, k in zip(names or ("m_key", "m_id", "m_size"), "kis")])


def _numbered(tied: DataFrame, scratch: Scratch) -> DataFrame:
    """tied rows(t_step, ...) with t_nth from 1 within (m_source, t_step), task by task."""
    held = scratch.keep(tied.withColumn("t_task", F.spark_partition_id()).withColumn("t_row", F.monotonically_increasing_id()), "tied")
    own = [F.col("m_source"), F.col("t_step")]
    counts = held.groupBy(*own, "t_task").agg(F.count(F.lit(1)).alias("t_n"))
    before = F.coalesce(F.sum("t_n").over(Window.partitionBy(*own).orderBy("t_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("m_source").alias("o_source"), F.col("t_step").alias("o_step"), F.col("t_task").alias("o_task"), before.alias("t_before"))
    x = held.withColumn("t_nth", F.row_number().over(Window.partitionBy(*own, "t_task").orderBy("t_row")))
    x = x.join(counts, F.col("m_source").eqNullSafe(F.col("o_source")) & (F.col("t_step") == F.col("o_step")) & (F.col("t_task") == F.col("o_task")))
    return x.withColumn("t_nth", F.col("t_before") + F.col("t_nth"))


def drawn(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, weight: Column | None = None, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """docs' columns as c0, c1, ... with m_size, m_source_size, m_target and m_taken_copies. weight: relative inclusion within a source."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    mine = [F.col(source).alias("m_source"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias("m_id"), word_count(F.col(text)).alias("m_size"), uniform(F.col(doc_id), seed).alias("m_u"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("m_w")]
    safe = [f"c{i}" for i in range(len(docs.columns))]
    light = scratch.keep(docs.select(*mine), "sizes")
    totals = light.groupBy(F.col("m_source").alias("source")).agg(F.sum("m_size").alias("source_size"), F.sum(F.col("m_size") * F.col("m_w")).alias("spread"))
    totals = scratch.keep(totals, "totals")
    plan = scratch.keep(source_targets(totals.select("source", "source_size"), weights, cap).join(totals.select(F.col("source").alias("s"), "spread"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    keyed = _keyed(light, plan)
    sums = keyed.groupBy("m_source", "m_bucket").agg(F.first("m_target").alias("target"), F.sum(F.when(F.col("m_key").isNotNull(), F.col("m_size"))).alias("words"), F.sum(F.col("m_copies") * F.col("m_size")).alias("whole"))
    sums = scratch.keep(sums, "sums")
    up = Window.partitionBy("m_source").orderBy("m_bucket")
    left = (F.col("target") - F.sum("whole").over(Window.partitionBy("m_source"))).alias("left")
    steps = sums.select("m_source", "m_bucket", "words", left, F.sum("words").over(up).alias("upto"))
    cross = steps.filter(F.col("m_bucket").isNotNull()).groupBy("m_source").agg(F.min(F.when(F.col("upto") >= F.col("left"), F.struct("m_bucket", (F.col("upto") - F.col("words")).alias("had")))).alias("at"), F.sum("words").alias("all"), F.first("left").alias("left"))
    cross = scratch.keep(cross.select(F.col("m_source").alias("c_source"), F.coalesce("at.m_bucket", F.lit(BUCKETS)).alias("c_bucket"), F.coalesce("at.had", "all").alias("c_had"), F.col("left").alias("c_left")), "cross")
    # the steps of the bucket at the cut; of the first that does not fit whole, so many rows as fit
    edge = keyed.join(_few(cross), F.col("m_source").eqNullSafe(F.col("c_source")) & (F.col("m_bucket") == F.col("c_bucket")))
    edge = edge.groupBy("c_source", "c_had", "c_left", "m_key", "m_id", "m_size").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("c_source").orderBy("m_key", "m_id", "m_size").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("before", F.col("c_had") + F.coalesce(F.sum(F.col("m_size") * F.col("n")).over(run), F.lit(0)))
    fits = F.when(F.col("m_size") == 0, F.col("n")).otherwise(F.least("n", F.floor((F.col("c_left") - F.col("before")) / F.col("m_size"))))
    edge = edge.filter(F.col("before") <= F.col("c_left")).withColumn("fits", fits)
    last = F.struct(_step().alias("step"), F.col("fits"), F.col("n"), (F.col("before") + F.col("m_size") * F.col("fits")).alias("with"))
    cut = edge.groupBy(F.col("c_source").alias("e_source")).agg(F.max(last).alias("c_at"))
    cuts = cross.join(cut, F.col("c_source").eqNullSafe(F.col("e_source")), "left").drop("e_source")
    cuts = scratch.keep(cuts.withColumn("c_short", F.col("c_left") - F.coalesce("c_at.with", "c_had")), "cuts")
    within = (F.col("m_bucket") < F.col("c_bucket")) | ((F.col("m_bucket") == F.col("c_bucket")) & F.coalesce(_step() < F.col("c_at.step"), F.lit(False)))
    at_cut = F.coalesce(_step() == F.col("c_at.step"), F.lit(False))
    open_ = F.col("m_key").isNotNull() & ~within & ~(at_cut & F.coalesce(F.col("c_at.fits") >= F.col("c_at.n"), F.lit(False)))
    beyond = keyed.join(_few(cuts), F.col("m_source").eqNullSafe(F.col("c_source"))).filter(open_ & (F.col("m_size") > 0) & (F.col("m_size") < 2 * F.col("c_short")))
    near = beyond.groupBy(F.col("c_source").alias("e_source"), "m_key", "m_id", "m_size").agg(F.count(F.lit(1)).alias("n"), F.first(F.abs(F.col("c_short") - F.col("m_size"))).alias("gap"))
    near = near.groupBy("e_source").agg(F.min(F.struct("gap", _step().alias("step"), "n")).alias("c_last"))
    final = scratch.keep(cuts.join(near, F.col("c_source").eqNullSafe(F.col("e_source")), "left").drop("e_source"), "last")
    rows = _keyed(docs.select(*mine, *[F.col(c).alias(k) for c, k in zip(docs.columns, safe)]), plan)
    rows = rows.join(_few(final), F.col("m_source").eqNullSafe(F.col("c_source")), "left")
    closes = F.coalesce(_step() == F.col("c_last.step"), F.lit(False))
    may = F.when(at_cut, F.col("c_at.fits")).otherwise(0) + closes.cast("long")
    there = F.when(at_cut, F.col("c_at.n")).otherwise(F.col("c_last.n"))
    taken = F.when(F.col("m_key").isNull(), 0).when(within, 1).when(at_cut | closes, (may > 0).cast("int")).otherwise(0)
    partly = F.coalesce(F.col("m_key").isNotNull() & (at_cut | closes) & (may > 0) & (may < there), F.lit(False))
    some = F.col("c_at.fits") + F.when(F.col("c_at.step") == F.col("c_last.step"), 1).otherwise(0)
    split = final.filter(((F.coalesce(some, F.lit(0)) > 0) & (some < F.col("c_at.n"))) | (F.col("c_last.n") > 1)).limit(1).count()
    out = lambda x, extra: x.select(*safe, "m_size", "m_source_size", "m_target", (F.col("m_copies") + extra).cast("long").alias("m_taken_copies"))
    if not split:
        result = out(rows, taken)
    else:
        tied = _numbered(rows.filter(partly).withColumn("t_step", _step()).withColumn("t_may", may), scratch)
        result = out(rows.filter(~partly), taken).unionByName(out(tied, (F.col("t_nth") <= F.col("t_may")).cast("int")))
    scratch.drop(light, totals, sums, cross, cuts)
    return result


def mixed_rows(docs: DataFrame, *args, **kwargs) -> DataFrame:
    """docs' columns with m_size, m_source_size, m_target and m_taken_copies; arguments as of `drawn`."""
    new = ("m_size", "m_source_size", "m_target", "m_taken_copies")
    return drawn(docs, *args, **kwargs).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in new], *new)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    x = mixed_rows(docs)
    return x.select("doc_id", F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"), F.col("m_target").alias("target"), (F.col("m_size") * F.col("m_taken_copies")).alias("taken"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1)::DOUBLE AS weight, source_size * {CAP} AS full_size FROM t),
r AS (SELECT *, full_size / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(full_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
o AS (SELECT *, max(CASE WHEN ratio >= level THEN 1 ELSE 0 END) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS is_open FROM l),
g AS (SELECT source, source_size, CASE WHEN is_open = 1 THEN weight * (SELECT level FROM o WHERE is_open = 1 ORDER BY ratio, source NULLS LAST LIMIT 1) ELSE full_size::DOUBLE END AS target FROM o),
m AS (SELECT d.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN least(g.target / g.source_size, {CAP}.0) ELSE 0.0 END AS m FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
p AS (SELECT *, floor(m)::BIGINT AS copies, m - floor(m) AS p FROM m),
k AS (SELECT *, CASE WHEN p > 0 THEN u * (1 - p) / ((1 - u) * p) END AS q FROM p),
f AS (SELECT *, q / (1 + q) AS key, target - sum(copies * size) OVER (PARTITION BY source)::DOUBLE AS remaining FROM k),
c AS (SELECT *, CASE WHEN key IS NULL THEN NULL ELSE sum(CASE WHEN key IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY key NULLS LAST, coalesce(doc_id, -1), size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE END AS upto FROM f),
h AS (SELECT *, remaining - coalesce(max(CASE WHEN upto <= remaining THEN upto END) OVER (PARTITION BY source), 0) AS short FROM c),
z AS (SELECT *, CASE WHEN upto > remaining AND size > 0 AND size < 2 * short THEN row_number() OVER (PARTITION BY source, upto > remaining AND size > 0 AND size < 2 * short ORDER BY abs(short - size), key, coalesce(doc_id, -1)) END AS nth FROM h)
SELECT doc_id, size, source_size, target,
       size * (copies + CASE WHEN upto <= remaining OR nth = 1 THEN 1 ELSE 0 END)::BIGINT AS taken
FROM z
"""
