"""I-Match document fingerprints over randomised lexicons.

A document's terms are its runs of letter and digit bytes, A-Z folded. Kept are the terms whose document frequency
lies in a band relative to the number of documents (an inverse-document-frequency band), all of them. The document
frequencies sum up to (documents) * (mean distinct terms a document), and each term of the band has low * (documents)
at least, so the band holds at most (mean distinct terms) / low terms whatever the number of documents: at 150 distinct
terms 1.5 million hashes, 12 MB to broadcast, and in proportion for longer documents. The kept terms are sorted, distinct and hashed in SUBSETS randomised lexicons, each of which holds a term with
a probability of 1 / 2^level. A document takes the level log2(code points / CHARS), at which a subset holds a term or two of it, and
the one above it, so that a document and an edited form of like length have a level in common.

The likeness of two fingerprints is the share of equal subset hashes among the subsets in which either document has
terms, at their common levels; 1 for equal fingerprints, 0 without a common level. Documents without a kept term are
hashed over all their terms, and those without any term over their whole text; when one of two compared texts has no
kept term, both are compared over all their terms, so that the two sides have one vocabulary.

Successors in doc_id order are found without a window over all rows: rows go to ranges of doc_id, each range also gets
the first document of the next range, and each sorted range is read once.

Defined cases: null text is empty; a null doc_id sorts last; rows that share a doc_id are ordered by a hash of their
texts, so that one doc_id of very many rows makes several ranges; the only
document is its own next; equal texts have equal fingerprints whatever their length; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import read_table
from .textnum import U64, buffers, chunks, mix, words

LOW, HIGH, SUBSETS, CHARS, LEVELS = 0.0001, 0.25, 96, 5, 20
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = True
_TERM[128:] = True
_SEEDS = mix(np.arange(1, SUBSETS + 1, dtype=U64) * U64(0xA0761D6478BD642F))
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def term_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each row's sorted distinct term hashes."""
    h, _, _, at = words(data, offsets, inner=_TERM)
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        x = np.sort(h[s:e])
        out.append(x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x)
    return out


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(term long, df long) of texts(text): counted in each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(t.view(np.int64)), pa.array(n)], ["term", "n"])

        for b in batches:
            data, offsets = buffers(b.column(0))
            for i, j in chunks(offsets):
                for x in term_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    held.append(x)
                    size += len(x)
                if size > 3_000_000:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of all of the band's terms."""
    n = docs.count()
    band = document_frequencies(docs.select("text")).filter((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= max(2.0, high * n)))
    return np.sort(band.select("term").toArrow()["term"].to_numpy().view(U64))


class Fingerprinter:
    def __init__(self, lexicon: np.ndarray):
        self.lexicon = lexicon

    def one(self, terms: np.ndarray, text: str, whole: bool = False) -> tuple[int, np.ndarray, bool]:
        """First level, (2, SUBSETS) hashes of its two levels, 0 for a subset without terms, and whether they are of kept terms; whole: of all terms."""
        if len(self.lexicon) and len(terms) and not whole:
            at = np.minimum(np.searchsorted(self.lexicon, terms), len(self.lexicon) - 1)
            kept = terms[self.lexicon[at] == terms]
        else:
            kept = terms[:0]
        banded = len(kept) > 0
        if not banded:
            kept = terms if len(terms) else np.frombuffer(hashlib.sha256(text.encode()).digest()[:8], U64)
        level = int(np.clip(np.floor(np.log2(max(1.0, len(text) / CHARS))), 0, LEVELS))
        draws = mix(kept[None, :] ^ _SEEDS[:, None])
        out = np.zeros((2, SUBSETS), U64)
        for k in (0, 1):
            member = draws >> U64(64 - LEVELS - 1) < U64(1 << (LEVELS + 1 - level - k))
            out[k] = np.where(member, mix(draws * U64(0x9FB21C651E98DF25) + U64(k + level)), U64(0)).sum(1, dtype=U64)
            out[k] = np.where(member.any(1), out[k] | U64(1), U64(0))
        return level, out, banded

    def many(self, texts: list[str], whole: bool = False) -> list[tuple[int, np.ndarray, bool]]:
        data, offsets = buffers(pa.array(texts, pa.large_string()))
        out: list = []
        for i, j in chunks(offsets):
            out += [self.one(t, texts[i + k], whole) for k, t in enumerate(term_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))]
        return out

    def near(self, text: str, a: tuple, other: str, b: tuple) -> float:
        """Likeness of two texts with fingerprints a and b, over one vocabulary."""
        if a[2] != b[2]:
            a, b = self.many([text], True)[0] if a[2] else a, self.many([other], True)[0] if b[2] else b
        return likeness(a, b)


def likeness(a: tuple, b: tuple) -> float:
    if a[0] == b[0]:
        x, y = a[1], b[1]
    elif abs(a[0] - b[0]) == 1:
        x, y = (a[1][1], b[1][0]) if a[0] < b[0] else (a[1][0], b[1][1])
    else:
        return 0.0
    some = (x != 0) | (y != 0)
    return float(((x == y) & some).sum() / some.sum()) if some.any() else float(np.array_equal(a[1], b[1]) and a[0] == b[0])


def text_of(f: tuple) -> str:
    """The level, and 16 bits of each subset's hash."""
    return f"{f[0]:02x}" + (f[1] >> U64(48)).astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def query_rows(docs: DataFrame, lexicon: np.ndarray) -> DataFrame:
    """OUT for docs(doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    rows = docs.withColumn("order", key).withColumn("h", F.xxhash64("text"))
    bounds = sorted(rows.agg(F.percentile_approx("order", [i / (4 * n) for i in range(1, 4 * n)], 100 * n)).first()[0] or [])
    # a doc_id that fills several ranges is cut by the hash of its texts
    different = list(dict.fromkeys(bounds))
    heavy = {b: bounds.count(b) for b in different if bounds.count(b) > 1}
    bucket, buckets = F.lit(0), 1
    if different:
        # a bound is a range of its own, of several buckets where it is heavy; so ranges are numbered first, then their buckets
        bucket = F.aggregate(F.array(*[F.lit(b).cast("long") for b in different]), F.lit(0), lambda n, b: n + (b <= key).cast("int") + (b < key).cast("int"))
        sizes = [1] + [k for b in different for k in (heavy.get(b, 1), 1)]
        starts = [sum(sizes[:k]) for k in range(len(sizes))]
        bucket, buckets = F.get(F.array(*[F.lit(x) for x in starts]), bucket), sum(sizes)
    if heavy:
        parts = F.create_map(*[x for b, c in heavy.items() for x in (F.lit(b).cast("long"), F.lit(c))])[key]
        share = F.floor((F.col("h") / float(1 << 64) + 0.5) * parts)
        bucket = bucket + F.coalesce(F.least(share, parts - 1), F.lit(0)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("order", "h")).alias("at"))  # a row a range, 4 n at most
    there = sorted(r[0] for r in firsts.select("bucket").collect())
    if not there:
        return spark.createDataFrame([], OUT)
    to = F.create_map(*[F.lit(x) for k, b in enumerate(there) for x in (b, there[k - 1])])
    firsts = F.broadcast(firsts.select(F.col("bucket").alias("b"), F.col("at.order").alias("o"), F.col("at.h").alias("f")))
    heads = rows.join(firsts, (F.col("bucket") == F.col("b")) & (F.col("order") == F.col("o")) & (F.col("h") == F.col("f"))).groupBy("bucket", "order", "h").agg(F.min("text").alias("text"))
    heads = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", to[F.col("bucket")].alias("bucket"), "order", "h", F.lit(True).alias("guest"))
    both = rows.withColumn("guest", F.lit(False)).unionByName(heads)
    both = both.repartitionById(n, F.floor(F.col("bucket") * n / buckets).cast("int")).sortWithinPartitions("bucket", "guest", "order", "h", "text").select("bucket", "guest", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(lexicon)
        last: tuple | None = None  # bucket, doc_id, text, fingerprint
        for b in batches:
            sizes = np.diff(buffers(b.column(3))[1])
            total = np.concatenate(([0], np.cumsum(sizes)))
            for i, j in chunks(total):
                part = b.slice(i, j - i)
                bucket, guest, ids, texts = (c.to_pylist() for c in part.columns)
                prints = maker.many(texts)
                pairs = []
                for k in range(len(texts)):
                    if last is not None and last[0] == bucket[k]:
                        pairs.append((last, texts[k], prints[k]))
                    last = None if guest[k] else (bucket[k], ids[k], texts[k], prints[k])
                if pairs:
                    forms = [edited(p[0][2], p[1]) for p in pairs]
                    new = maker.many(forms)
                    yield pa.record_batch([
                        pa.array([p[0][1] for p in pairs], pa.int64()), pa.array([len(p[0][2]) for p in pairs], pa.int64()), pa.array([hashlib.sha256(f.encode()).hexdigest() for f in forms]),
                        pa.array([text_of(p[0][3]) for p in pairs]), pa.array([text_of(f) for f in new]),
                        pa.array([maker.near(p[0][2], p[0][3], t, f) for p, t, f in zip(pairs, forms, new)]), pa.array([maker.near(p[0][2], p[0][3], p[1], p[2]) for p in pairs]),
                    ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return both.mapInArrow(run, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return query_rows(docs, lexicon(docs))
