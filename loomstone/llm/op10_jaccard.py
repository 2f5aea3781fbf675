"""Exact n-gram Jaccard join with a token-group matrix, down to connected components.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Documents of one set are one class. Two classes
link when 100 * |intersection| >= 75 * |union|.

1. Groups. Classes that share a pair of least permuted hashes are compared with the first and the last class of that
   bucket, a number of pairs linear in the classes; verified pairs make the first groups (connected
   classes). A link that this misses is found in step 3.
2. Token-group matrix. Tokens have one global order: those seen often last, the others by hash. If two sets link, their
   first common token stands, in either, before so many others that 3/7 of both sizes can still be common; so only a
   set's first |Q| - ceil(3/4 |Q|) + 1 tokens count. Of these and |Q| / 16 more, the least and the largest group of each
   token (partial sums) tell which tokens two groups share. A set that links has more than |Q| / 16 such tokens; the
   rows of all other sets and tokens go no further, nor do rows that no other group's row of their token fits in size
   and place.
3. Opening. Each row carries the parity signature of its whole set: bit h(t) is turned by each token t, so that two
   signatures differ in no more bits than the sets differ in tokens, and sets that link differ in at most 1/7 of both
   sizes. In the run of a token, a query set is bounded against each other group at once, by the signature of the
   group's centre less the group's radius; only the members of groups that qualify are opened and tested one by one.
   What passes is verified on whole sets; new links merge groups. Sets of one group are never compared again, so a
   group of n copies costs n rows, not n * n, and near sets that do not link are left out before they make a row.
   Runs of more than RUN rows are cut in blocks, and each pair of blocks is a unit of its own.

The order needs no exact counts, only to be the same everywhere: a fixed bitmap of 2^HOT_BITS bits marks at most
HOT_MOST tokens that batches of documents reported most; any marking gives the same result. Bitmaps of busy tokens and
of wanted documents have a fixed size too; they only keep rows from being shuffled, and exact joins follow.

Defined cases: a null or blank text has size 0 and links with nothing; a null doc_id links with nothing and its
component_id is null; rows that share a doc_id count as one document of several texts; fewer than 5 words make one
token; repeated rows and texts of any length are kept whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, read_table
from .textnum import U64, buffers, chunks, mix, shingle_sets

WORDS, NUM, DEN, MINHASHES, HOT_BITS, HOT_MOST, HOT_LEAST, BLOCK, RUN, MARK_BITS, EXTRA = 5, 75, 100, 16, 23, 1 << 19, 16, 5_000_000, 8192, 25, 16
SHORT = 48  # rows of a run that is tried with others at once
_SEEDS = mix(np.arange(1, MINHASHES + 1, dtype=U64) * U64(0xE7037ED1A0B428DB))


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of a batch (doc_id, text) with their sets."""
    data, offsets = buffers(batch.column(1))
    for i, j in chunks(offsets):
        yield batch.slice(i, j - i), shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)


def _keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
    at = np.concatenate(([0], np.cumsum(size)))
    out = []
    for seed in (U64(0x2545F4914F6CDD1D), U64(0x369DEA0F31A53F85)):
        total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(flat ^ seed), dtype=U64)))
        out.append(mix(total[at[1:]] - total[at[:-1]] + size.astype(U64)).view(np.int64))
    return out[0], out[1]


def hot_bitmap(docs: DataFrame, k: int = WORDS) -> np.ndarray:
    """Bits of the tokens that most documents hold; classes count once in each block of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def counted() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(list(held.values())), return_counts=True)
            often = n >= 2
            return pa.record_batch([pa.array(t[often].view(np.int64)), pa.array(n[often])], ["token", "n"])

        for b in batches:
            for _, sets in _sets(b, k):
                for key, x in zip(_keys(sets)[0].tolist(), sets):
                    if key not in held:
                        held[key] = x
                        size += len(x)
                if size > BLOCK:
                    yield counted()
                    held, size = {}, 0
        if held:
            yield counted()

    seen = docs.select("doc_id", "text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_LEAST)
    top = seen.orderBy(F.col("n").desc(), "token").limit(HOT_MOST).select("token").toPandas()["token"].to_numpy(np.int64).view(U64)
    bits = np.zeros(1 << HOT_BITS, bool)
    bits[(top >> U64(64 - HOT_BITS)).astype(np.int64)] = True
    return np.packbits(bits)


def prefix_length(n):
    """Tokens of which one is common to any set that links with one of n: n - ceil(3/4 n) + 1."""
    return n + NUM * -n // DEN + 1


def extra_length(n):
    """Tokens read beyond these; of all of them, so many and one are common to any set that links."""
    return n // EXTRA


def signature(x: np.ndarray) -> bytes:
    """Parities of the tokens by their low bits, in at least twice as many bits as tokens up to 2048 of these."""
    bits = int(np.clip(1 << int(2 * len(x) - 1).bit_length(), 512, 4096)) if len(x) else 512
    return np.packbits(np.bincount((x & U64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def described(docs: DataFrame, bitmap: np.ndarray, k: int = WORDS) -> DataFrame:
    """doc_id, n, k1, k2, minhashes, prefix and signature of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(bitmap).astype(bool)
        for b in batches:
            for part, sets in _sets(b, k):
                k1, k2 = _keys(sets)
                least, heads = [], []
                for x in sets:
                    h = mix(x[None, :] ^ _SEEDS[:, None]).min(1) if len(x) else np.zeros(0, U64)
                    least.append(mix(h[::2] * U64(0x9FB21C651E98DF25) + h[1::2]))
                    last = hot[(x >> U64(64 - HOT_BITS)).astype(np.int64)]
                    p = prefix_length(len(x)) + extra_length(len(x)) if len(x) else 0
                    head = x[~last][:p] if last.any() else x[:p]
                    heads.append(np.concatenate((head, x[last][: p - len(head)])) if len(head) < p else head)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                yield pa.record_batch([part.column(0), pa.array(n), pa.array(k1), pa.array(k2), _lists(least), _lists(heads), pa.array([signature(x) for x in sets], pa.binary())], ["doc_id", "n", "k1", "k2", "least", "prefix", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, least array<long>, prefix array<long>, sig binary")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, U64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))


def bitmap(values: DataFrame) -> np.ndarray:
    """2^MARK_BITS bits, in words of 64, of which those at the values' (long) upper bits are set; 2^19 rows come to the driver at most."""
    m = F.shiftrightunsigned(values[values.columns[0]], 64 - MARK_BITS)
    words = values.select(F.shiftrightunsigned(m, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), m.bitwiseAND(63).cast("int")).alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()
    table = np.zeros(1 << (MARK_BITS - 6), np.int64)
    table[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    return table.view(U64)


def marked(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values (int64) fall on a bit of the bitmap that is set."""
    m = values.view(U64) >> U64(64 - MARK_BITS)
    return (table[(m >> U64(6)).astype(np.int64)] >> (m & U64(63))) & U64(1) > 0


def whole_sets(docs: DataFrame, wanted: DataFrame, k: int = WORDS) -> DataFrame:
    """(node, tokens) of the documents in wanted(node). The bitmap keeps other texts from being read into sets; the join is exact."""
    table = bitmap(wanted.select(F.xxhash64("node").alias("mark")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = b.filter(pa.array(marked(table, b.column(2).to_numpy(zero_copy_only=False))))
            for part, sets in _sets(some, k):
                yield pa.record_batch([part.column(0), _lists(sets)], ["node", "tokens"])

    found = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("doc_id").alias("mark")).mapInArrow(run, "node long, tokens array<long>")
    return found.join(wanted, "node", "left_semi")


def measured(pairs: DataFrame, docs: DataFrame, scratch: Scratch, k: int = WORDS) -> DataFrame:
    """pairs(a, b) of nodes with the tokens common to their whole sets and those of either."""
    wanted = scratch.keep(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted")
    sets = scratch.keep(whole_sets(docs, wanted, k), "sets")
    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    x = x.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("total"))
    out = scratch.keep(x.select("a", "b", "common", (F.col("total") - F.col("common")).alias("either")), "measured")
    scratch.drop(wanted, sets)
    return out


def _links(found: DataFrame) -> DataFrame:
    return found.filter(DEN * F.col("common") >= NUM * F.col("either")).select("a", "b").distinct()


def _can_link(n: str, m: str):
    return (DEN * F.least(n, m) >= NUM * F.greatest(n, m))


def matrix(grouped: DataFrame, busy: DataFrame) -> DataFrame:
    """(token, uid, g, n, room) of grouped(uid, n, g, prefix) for the tokens that are marked busy; room: tokens of the set from this one on."""
    table = bitmap(busy.select("token"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid, n, g, lists = b.columns
            size = np.diff(lists.offsets.to_numpy())
            token = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = n.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            hit = marked(table, token)
            enough = np.bincount(row[hit], minlength=len(size)) > extra_length(sizes)
            place = np.arange(len(token)) - (np.cumsum(size) - size)[row]
            at = np.flatnonzero(hit & enough[row] & (place < prefix_length(sizes)[row]))
            row, room = row[at], sizes[row[at]] - place[at]
            for s in range(0, len(at), 200_000):
                r = pa.array(row[s : s + 200_000])
                yield pa.record_batch([pa.array(token[at[s : s + 200_000]]), uid.take(r), g.take(r), n.take(r), pa.array(room[s : s + 200_000])], ["token", "uid", "g", "n", "room"])

    return grouped.select("uid", "n", "g", "prefix").mapInArrow(run, "token long, uid long, g long, n long, room long")


def partnered(rows: DataFrame, most: int = RUN) -> DataFrame:
    """Of rows(token, uid, g, n, room, held), those for which another group's row of their token fits in size and room; all of a run of more than `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None

        def fitting(t: pa.Table) -> Iterator[pa.RecordBatch]:
            token, g, n, room, held = (t[c].to_numpy() for c in ("token", "g", "n", "room", "held"))
            keep, at, d = held > most, np.flatnonzero(held <= most), 0
            while len(at):
                d += 1
                at = at[at + d < len(token)]
                o = at + d
                on = (token[at] == token[o]) & (DEN * n[at] >= NUM * n[o])  # sorted by size, so none beyond fits
                at, o = at[on], o[on]
                need = _need(n[at], n[o])
                fit = (g[at] != g[o]) & (room[at] >= need) & (room[o] >= need)
                keep[at[fit]] = keep[o[fit]] = True
            yield from t.filter(pa.array(keep)).combine_chunks().to_batches()

        for b in batches:
            t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
            if len(t):
                token = t["token"].to_numpy()
                cut = int(np.argmax(token == token[-1]))
                left = t.slice(cut)
                if len(left) > 4 * most:  # a run that passes whole
                    cut, left = len(t), None
                if cut:
                    yield from fitting(t.slice(0, cut))
        if left is not None:
            yield from fitting(left)

    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt = F.when(F.col("held") > most, F.xxhash64("uid")).otherwise(0)
    dealt = rows.select("token", "uid", "g", "n", "room", "held").repartition(n, F.col("token"), salt).sortWithinPartitions("token", "n")
    return dealt.mapInArrow(run, "token long, uid long, g long, n long, room long, held long")


def _need(n, m):
    """Tokens that sets of these sizes have in common if they link."""
    return -(-NUM * (n + m) // (NUM + DEN))


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which each signature of x differs from each of y."""
    out = np.zeros((len(x), len(y)), np.int64)
    for w in range(x.shape[1]):
        out += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
    return out


class Side:
    """Rows of a run with signatures of one width, by group, each group with its centre, radius, sizes and room."""

    def __init__(self, node: np.ndarray, g: np.ndarray, n: np.ndarray, room: np.ndarray, block: np.ndarray, sig: np.ndarray):
        o = np.lexsort((node, g))
        self.node, self.g, self.n, self.room, self.block, self.sig = node[o], g[o], n[o], room[o], block[o], sig[o]
        self.first = np.flatnonzero(np.concatenate(([True], self.g[1:] != self.g[:-1])))
        self.count = np.diff(np.append(self.first, len(o)))
        self.group = self.g[self.first]
        own = np.repeat(np.arange(len(self.first)), self.count)
        self.radius = np.maximum.reduceat(np.bitwise_count(self.sig ^ self.sig[self.first[own]]).sum(1, dtype=np.int64), self.first)
        self.low, self.high, self.most = np.minimum.reduceat(self.n, self.first), np.maximum.reduceat(self.n, self.first), np.maximum.reduceat(self.room, self.first)

    def narrower(self) -> Side:
        half = self.sig.shape[1] // 2
        return Side(self.node, self.g, self.n, self.room, self.block, self.sig[:, :half] ^ self.sig[:, half:])


def _between(q: Side, x: np.ndarray, p: Side, y: np.ndarray) -> np.ndarray:
    """Bits in which the signatures of rows x of q and y of p differ."""
    step = max(1, (1 << 22) // q.sig.shape[1])
    return np.concatenate([np.bitwise_count(q.sig[x[s : s + step]] ^ p.sig[y[s : s + step]]).sum(1, dtype=np.int64) for s in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def opened(q: Side, p: Side, same: bool, apart: bool) -> Iterator[np.ndarray]:
    """(node, node) of the sets of q and p that can link; same: q is p, so each pair is tried from its lesser group; apart: only sets of different blocks."""
    centre = p.sig[p.first]
    step = max(1, min(256, 4_000_000 // len(centre)))
    for s in range(0, len(q.g), step):
        t = slice(s, s + step)
        n, room = q.n[t, None], q.room[t, None]
        fit = (q.g[t, None] < p.group) if same else (q.g[t, None] != p.group)
        fit &= (DEN * p.high >= NUM * n) & (DEN * n >= NUM * p.low)
        need = _need(n, np.maximum(p.low, -(-NUM * n // DEN)))
        fit &= (room >= need) & (p.most >= need)
        x, c = np.nonzero(fit)
        if not len(x):
            continue
        d = _differing(q.sig[t], centre)[x, c] if fit.mean() > 0.2 else _between(q, s + x, p, p.first[c])
        # sets that link differ in no more than this
        keep = d - p.radius[c] <= (q.n[s + x] + p.high[c]) // 7
        x, c = s + x[keep], c[keep]
        if not len(x):
            continue
        k = p.count[c]
        x, y = np.repeat(x, k), np.repeat(p.first[c], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        need = _need(q.n[x], p.n[y])
        keep = (DEN * np.minimum(q.n[x], p.n[y]) >= NUM * np.maximum(q.n[x], p.n[y])) & (q.room[x] >= need) & (p.room[y] >= need)
        if apart:
            keep &= q.block[x] != p.block[y]
        x, y, need = x[keep], y[keep], need[keep]
        keep = _between(q, x, p, y) <= q.n[x] + p.n[y] - 2 * need
        if keep.any():
            yield np.stack((q.node[x[keep]], p.node[y[keep]]), 1)


def short_runs(run: np.ndarray, node: np.ndarray, g: np.ndarray, n: np.ndarray, room: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """As opened, for many short runs at once: rows sorted by (run, n), each tried with those 1, 2, ... places after it."""
    x, y, at, d = [], [], np.arange(len(run)), 0
    while len(at):
        d += 1
        at = at[at + d < len(run)]
        o = at + d
        on = (run[at] == run[o]) & (DEN * n[at] >= NUM * n[o])
        at, o = at[on], o[on]
        need = _need(n[at], n[o])
        fit = (g[at] != g[o]) & (room[at] >= need) & (room[o] >= need)
        x.append(at[fit])
        y.append(o[fit])
    x, y = np.concatenate(x or [at]), np.concatenate(y or [at])
    width = np.fromiter(map(len, raw), np.int64, len(raw))
    least = np.minimum(width[x], width[y])
    keep = np.zeros(len(x), bool)
    for w in np.unique(least).tolist():
        pairs = np.flatnonzero(least == w)
        rows, place = np.unique(np.concatenate((x[pairs], y[pairs])), return_inverse=True)
        sig = np.zeros((len(rows), w // 8), U64)
        for wide in (w, 2 * w):
            some = np.flatnonzero(width[rows] == wide)
            if len(some):
                m = np.frombuffer(b"".join([raw[k] for k in rows[some].tolist()]), U64).reshape(len(some), wide // 8)
                sig[some] = m if wide == w else m[:, : w // 8] ^ m[:, w // 8 :]
        a, b = place[: len(pairs)], place[len(pairs) :]
        step = max(1, (1 << 22) // sig.shape[1])
        for k in range(0, len(pairs), step):
            t = slice(k, k + step)
            differ = np.bitwise_count(sig[a[t]] ^ sig[b[t]]).sum(1, dtype=np.int64)
            i, j = x[pairs[t]], y[pairs[t]]
            keep[pairs[t]] = differ <= n[i] + n[j] - 2 * _need(n[i], n[j])
    return np.stack((node[x[keep]], node[y[keep]]), 1)


def qualifying(rows: DataFrame, most: int = RUN) -> DataFrame:
    """Pairs (a, b) of nodes of different groups that share a token of rows(token, node, g, n, room, held, sig) and can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            x = np.unique(np.sort(np.concatenate(held), 1), axis=0)
            return pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

        def unit(node: np.ndarray, g: np.ndarray, n: np.ndarray, room: np.ndarray, block: np.ndarray, raw: list[bytes], apart: bool) -> Iterator[np.ndarray]:
            if (g == g[0]).all():
                return
            width = np.fromiter(map(len, raw), np.int64, len(raw))
            before: Side | None = None
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                here = Side(node[at], g[at], n[at], room[at], block[at], np.frombuffer(b"".join(raw[k] for k in at), U64).reshape(len(at), w // 8))
                yield from opened(here, here, True, apart)
                if before is not None and before.sig.shape[1] * 16 == w:
                    yield from opened(before, here.narrower(), False, apart)
                before = here

        def take(t: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            keys = np.stack([t[c].to_numpy() for c in ("token", "u", "v")], 1)
            parts = [t[c].to_numpy() for c in ("node", "g", "n", "room", "block")]
            raw = t["sig"].to_pylist()
            edge = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1), [True])))
            length = np.diff(edge)
            short = (length <= SHORT) & (keys[edge[:-1], 1] == keys[edge[:-1], 2])
            rows = np.flatnonzero(np.repeat(short, length))
            if len(rows):
                found = short_runs(np.repeat(np.arange(len(length)), length)[rows], *[c[rows] for c in parts[:4]], [raw[k] for k in rows.tolist()])
                held.append(found)
                size += len(found)
            for i, j in zip(edge[:-1][~short].tolist(), edge[1:][~short].tolist()):
                for found in unit(*[c[i:j] for c in parts], raw[i:j], bool(keys[i, 1] != keys[i, 2])):
                    held.append(found)
                    size += len(found)
                    if size > 500_000:
                        yield out()
                        held, size = [], 0

        for b in batches:
            t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
            if not len(t):
                continue
            last = [t[c][-1].as_py() for c in ("token", "u", "v")]
            same = np.logical_and.reduce([t[c].to_numpy() == v for c, v in zip(("token", "u", "v"), last)])
            cut = int(np.argmax(same))
            left = t.slice(cut)
            if cut:
                yield from take(t.slice(0, cut))
        if left is not None:
            yield from take(left)
        if size:
            yield out()

    # a run of k blocks goes to its k * (k + 1) / 2 pairs of blocks
    k = F.ceil(F.col("held") / most).cast("int")
    x = rows.withColumn("k", k).withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("u", F.least("block", "other")).withColumn("v", F.greatest("block", "other"))
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = x.select("token", "u", "v", "node", "g", "n", "room", "block", "sig").repartition(n, "token", "u", "v").sortWithinPartitions("token", "u", "v", "n")
    return x.mapInArrow(run, "a long, b long").distinct()


def linked(docs: DataFrame, k: int = WORDS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text)."""
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scratch.keep(described(docs, hot_bitmap(docs, k), k).withColumn("uid", F.monotonically_increasing_id()), "described")
    light = scratch.keep(rows.select("doc_id", "n", "k1", "k2", "uid"), "light")
    some = light.filter("n > 0 AND doc_id IS NOT NULL")
    same = some.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "uid")).alias("x"))
    same = scratch.keep(same.select("k1", "k2", "n", F.col("x.doc_id").alias("node"), F.col("x.uid").alias("uid")), "classes")
    # an id with several texts ties their classes
    several = some.groupBy("doc_id").agg(F.min("k1").alias("x"), F.max("k1").alias("y")).filter("x != y").select("doc_id")
    ties = some.select("doc_id", "n", "k1", "k2").join(several, "doc_id", "left_semi").join(same.drop("uid"), ["k1", "k2", "n"]).filter(F.col("doc_id") != F.col("node")).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    buckets = rows.select("uid", "least").join(same.select("uid", "node", "n"), "uid").select("node", "n", F.posexplode("least").alias("i", "h"))
    ends = buckets.groupBy("i", "h").agg(F.min(F.struct("node", "n")).alias("first"), F.max(F.struct("node", "n")).alias("last"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    leaders = ends.select("i", "h", F.explode(F.array("first", "last")).alias("lead")).select("i", "h", F.col("lead.node").alias("a"), F.col("lead.n").alias("na"))
    near = buckets.join(leaders, ["i", "h"]).filter((F.col("node") != F.col("a")) & _can_link("n", "na")).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    near = scratch.keep(near, "near")
    found = measured(near, docs, scratch, k)
    links = scratch.keep(_links(found).union(ties), "links")
    labels = components(links, scratch)
    own = scratch.keep(same.select("uid", "node").join(labels, "node", "left").select("uid", "node", F.coalesce("label", "node").alias("g")), "own")
    grouped = scratch.keep(rows.select("uid", "n", "prefix", "sig").join(own, "uid"), "grouped")
    scratch.drop(rows)
    busy = grouped.select("g", F.explode("prefix").alias("token")).groupBy("token").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.count(F.lit(1)).alias("held"))
    busy = scratch.keep(busy.filter("low < high").select("token", "held"), "busy")
    kept = scratch.keep(partnered(matrix(grouped, busy).join(busy, "token")), "partnered")
    pairs = scratch.keep(qualifying(kept.join(grouped.select("uid", "node", "sig"), "uid")), "pairs")
    more = measured(pairs, docs, scratch, k)
    all_links = scratch.keep(links.select("a", "b").union(_links(more)), "links")
    labels2 = components(all_links, scratch)
    of = scratch.keep(same.join(labels2, "node", "left").select("k1", "k2", "n", F.coalesce("label", "node").alias("component_id")), "of")
    out = light.select("doc_id", "n", "k1", "k2").join(of, ["k1", "k2", "n"], "left")
    one = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    out = scratch.keep(out.select("doc_id", F.col("n").alias("n_shingles"), one.cast("long").alias("component_id")), "result")
    scratch.drop(light, same, near, found, links, labels, own, grouped, busy, kept, pairs, more, all_links, labels2, of)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(read_table(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= {WORDS} THEN list_distinct(list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i:i + {WORDS - 1}], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {DEN} * count(*) >= {NUM} * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.doc_id)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, (SELECT min(root) FROM c WHERE c.doc_id = s.doc_id) AS component_id FROM s
"""
