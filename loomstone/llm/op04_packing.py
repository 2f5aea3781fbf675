"""Pack token sequences into windows with little padding by minimum bin slack.

1. Texts become ids in Arrow batches. Text is cut at ASCII white space, which the tokenizer drops anyway, each
   distinct word is tokenized once a worker, and a document's ids are gathered from the words' ids. A document is
   its ids and then END_ID. Documents longer than a window are cut at multiples of the window.
2. Pieces are counted by length: at most `window` rows, whatever the number of documents.
3. On that multiset, on the driver, each window starts with the longest piece left; a bitset subset-sum over the
   other lengths finds the filling nearest to the capacity, backtracked to counts. A pattern of counts repeats as
   often as the counts allow, so each pattern uses a length up and there are at most `window` patterns.
4. Pieces are numbered within their length, in parts of about PART_ROWS with summed offsets, so that no length,
   however common, is ordered in one task; a range join with the patterns' slots gives sequence and offset.

A sequence is padded to the window unless its length is a power of two.

Defined cases: null text is empty, and an empty document is END_ID alone; repeated rows are packed as often as they
stand; an empty table gives no pieces; texts are tokenized whole, whatever their length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, read_table
from .textnum import buffers, chunks, words

WINDOW, END_ID, PART_ROWS, WORDS_KEPT = 4096, 2, 1_000_000, 3_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


_KINDS = np.ones(256, np.uint8)
_KINDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KINDS[65:91] = _KINDS[97:123] = _KINDS[128:] = 2


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """Hashed parts of texts whose ids stand for themselves: words, or, where the bytes show that the tokenizer splits there too, runs of letters (case folded) and of other signs.

    It splits between letters and other signs, but for contractions; marks, signs beyond Latin-1 and special tokens are left to it. Last: whether words were split so."""
    after = data[1:][data[:-1] == 0xC3]
    if (data == 0x27).any() or (data >= 0xC4).any() or (data == 0xC2).any() or (after == 0x97).any() or (after == 0xB7).any() or ((data[:-1] == 0x3C) & (data[1:] == 0x7C)).any():
        h, start, end, at = words(data, offsets, lower=False)
        return h ^ np.uint64(0x5851F42D4C957F2D), start, end, at, False
    return *words(data, offsets, lower=True, inner=_KINDS), True


class WordTokens:
    """Ids of words, tokenized once each, in a table addressed by their hashes; emptied when it holds WORDS_KEPT words."""

    def __init__(self, path: str, kept: int = WORDS_KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ending = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ending[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.kept, self.mask = kept, (1 << max(4, int(2.5 * kept).bit_length())) - 1
        self.empty()

    def empty(self) -> None:
        self.n, self.used = 0, 0
        self.slots = np.full(self.mask + 1, -1, np.int32)
        self.hashes, self.counts, self.first = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.uint32 if self.tokenizer.get_vocab_size() > 65_535 else np.uint16)

    def _grown(self, name: str, n: int) -> np.ndarray:
        a = getattr(self, name)
        if len(a) < n:
            a = np.concatenate((a, np.zeros(max(n - len(a), len(a) // 2), a.dtype)))
            setattr(self, name, a)
        return a

    def _tokenized(self, texts: list[str], runs: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has. Of runs of letters each ends with its only id that ends a word, so they are tokenized as one text."""
        if runs:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, self.ids.dtype)
            ends = np.flatnonzero(self.ending[ids]) + 1
            if len(ends) == len(texts) and ends[-1] == len(ids):
                return ids, np.diff(ends, prepend=0).astype(np.int32)
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for x in found for i in x), self.ids.dtype), np.fromiter(map(len, found), np.int32, len(found))

    def learn(self, hashes: np.ndarray, texts: list[str], runs: bool = False) -> None:
        """Add distinct new words; runs: each is a run of letters."""
        for s in range(0, len(texts), 4096):
            h = hashes[s : s + 4096]
            ids, counts = self._tokenized(texts[s : s + 4096], runs)
            n = self.n + len(h)
            self._grown("hashes", n)[self.n : n] = h
            self._grown("counts", n)[self.n : n] = counts
            self._grown("first", n)[self.n : n] = self.used + np.cumsum(counts) - counts
            self._grown("ids", self.used + len(ids))[self.used : self.used + len(ids)] = ids
            left, step = np.arange(self.n, n, dtype=np.int32), 0
            while len(left):
                at = (self.hashes[left] + np.uint64(step) & np.uint64(self.mask)).astype(np.int64)
                free = self.slots[at] < 0
                self.slots[at[free]] = left[free]
                left = left[self.slots[at] != left]
                step += 1
            self.n, self.used = n, self.used + len(ids)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number, -1 for words not seen."""
        at = (hashes & np.uint64(self.mask)).astype(np.int64)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.hashes[out] != hashes))
        step = 1
        while len(todo):
            out[todo] = self.slots[(hashes[todo] + np.uint64(step) & np.uint64(self.mask)).astype(np.int64)]
            todo = todo[(out[todo] >= 0) & (self.hashes[out[todo]] != hashes[todo])]
            step += 1
        return out

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids in one array, and rows+1 offsets."""
        h, start, end, at, split = units(data, offsets)
        if not len(h):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        where = self.find(h)
        new = np.flatnonzero(where < 0)
        if len(new):
            distinct, place = np.unique(h[new], return_index=True)
            if self.n and self.n + len(distinct) > self.kept:
                self.empty()
                distinct, place, new = *np.unique(h, return_index=True), np.arange(len(h))
            place, raw = new[place], data.tobytes()
            letters = (_KINDS[data[start[place]]] == 2) & split
            for some, runs in ((letters, True), (~letters, False)):
                self.learn(distinct[some], [raw[start[i] : end[i]].decode() for i in place[some]], runs)
            where = self.find(h)
        counts = self.counts[where].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(counts)))
        ids = self.ids[np.repeat(self.first[where] - ends[:-1], counts) + np.arange(ends[-1])]
        return ids, ends[at]


#: A worker process keeps its words from task to task.
_TOKENS: dict[str, WordTokens] = {}


def piece_rows(tokens: WordTokens, doc_ids: pa.Array, texts: pa.Array, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    data, offsets = buffers(texts)
    for i, j in chunks(offsets):
        ids, at = tokens.of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        rows: tuple[list, ...] = ([], [], [], [], [])
        end = np.array([end_id], "<u4").tobytes()
        raw = memoryview(ids.astype("<u4").tobytes())
        for k, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            whole = bytes(raw[4 * s : 4 * e]) + end
            n = e - s + 1
            for x in range(0, n, window):
                rows[0].append(i + k)
                rows[1].append(x)
                rows[2].append(min(window, n - x))
                rows[3].append(zlib.crc32(whole[4 * x : 4 * (x + window)]))
                rows[4].append(n)
        yield pa.record_batch([doc_ids.take(pa.array(rows[0], pa.int64())), *(pa.array(x, pa.int64()) for x in rows[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _TOKENS.get(path) or _TOKENS.setdefault(path, WordTokens(path))
        for b in batches:
            yield from piece_rows(tokens, b.column(0).cast(pa.int64()), b.column(1), window, end_id)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def fill(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Of the multiset counts, (length, how many) whose sum is nearest to room from below: subset-sum on a bitset, longest lengths first, ended when room is met."""
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, bits))
            bits |= bits << (length * take) & mask
            left -= take
            take *= 2
            if bits >> room & 1:
                left = 0
        if bits >> room & 1:
            break
    at, used = bits.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if at and not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return sorted(used.items(), reverse=True)


def patterns(counts: dict[int, int], window: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, pieces)]) that use counts up, by minimum bin slack around the longest piece left."""
    counts, out = dict(counts), []
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        chosen = dict(fill({k: v for k, v in rest.items() if v}, window - longest))
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in chosen.items())
        for k, n in chosen.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append((times, sorted(chosen.items(), reverse=True)))
    return out


def slots(found: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a sequence, first sequence, offset in it) by pattern and length."""
    used, out, sequence = {}, [], 0
    for times, chosen in found:
        offset = 0
        for length, n in chosen:
            a = used.get(length, 0)
            used[length] = a + n * times
            out.append((length, a, a + n * times, n, sequence, offset))
            offset += length * n
        sequence += times
    return out


def pack(parts: DataFrame, scratch: Scratch, window: int = WINDOW, part_rows: int = PART_ROWS) -> DataFrame:
    """parts with sequence_id and offset; parts is a written table with a column length of 1 to window, and p_uid, a number of each row, which goes."""
    spark = parts.sparkSession
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most `window` rows
    many = [(length, -(-n // part_rows)) for length, n in sorted(counts.items()) if n > part_rows]
    salts = F.lit(1)
    if many:
        salts = F.coalesce(F.create_map(*[F.lit(x) for m in many for x in m])[F.col("length").cast("int")], F.lit(1))
    parts = parts.withColumn("p_salt", F.pmod(F.xxhash64("p_uid"), salts).cast("int"))
    by = parts.groupBy("length", "p_salt").count()
    found = slots(patterns(counts, window))
    before = Window.partitionBy("length").orderBy("p_salt").rowsBetween(Window.unboundedPreceding, -1)
    by = scratch.keep(by, "lengths")
    base = by.select("length", "p_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("p_base"))
    within = Window.partitionBy("length", "p_salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens", "p_uid")
    ranked = parts.withColumn("p_nth", F.row_number().over(within) - 1)
    ranked = ranked.join(F.broadcast(base), ["length", "p_salt"]).withColumn("p_rank", F.col("p_base") + F.col("p_nth"))  # window + pieces / PART_ROWS rows at most
    if found:
        where = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in zip(*found)], ["length", "p_from", "p_to", "p_each", "p_seq", "p_off"]))
    else:
        where = spark.createDataFrame([], "length long, p_from long, p_to long, p_each long, p_seq long, p_off long")
    spread = where.withColumnRenamed("length", "s_length")  # different lengths of a pattern add up to window at most, so 90 of them at 4096; each pattern uses a length up
    out = ranked.join(F.broadcast(spread), (F.col("length") == F.col("s_length")) & (F.col("p_rank") >= F.col("p_from")) & (F.col("p_rank") < F.col("p_to")))
    nth = F.col("p_rank") - F.col("p_from")
    return out.withColumn("sequence_id", F.col("p_seq") + F.floor(nth / F.col("p_each"))).withColumn("offset", F.col("p_off") + F.col("length") * F.pmod(nth, F.col("p_each"))).drop("p_uid", "p_salt", "p_nth", "p_base", "p_rank", "s_length", "p_from", "p_to", "p_each", "p_seq", "p_off")


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    scratch = Scratch(docs.sparkSession, "pack")
    parts = scratch.keep(pieces(docs, path, window, end_id).withColumn("p_uid", F.monotonically_increasing_id()), "pieces")
    return pack(parts, scratch, window)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
