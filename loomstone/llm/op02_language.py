"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads a text's bytes (A-Z folded) forwards and backwards, white space, digits and signs among them, and
gives every byte position a distribution over the languages; a document's distribution is the mean over all its
positions. Texts are read in windows of WINDOW bytes, and a window is entered CONTEXT bytes before its first position
and after its last, so each position has seen that much of the text on either side, or all there is; what lies further
off does not reach it.

Training is plain numpy, backpropagation through time and Adam, on the driver, on a bounded sample: for each language
the SAMPLE rows of least hash, SEGMENT characters of each from a hashed place, of which each batch takes TRAINED bytes
from random places; more than LANGUAGES languages are an error. Rows of which crc32(doc_id as text) mod 3 is HELD_OUT are never learned from; lang, source and
doc_id are never inputs.

Defined cases: null text and text without a letter get `und` and score 0; without labelled rows all documents get
`und`; long texts are read whole; repeated rows get equal results; an empty table gives an empty result; columns named
like the outputs are replaced in `labelled`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import read_table
from .textnum import buffers, chunks

HELD_OUT, SAMPLE, SEGMENT, TRAINED, WINDOW, CONTEXT, ROWS, LANGUAGES, HIDDEN = 1, 300, 600, 64, 448, 32, 384, 10_000, 12
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == HELD_OUT, F.lit(False))


def _turned(size: np.ndarray, steps: int) -> np.ndarray:
    """(steps, rows): where step t of a row of `size` positions stands when it is read backwards; the rest stays."""
    t = np.arange(steps)[:, None]
    return np.where(t < size, size - 1 - t, t)


class ByteGRU:
    """Weights by direction: E (256, 3H) the bytes' part of update, reset and candidate with biases, U (H, 2H), C (H, H); then V (2H, L), c (L). Rows of a batch are columns here."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        n, self.labels, self.h = len(labels), labels, hidden
        self.w = {}
        for d in "fb":
            self.w["E" + d] = rng.normal(0, 0.4, (256, 3 * hidden))
            self.w["U" + d] = rng.normal(0, hidden**-0.5, (hidden, 2 * hidden))
            self.w["C" + d] = rng.normal(0, hidden**-0.5, (hidden, hidden))
        self.w["V"], self.w["c"] = rng.normal(0, 0.3, (2 * hidden, n)), np.zeros(n)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _states(self, x: np.ndarray, d: str, tape: list | None = None, seen: np.ndarray | None = None) -> np.ndarray:
        """x: bytes (steps, rows) -> states (steps, H, rows), or what seen (H, L) makes of them, so that no states are kept."""
        e, u, c, n = self.w["E" + d], self.w["U" + d].T, self.w["C" + d].T, self.h
        h = np.zeros((n, x.shape[1]), e.dtype)
        out = np.empty((len(x), n if seen is None else seen.shape[1], x.shape[1]), e.dtype)
        for t in range(len(x)):
            a = e[x[t]].T
            g = u @ h
            g += a[: 2 * n]
            g *= 0.5  # a sigmoid is half a hyperbolic tangent, and a half
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            k = c @ (g[n:] * h)
            k += a[2 * n :]
            np.tanh(k, out=k)
            if tape is not None:
                tape.append((h, g[:n], g[n:], k))
            h = h + g[:n] * (k - h)
            out[t] = h if seen is None else seen.T @ h
        return out

    def _back(self, x: np.ndarray, d: str, tape: list, dout: np.ndarray, grad: dict) -> None:
        u, c, n = self.w["U" + d], self.w["C" + d], self.h
        gu, gc, da = np.zeros_like(u), np.zeros_like(c), np.empty((len(x), 3 * n, x.shape[1]), u.dtype)
        dh = np.zeros((n, x.shape[1]), u.dtype)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, k = tape[t]
            dh = dh + dout[t]
            dk = dh * z * (1 - k * k)
            drh = c @ dk
            da[t, :n], da[t, n : 2 * n], da[t, 2 * n :] = dh * (k - h) * z * (1 - z), drh * h * r * (1 - r), dk
            gu += h @ da[t, : 2 * n].T
            gc += (r * h) @ dk.T
            dh = dh * (1 - z) + drh * r + u @ da[t, : 2 * n]
        ge = np.zeros_like(self.w["E" + d])
        np.add.at(ge, x.ravel(), da.transpose(0, 2, 1).reshape(-1, 3 * n))
        grad["E" + d], grad["U" + d], grad["C" + d] = ge, gu, gc

    def position_probabilities(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(steps, L, rows) for bytes x (steps, rows), of which the first `size` of a row count."""
        turn, v = _turned(size, len(x)), self.w["V"]
        f = self._states(x, "f", seen=v[: self.h])
        b = self._states(np.take_along_axis(x, turn, 0), "b", seen=v[self.h :])
        return self._shares(f, b, turn)

    def _shares(self, f: np.ndarray, b: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Distributions from both directions' sums, those backwards in their own order."""
        s = np.take_along_axis(b, turn[:, None, :], 0)
        s += f
        s += self.w["c"][:, None]
        s -= s.max(1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(1, keepdims=True)
        return s

    def step(self, x: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean loss over positions, and gradients."""
        tapes: dict[str, list] = {"f": [], "b": []}
        turn, v = _turned(size, len(x)), self.w["V"]
        f, b = self._states(x, "f", tapes["f"]), self._states(np.take_along_axis(x, turn, 0), "b", tapes["b"])
        p = self._shares(v[: self.h].T @ f, v[self.h :].T @ b, turn)
        rows, count = np.arange(len(y)), size.sum()
        mask = np.arange(len(x))[:, None] < size
        loss = -(np.log(p[:, y, rows] + 1e-9) * mask).sum() / count
        p[:, y, rows] -= 1
        p *= (mask / count)[:, None, :].astype(p.dtype)
        q = np.take_along_axis(p, turn[:, None, :], 0)
        grad = {"V": np.concatenate([np.einsum("thr,tlr->hl", s, g) for s, g in ((f, p), (b, q))]), "c": p.sum((0, 2))}
        self._back(x, "f", tapes["f"], v[: self.h] @ p, grad)
        self._back(np.take_along_axis(x, turn, 0), "b", tapes["b"], v[self.h :] @ q, grad)
        return float(loss), grad

    def train(self, texts: list[bytes], y: np.ndarray, steps: int = 400, rows: int = 256, length: int = TRAINED, rate: float = 0.02, seed: int = 7) -> float:
        """Adam over random pieces of random texts, languages drawn alike often."""
        rng, loss = np.random.default_rng(seed), 0.0
        of = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(v) for k, v in self.w.items()}
        for i in range(1, steps + 1):
            pick = np.concatenate([rng.choice(a, max(1, rows // len(of))) for a in of if len(a)])
            at = [int(rng.integers(0, max(1, len(texts[j]) - length + 1))) for j in pick]
            batch = [texts[j][s : s + length] for j, s in zip(pick, at)]
            x = np.frombuffer(b"".join(b.ljust(length, b"\0") for b in batch), np.uint8).reshape(len(batch), length).T
            got, grad = self.step(_FOLD[x], np.fromiter(map(len, batch), np.int64, len(batch)), y[pick])
            loss = got if i == 1 else 0.95 * loss + 0.05 * got
            scale = rate * min(1, 2 * (1 - i / (steps + 1)))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1, 1 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.w[k] -= (scale * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)).astype(np.float32)
        return loss

    def documents(self, texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """Mean distribution of each text over all its positions; zeros where there are none."""
        data, offsets = buffers(texts)
        out = np.zeros((len(offsets) - 1, len(self.labels)))
        for i, j in chunks(offsets):
            part, at = _FOLD[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
            size = np.diff(at)
            count = -(-size // WINDOW)
            own = np.repeat(np.arange(len(size)), count)
            first = at[own] + WINDOW * (np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count))
            last = np.minimum(first + WINDOW, at[own + 1])
            low, high = np.maximum(first - CONTEXT, at[own]), np.minimum(last + CONTEXT, at[own + 1])
            order = np.argsort(low - high, kind="stable")  # windows of like length share a batch
            for s in range(0, len(order), ROWS):
                k = order[s : s + ROWS]
                length = high[k] - low[k]
                t = np.arange(length[0])[:, None]
                x = part[np.minimum(low[k] + t, high[k] - 1)]
                p = self.position_probabilities(x, length)
                p *= ((t >= first[k] - low[k]) & (t < last[k] - low[k]))[:, None, :]
                np.add.at(out, i + own[k], p.sum(0, dtype=np.float64).T)
            out[i:j] /= np.maximum(size, 1)[:, None]
        return out

    def label(self, texts: pa.Array | pa.ChunkedArray) -> tuple[list[str], np.ndarray]:
        p = self.documents(texts) if self.labels else np.zeros((len(texts), 1))
        best, score = p.argmax(1), np.clip(p.max(1), 0, 1)
        names = [self.labels[k] if s > 0 else "und" for k, s in zip(best.tolist(), score.tolist())]
        ascii_letter = pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), False).to_pylist()
        for i, sure in enumerate(ascii_letter):
            if not sure and not any(c.isalpha() for c in texts[i].as_py() or ""):
                names[i], score[i] = "und", 0.0
        return names, score


def fit(docs: DataFrame, sample: int = SAMPLE, segment: int = SEGMENT) -> ByteGRU:
    """Train on docs(doc_id, text, lang) outside the held-out third."""
    h = F.xxhash64(F.col("doc_id").cast("string"))
    near = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    near = near.select("lang", h.alias("h"), "text")
    # of a language's rows only the share with the least hashes that is sure to hold the sample goes on to be sorted
    share = {r["lang"]: (2 * sample + 100) / r["count"] for r in near.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(share) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not share:
        return ByteGRU([])
    shares = F.create_map(*[F.lit(x) for kv in sorted(share.items()) for x in kv])
    some = near.filter(F.col("h") / float(1 << 64) + 0.5 <= shares[F.col("lang")])
    place = (1 + F.pmod("h", F.greatest(F.length("text") - segment, F.lit(1)))).cast("int")
    some = some.select("lang", "h", F.substring(F.col("text"), place, F.lit(segment)).alias("seg")).groupBy("lang", "h").agg(F.min("seg").alias("seg"))
    top = some.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "seg"))).filter(F.col("nth") <= sample)
    rows = sorted((r["lang"], r["h"], r["seg"]) for r in top.collect())  # sample rows of segment characters a language
    labels = sorted({r[0] for r in rows})
    net = ByteGRU(labels)
    texts = [(r[2].encode(), labels.index(r[0])) for r in rows if r[2]]
    if texts:
        net.train([t for t, _ in texts], np.array([y for _, y in texts]))
    return net


def labelled(docs: DataFrame, net: ByteGRU, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, every other column as it is."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    place = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score = net.label(b.column(place))
            yield pa.record_batch([*b.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*keep).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    net = fit(docs)
    x = labelled(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), net)
    return x.select("doc_id", "held_out", "lang_pred", "score")
