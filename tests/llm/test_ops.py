"""Edge cases and brute-force twins of the training-data operators."""

import base64
import hashlib
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from util import same_as_sql  # noqa: E402

from loomstone.llm import op01_imatch, op02_language, op03_warc, op04_packing, op05_lines, op06_licenses, op07_html, op08_mixing, op09_hamming, op10_jaccard, stages  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"
WORDS = [f"w{i}" for i in range(60)]
BASE = " ".join(WORDS)


@pytest.fixture(scope="module")
def docs(spark):
    lines = "\n".join(" ".join(WORDS[i : i + 5]) for i in range(0, 30, 5))
    rows = [
        (1, BASE, "en", "a"), (2, BASE.upper(), "en", "a"), (3, BASE + " tail", "en", "b"), (4, None, None, None), (5, "", "en", "a"), (6, "  \n ", "en", "b"), (7, "one two", "en", "c"), (8, "One  TWO", None, "c"),
        (9, lines, "en", "d"), (10, lines + "\nlast line here", "en", "d"), (11, lines, "en", "d"), (12, " ".join(WORDS * 300), "en", "a"), (12, " ".join(WORDS * 300), "en", "a"), (14, "éèà ñ — ü", "fr", "b"), (15, "123 456 !!", "en", "b"),
    ]
    return spark.createDataFrame([(i, t, l, s, len(t or ""), 0.5) for i, t, l, s in rows], DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))


def test_jaccard(docs):
    d = docs.toPandas()
    sets = {}
    for i, t in zip(d.doc_id, d.text):
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in op10_jaccard.linked(docs).collect()}
    assert got == {(i, len(sets[i]), label[i]) for i in sets}
    assert op10_jaccard.linked(docs.limit(0)).count() == 0
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert {r.component_id for r in op10_jaccard.linked(nulls).collect()} == {None}


def test_jaccard_chain_of_copies(spark):
    rng = np.random.default_rng(1)
    rows, text = [], [f"t{k}" for k in range(120)]
    for i in range(60):
        text = list(text)
        text[int(rng.integers(0, 120))] = f"n{i}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in op10_jaccard.linked(df).collect()} == {0}


def test_jaccard_and_warc_are_as_their_sql(spark, docs, tmp_path):
    distinct = docs.dropDuplicates(["doc_id"])
    same_as_sql(op10_jaccard.linked(distinct), op10_jaccard.SQL, {"documents": distinct})
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(["a", "é", "a", None, "", "x" * 1000, "a"])], "page_id long, url string, html string")
    got = op03_warc.read(op03_warc.write(pages, f"file://{tmp_path}/s")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    same_as_sql(got.fillna(-1, ["refers_to"]), f"SELECT * REPLACE (coalesce(refers_to, -1) AS refers_to) FROM ({op03_warc.SQL})", {"pages": pages})


def test_mixing_and_lines_are_as_their_sql(docs):
    distinct = docs.dropDuplicates(["doc_id"])
    x = op08_mixing.mixed_rows(distinct).select("doc_id", F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"), F.col("m_target").alias("target"), (F.col("m_size") * F.col("m_taken_copies")).alias("taken"))
    same_as_sql(x, op08_mixing.SQL, {"documents": distinct})
    got = x.collect()
    assert all(0 <= r.taken <= 3 * r.size for r in got) and op08_mixing.mixed_rows(docs.limit(0)).count() == 0
    same_as_sql(op05_lines.deduplicated(distinct.select("doc_id", "text")), op05_lines.SQL, {"documents": distinct})
    kept = {r.doc_id: r.text for r in op05_lines.deduplicated(docs).collect()}
    assert kept[11] == "" and kept[10] == "last line here" and kept[9].count("\n") == 5 and kept[4] is None


def test_packing_round_trip(docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    got = op04_packing.packed(docs).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got.itertuples():
        ids = np.array([*tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= 4096
    assert op04_packing.packed(docs.limit(0)).count() == 0


def test_packing_of_one_length_in_parts(spark):
    from loomstone.llm.scratch import Scratch

    scratch = Scratch(spark, "parts")
    rows = spark.createDataFrame([(1, 0, 7, 5, 7)] * 500 + [(i, 0, 1 + i % 11, i, 1 + i % 11) for i in range(700)], op04_packing.PIECES).withColumn("p_uid", F.monotonically_increasing_id())
    got = op04_packing.pack(scratch.keep(rows, "rows"), scratch, 32, 60).toPandas()
    assert len(got) == 1200 and set(got.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    ends = []
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()]
        ends.append(g.length.sum())
    assert max(ends) == 32 and sum(32 - e for e in ends) < 32


def test_packing_leaves_least_slack():
    """Each filling against all multisets of a few lengths."""
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(200):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, 15, 4), rng.integers(1, 4, 4))}
        room = int(rng.integers(1, 40))
        best = max(t for t in (sum(k * n for k, n in zip(counts, x)) for x in product(*[range(n + 1) for n in counts.values()])) if t <= room)
        got = op04_packing.fill(counts, room)
        assert sum(k * n for k, n in got) == best and all(n <= counts[k] for k, n in got)


def test_minimum_bin_slack():
    assert sum(k * n for k, n in op04_packing.fill({7: 2, 5: 3, 3: 1}, 17)) == 17
    assert sum(k * n for k, n in op04_packing.fill({6: 5}, 17)) == 12
    found = op04_packing.patterns({10: 3, 6: 4, 4: 2}, 16)
    assert sum(t * sum(n for _, n in c) for t, c in found) == 9


def test_warc(spark, tmp_path):
    rows = [(1, "u", "a"), (2, None, "a"), (3, "x\ny", "a"), (4, "z", None), (5, "w", ""), (None, "q", "a")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in op03_warc.read(op03_warc.write(p, f"file://{tmp_path}/w", roll=300)).collect()}
    assert [(got[k].record_type, got[k].refers_to) for k in (1, 2, 3, 4, 5, None)] == [("revisit", 3), ("revisit", 3), ("response", None), ("revisit", 5), ("response", None), ("revisit", 3)]
    assert got[3].payload == b"a" and got[1].payload_digest == base64.b32encode(hashlib.sha1(b"a").digest()).decode() and got[1].payload_bytes == 1
    files = sorted((f.name, f.read_bytes()) for f in (tmp_path / "w").glob("*.gz"))
    op03_warc.write(p, f"file://{tmp_path}/v", roll=300)
    assert files == sorted((f.name, f.read_bytes()) for f in (tmp_path / "v").glob("*.gz"))
    assert op03_warc.read(op03_warc.write(p.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_imatch(docs):
    d = docs.select("doc_id", "text")
    got = op01_imatch.query_rows(d, op01_imatch.lexicon(d)).toPandas().sort_values("doc_id", kind="stable")
    t = docs.toPandas().sort_values("doc_id", kind="stable").text.fillna("").tolist()
    want = [hashlib.sha256(op01_imatch.edited(a, b).encode()).hexdigest() for a, b in zip(t, t[1:] + t[:1])]
    assert got.edited_sha256.tolist() == want and got.n_chars.tolist() == [len(x) for x in t]
    assert len(set(got.fingerprint[got.doc_id == 12])) == 1 and got.near_edited.between(0, 1).all()
    assert op01_imatch.query_rows(d.limit(0), np.zeros(0, np.uint64)).count() == 0


def test_imatch_keeps_the_whole_band(spark):
    texts = [" ".join(f"{c}{i:x}" for i in range(130_000)) for c in "gh"]
    d = spark.createDataFrame([(i, texts[i % 2]) for i in range(4)], "doc_id long, text string")
    got = op01_imatch.lexicon(d)
    want = np.concatenate(op01_imatch.term_sets(*op01_imatch.buffers(pa.array(texts))))
    assert len(got) == 260_000 and np.array_equal(got, np.sort(want))
    assert len(op01_imatch.lexicon(d.limit(0))) == 0


def test_imatch_compares_over_one_vocabulary(spark):
    a, b = " ".join(f"rare{i}" for i in range(400)), " ".join(f"kept{i}" for i in range(400))
    d = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    band = np.sort(np.concatenate(op01_imatch.term_sets(*op01_imatch.buffers(pa.array([b])))))
    got = {r.doc_id: r for r in op01_imatch.query_rows(d, band).collect()}
    assert got[1].near_edited > 0.2 and got[1].near_next < 0.1 and got[2].near_edited > 0.2


def test_language(spark, docs):
    a, b = "the and of that with for this", "der die und nicht auf mit das"
    train = spark.createDataFrame([(i, (a if i % 2 else b) * 3, "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
    net = op02_language.fit(train)
    got = {r.doc_id: r for r in op02_language.labelled(train.select("doc_id", "text"), net).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    odd = {r.doc_id: r.lang_pred for r in op02_language.labelled(docs, net).collect()}
    assert [odd[i] for i in (4, 5, 6, 15)] == ["und"] * 4 and odd[14] != "und"
    assert op02_language.labelled(docs.limit(0), net).count() == 0


def test_gradients():
    g = op02_language.ByteGRU(["a", "b", "c"], 4)
    g.w = {k: v.astype(np.float64) for k, v in g.w.items()}
    x, size, y = np.random.default_rng(0).integers(97, 110, (5, 6)), np.array([3, 3, 5, 5, 1, 5]), np.array([0, 1, 2, 0, 1, 2])
    _, grad = g.step(x, size, y)
    for k, v in g.w.items():
        i = np.unravel_index(np.abs(grad[k]).argmax(), v.shape)
        v[i] += 1e-3
        up = g.step(x, size, y)[0]
        v[i] -= 2e-3
        assert abs((up - g.step(x, size, y)[0]) / 2e-3 - grad[k][i]) < 1e-3
        v[i] += 1e-3


def test_language_positions_are_as_byte_by_byte():
    """Windows and batches against a plain reading of each position's surroundings, one byte at a time."""
    net = op02_language.ByteGRU(["a", "b"], 3)
    rng = np.random.default_rng(1)
    texts = ["", None, "x", "Abc 12", "".join(chr(c) for c in rng.integers(97, 123, 1000)), "é ü" * 200, " ".join(["Word"] * 300)]
    sig = lambda v: 1 / (1 + np.exp(-v))

    def state(data, d):
        h = np.zeros(3)
        for byte in data:
            a = net.w["E" + d][byte]
            z, r = np.split(sig(a[:6] + h @ net.w["U" + d]), 2)
            h = h + z * (np.tanh(a[6:] + (r * h) @ net.w["C" + d]) - h)
        return h

    got = net.documents(pa.array(texts, pa.string()))
    w, c = op02_language.WINDOW, op02_language.CONTEXT
    for t, p in zip(texts, got):
        data = (t or "").encode()
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
        total = np.zeros(2)
        for k in range(len(data)):
            low, high = max(0, k // w * w - c), min(len(data), k // w * w + w + c)
            s = np.concatenate((state(data[low : k + 1], "f"), state(data[k:high][::-1], "b"))) @ net.w["V"] + net.w["c"]
            total += np.exp(s) / np.exp(s).sum()
        assert np.allclose(p, total / max(1, len(data)), atol=1e-4)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = op02_language.fit(docs)
    got = op02_language.labelled(docs.filter(op02_language.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 20)), net).select((F.col("lang") == F.col("lang_pred")).cast("int").alias("right")).agg(F.avg("right"), F.count("*")).first()
    assert got[1] > 200 and got[0] >= 0.98


def test_licenses(spark):
    t = "Intro here.\nReleased under the  MIT-License.\nMore. This work is licensed under the GNU General Public License, version 3."
    got = op06_licenses.scanned(spark.createDataFrame([(1, t), (2, None), (3, "nothing of the kind")], "doc_id long, text string")).orderBy("start").collect()
    assert [(r.doc_id, r.license, r.coverage) for r in got] == [(1, "MIT-notice", 1.0), (1, "GPL-3.0-notice", 1.0)]
    assert t[got[0].start : got[0].end] == "Released under the  MIT-License"


def test_licenses_whole_texts_and_telling_words(spark):
    known = op06_licenses.TEMPLATES
    whole = ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0", "Unlicense", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "GFDL-1.2", "GFDL-1.3", "Artistic-1.0-Perl", "CC0-1.0")
    heads = ("GPL-2.0-header", "LGPL-2.1-header", "AGPL-3.0-header", "CC-BY-3.0", "CC-BY-4.0-notice", "CC-BY-NC-SA-2.5-notice")
    texts = [f"Copyright 2020 A. Nyone.\n{known[k]}\nint main() {{}}" for k in whole + heads] + ["Licensed under CC BY 5.0", "Licensed under CC BY 3.0"]
    got = op06_licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {i: [(r.license, r.coverage) for r in got if r.doc_id == i] for i in range(len(texts))}
    assert found == {i: [(k, 1.0)] for i, k in enumerate(whole + heads)} | {len(texts) - 2: [], len(texts) - 1: [("CC-BY-3.0-notice", 1.0)]}


def test_html():
    page = '<body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>T &amp; u</h1><p>One long sentence of real content here.<br>Next<p><b>Two more words follow here.</p><div class="ad"><p>Buy this now, it is cheap and very good.</p></div></article><section id="comments"><article><p>I liked this very much indeed.</p></article></section><footer>&copy;</footer>'
    assert op07_html.content(page) == ["T & u", "One long sentence of real content here. Next", "Two more words follow here."]
    assert op07_html.content("") == [] and op07_html.blocks("<p title='x") == []


def test_html_elements_without_end_tags_hide_nothing():
    for tag in ("svg", "object", "video", "select", "canvas", "template", "math", "datalist"):
        page = f"<article><p>The first paragraph is here to be read.</p><{tag}><p>The second paragraph is here to be read.</p></article>"
        assert len(op07_html.content(page)) == 2, tag
        whole = f"<article><p>The first paragraph is here to be read.<{tag}>in it</{tag}> And on.</p></article>"
        assert op07_html.content(whole) == [f"The first paragraph is here to be read.{'in it' if tag == 'math' else ''} And on."], tag
    for tag in ("script", "style", "textarea", "title"):
        assert len(op07_html.content(f"<article><p>The first paragraph is here to be read.</p><{tag}><p>The second one is not.</p></article>")) == 1


LINKS = "".join(f"<li><a href=/{w}>{w}</a></li>" for w in ("Home", "News", "Sport", "Weather"))
UNMARKED = f"<ul>{LINKS}<li>Read our long story about the sea today.</li>{LINKS}</ul><div><p>The first paragraph is here to be read.</p><div>Yes and so</div><p>The second paragraph is here to be read.</p></div>"


def test_html_edges_change_pages_for_the_better():
    alone = op07_html.Model(op07_html.PRIOR, (0.0,) * 4)
    good = ["The first paragraph is here to be read.", "Yes and so", "The second paragraph is here to be read."]
    assert op07_html.content(UNMARKED) == good
    assert op07_html.content(UNMARKED, alone) == ["Read our long story about the sea today.", good[0], good[2]]


def test_html_labelling_is_least_of_all(spark):
    rng = np.random.default_rng(5)
    parts = ["<p>A sentence of some words, and more.</p>", "<div>Odd bit</div>", "<ul><li><a href=x>Go</a></li><li>Stay here and read this.</li></ul>", "<div class=ad><p>Buy it now, and be glad.</p></div>", "<div class=story><h2>Head</h2><p>Text of it all.</p></div>", "<footer>End.</footer>"]
    for _ in range(40):
        page = "".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(1, 8)))
        found = op07_html.blocks(page)
        model = op07_html.Model(op07_html.PRIOR, tuple(rng.random(4) * 3))
        gain, edges = op07_html.labelling(found, model)
        # the same costs, told anew from the blocks
        for g, (text, share, node) in zip(gain, found):
            seen = float(np.dot(op07_html.features(text, share, node), op07_html.PRIOR))
            assert abs(g - (max(-3.0, min(3.0, seen)) + 4 * op07_html.marks(node))) < 1e-9
        cost = lambda x: sum(abs(g) for g, k in zip(gain, x) if (g > 0) != k) + sum(w for a, b, w in edges if x[a] != x[b])  # noqa: E731, B023
        best = min(cost([bool(m >> i & 1) for i in range(len(found))]) for m in range(1 << len(found)))
        kept = op07_html.content(page, model)
        x = op07_html.minimum_cut(gain, edges)
        assert abs(cost(x) - best) < 1e-9 and kept == [b[0] for b, k in zip(found, x) if k]


def test_html_through_spark(spark):
    page = "<nav><a href=x>Home</a></nav><article><p>Long enough to be read as a text.</p></article>"
    rows = [(1, "u", page, 7.0), (2, None, None, 7.0), (3, "w", "", 7.0), (3, "w", "", 7.0), (None, "x", page * 400, 7.0)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string, text double")
    got = op07_html.extracted(p, op07_html.fit(p)).collect()
    text = "Long enough to be read as a text."
    assert sorted(((r.page_id or 0), r.text) for r in got) == [(0, "\n\n".join([text] * 400)), (1, text), (2, ""), (3, ""), (3, "")]
    assert all(r.n_chars == len(r.text) for r in got) and op07_html.extracted(p.limit(0), op07_html.fit(p.limit(0))).count() == 0


def test_minimum_cut_is_least():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        gain = rng.normal(size=n).tolist()
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda x: sum(abs(g) for g, k in zip(gain, x) if (g > 0) != k) + sum(c for a, b, c in edges if x[a] != x[b])  # noqa: E731, B023
        least = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(op07_html.minimum_cut(gain, edges)) - least) < 1e-9


def test_hamming(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16))
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] * 16), (None, [1.0] * 16), (405, [1.0])]
    got = op09_hamming.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).toPandas()
    x = x.astype(np.float32).astype(float)
    right = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        right += len(set(np.argsort(-s)[:20]) & set(g.vec_id))
        assert np.allclose(sorted(g.score, reverse=True), g.sort_values("rank").score) and np.allclose(g.score, s[g.vec_id])
    assert right >= 0.9 * 20 * 20


def test_hamming_gives_isolated_vectors_and_small_tables_all_rows(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([c + 0.01 * rng.normal(size=(60, 16)) for c in rng.normal(size=(5, 16))] + [5 * rng.normal(size=(20, 16))])
    search = lambda v: op09_hamming.search(spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>"), F.col("vec_id") % 4 == 0).toPandas()
    for v in [x] + [rng.normal(size=(n, 16)) for n in (1, 5, 10, 15, 21)]:
        got, asked = search(v), range(0, len(v), 4)
        n = min(20, len(v) - 1)
        assert got.groupby("query_id")["rank"].apply(sorted).to_dict() == ({q: list(range(1, n + 1)) for q in asked} if n else {})
        assert (got.query_id != got.vec_id).all() and not got.duplicated(["query_id", "vec_id"]).any()
        assert np.allclose(got.score, [v[a] @ v[b] for a, b in zip(got.query_id, got.vec_id)])


def test_hamming_ties_and_outliers(spark):
    rng = np.random.default_rng(4)
    same = rng.normal(size=24)
    rows = [(i, same) for i in range(333)] + [(1000, -3 * same + rng.normal(size=24))] + [(2000 + i, rng.normal(size=24)) for i in range(5)]
    df = spark.createDataFrame([(i, [float(a) for a in v], "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = op09_hamming.search(df, F.col("vec_id").isin(20, 1000), shard=50, block=1).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 20] == [i for i in range(21) if i != 20]
    assert len([r for r in got if r.query_id == 1000]) == 20
    twice = df.union(df.filter("vec_id = 20"))
    assert [r.vec_id for r in op09_hamming.search(twice, F.col("vec_id") == 20).orderBy("rank").collect()] == [i for i in range(21) if i != 20]
    assert op09_hamming.search(df.limit(0), F.col("vec_id") == 20).count() == 0


def test_hamming_index_finds_every_code_within():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    codes[:40] = codes[0] ^ np.uint64(1) << rng.integers(0, 60, 40).astype(np.uint64)
    index = op09_hamming.MultiIndex(codes)
    for q in codes[:50]:
        for r in (0, 1, 3, 6, 9, 14, 25, 40, 64):
            assert index.within(q, r).tolist() == np.flatnonzero(np.bitwise_count(codes ^ q) <= r).tolist()


def test_jaccard_lists_are_long_enough():
    """Lists of both sets hold 1 + n // 16 common tokens whenever sets of these sizes link, for either size n."""
    ceil = lambda x, y: -(-x // y)
    for s in range(1, 700):
        for n in range(s, s * 4 // 3 + 1):
            common = ceil(75 * (s + n), 175)
            if common > s:
                continue
            lists = [op10_jaccard.prefix_length(k) + op10_jaccard.extra_length(k) for k in (s, n)]
            shared = min(lists[0] - (s - common), lists[1] - (n - common))
            assert shared >= 1 + op10_jaccard.extra_length(n) >= 1 + op10_jaccard.extra_length(s)
            assert op10_jaccard._need(s, n) == common


def test_jaccard_finds_what_no_bucket_tells(spark, monkeypatch):
    """Near copies that do not all link, in blocks of few rows, against a comparison of all pairs."""
    rng = np.random.default_rng(8)
    base = [f"b{k}" for k in range(90)]
    texts = []
    for i in range(160):
        t = list(base)
        for k in rng.choice(90, int(rng.integers(1, 5)), replace=False):
            t[k] = f"x{i}_{k}"
        texts.append(" ".join(t))
    texts += [" ".join(f"y{i}_{k}" for k in range(int(rng.integers(3, 40)))) + " " + " ".join(base[20:40]) for i in range(30)]
    monkeypatch.setattr(op10_jaccard.qualifying, "__defaults__", (16,))
    monkeypatch.setattr(op10_jaccard.partnered, "__defaults__", (16,))
    # the links that buckets tell are taken away, so the matrix has to find all
    links, calls = op10_jaccard._links, []
    monkeypatch.setattr(op10_jaccard, "_links", lambda found: calls.append(1) or (links(found).limit(0) if len(calls) == 1 else links(found)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(words, texts)]
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                x, y = sorted((label[a], label[b]))
                label = [x if v == y else v for v in label]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in op10_jaccard.linked(df).collect()} == dict(enumerate(label))


def test_mixing_takes_as_many_tied_rows_as_fit(spark):
    for ids in ([7] * 1000, [None] * 1000):
        rows = [(i, "w " * 10, "a") for i in ids] + [(k, "w " * 100, "b") for k in range(150)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
        got = op08_mixing.mixed_rows(df).collect()
        a = [r for r in got if r.source == "a"]
        assert len(got) == 1150 and abs(sum(r.m_size * r.m_taken_copies for r in a) - a[0].m_target) <= 10
        assert {r.m_taken_copies for r in a} == {0, 1}


CLASHES = "target double, spread double, source_size double, c_source string, m_u double, w_gone int, w_id int, w_text string, lang_pred string, n_lines int, n_removed int, m_size int, c0 int, c1 string, uid int, node int, g int"


@pytest.fixture(scope="module")
def clashing(docs):
    x = docs
    for k, c in enumerate(CLASHES.split(", ")):
        name, kind = c.split()
        x = x.withColumn(name, F.lit(k).cast(kind))
    return x


@pytest.mark.parametrize("stage", [stages.language_stage, stages.line_stage, stages.jaccard_stage, stages.mixing_stage, stages.packing_stage])
def test_stages_with_clashing_columns_nulls_and_nothing(spark, docs, clashing, stage):
    got = stage(spark, clashing, "").collect()
    assert got
    if stage is not stages.packing_stage:
        assert list(got[0].asDict()) == clashing.columns
        for k, c in enumerate(CLASHES.split(", ")):
            name, kind = c.split()
            assert {r[name] for r in got} == {str(k) if kind == "string" else k}
        assert {r.score for r in got} == {0.5}
        assert sorted((r.doc_id or 0, r.source or "") for r in stage(spark, docs, "").collect()) == sorted((r.doc_id or 0, r.source or "") for r in got)
    nulls = clashing.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in clashing.schema])
    expected = {stages.language_stage: 0, stages.line_stage: 15, stages.jaccard_stage: 15, stages.mixing_stage: 0, stages.packing_stage: 15}
    assert stage(spark, nulls, "").count() == expected[stage] and stage(spark, clashing.limit(0), "").count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline
    from public_tokenizers import path
    from tokenizers import Tokenizer

    lines = [f"{a} line of text {k} with some words in it" for k in range(40) for a in "ab"]
    rows = [(i, "\n".join(lines[(i * 7 + k) % 80] + f" of text {i}" for k in range(8)), "en" if i % 2 else "de", "web", 0, 0.5) for i in range(60)]
    rows += [(100 + i, rows[0][1] + "", "en", "copy", 0, 0.5) for i in range(5)] + [(200, None, None, None, None, None), (201, "", None, "x", 0, None), (202, "12 34", None, "x", 0, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(rows[:0], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    # each stage by hand: no text without letters, copies lose all lines, then the least id of linked ones, then as often as mixed
    docs_ = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    seen, kept = set(), []
    for r in sorted(docs_):
        ls = r[1].split("\n")
        gone = set()
        for k in range(len(ls) - 2):
            w = tuple(ls[k : k + 3])
            gone |= {k, k + 1, k + 2} if w in seen else set()
            seen.add(w)
        text = "\n".join(x for k, x in enumerate(ls) if k not in gone)
        if text.strip() or not gone:
            kept.append((r[0], text, r[3]))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, words(t)) for i, t, _ in kept)}
    label = {i: min(j for j in sets if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])) for i in sets}
    left = spark.createDataFrame([k for k in kept if label[k[0]] == k[0]], "doc_id long, text string, source string")
    mixed = {r.doc_id: (r.text, r.m_taken_copies) for r in op08_mixing.mixed_rows(left).collect()}
    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = {i: n * (len(tok.encode(t, add_special_tokens=False).ids) + 1) for i, (t, n) in mixed.items() if n}
    assert got.groupby("doc_id").length.sum().to_dict() == want
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_warc_ranges_do_not_depend_on_partitions(spark, tmp_path):
    ids = spark.range(0, 40_000, 1, 3).selectExpr("id * id AS page_id", "1 AS n").unionByName(spark.range(500).selectExpr("CAST(-9223372036854775808 + id AS bigint) AS page_id", "1 AS n"))
    a = op03_warc.ranges(ids, 40_500, 16)
    assert a == op03_warc.ranges(ids.repartition(7), 40_500, 16) and 10 <= len(a) <= 32 and a == sorted(a)
    one = spark.range(3000).selectExpr("5L AS page_id", "1 AS n")
    assert op03_warc.ranges(one, 3000, 8) == [5]
    rows = [(i * 37 % 5000, f"u{i}", "x" * (i % 300), "file", 9) for i in range(5000)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string, part string, digest int")
    files = []
    for k, q in enumerate((p, p.repartition(9, "url"))):
        manifest = op03_warc.write(q, f"file://{tmp_path}/{k}", roll=20_000, range_bytes=100_000)
        files.append(sorted((f.name, f.read_bytes()) for f in (tmp_path / str(k)).glob("*.gz")))
        assert op03_warc.read(manifest).count() == 5000 and not (tmp_path / str(k) / "temporary").exists()
    assert files[0] == files[1] and len(files[0]) > 5


def test_warc_name_that_is_taken(tmp_path):
    class Refuses:
        def __init__(self, store):
            self.store = store

        def move(self, a, b):
            raise OSError("exists")

        def __getattr__(self, name):
            return getattr(self.store, name)

    from pyarrow import fs

    (tmp_path / "t").write_bytes(b"abc")
    (tmp_path / "n").write_bytes(b"abc")
    op03_warc.settle(Refuses(fs.LocalFileSystem()), str(tmp_path / "t"), str(tmp_path / "n"), 3)
    assert not (tmp_path / "t").exists() and (tmp_path / "n").read_bytes() == b"abc"
    (tmp_path / "t").write_bytes(b"abcd")
    with pytest.raises(OSError):
        op03_warc.settle(Refuses(fs.LocalFileSystem()), str(tmp_path / "t"), str(tmp_path / "n"), 4)


def test_imatch_one_id_of_many_rows(spark):
    rows = [(5, f"word{i} common text here") for i in range(300)] + [(i, f"other{i} words") for i in range(3)] + [(None, "last one"), (None, "last two")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = op01_imatch.query_rows(d, op01_imatch.lexicon(d)).collect()
    by_hash = {t: h for t, h in d.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] if r[0] is not None else 1 << 70, by_hash[r[1]]))
    want = {(r[0], hashlib.sha256(op01_imatch.edited(r[1], s[1]).encode()).hexdigest()) for r, s in zip(order, order[1:] + order[:1])}
    assert {(r.doc_id, r.edited_sha256) for r in got} == want and len(got) == len(rows)


def test_licenses_of_very_many_notices(spark):
    import time

    took = []
    for n in (500, 4000):
        text = "Released under the MIT License. And so on and on. " * n
        s = time.time()
        got = op06_licenses.scanned(spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, None, "x")], "doc_id long, text string, license string").coalesce(1)).collect()
        took.append(time.time() - s)
        assert len(got) == 2 * n and {r.coverage for r in got} == {1.0}
    assert took[1] < 40 * took[0] + 5
    assert op06_licenses.scanned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licenses_places_apart_are_as_a_plain_scan():
    rng = np.random.default_rng(7)
    for _ in range(100):
        places = [(k, int(a), int(a + b)) for k, (a, b) in enumerate(zip(rng.integers(0, 60, 20), rng.integers(0, 9, 20)))]
        kept: list = []
        for x in places:
            if all(x[2] < y[1] or x[1] > y[2] for y in kept):
                kept.append(x)
        assert op06_licenses.apart(places) == kept


def test_very_long_texts(spark):
    words_ = " ".join(f"w{i % 5000}" for i in range(300_000))
    text = f"{words_} Released under the MIT License. {words_}"
    got = op06_licenses.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.license, text[r.start : r.end]) for r in got] == [("MIT-notice", "Released under the MIT License")]
    page = "<article>" + f"<p>{words_}.</p>" + "<p>One more sentence of the text, in a block of its own.</p>" * 5000 + "</article><ul>" + "<li><a href=x>Go</a>" * 20_000
    kept = op07_html.content(page)
    assert len(kept) == 5001 and kept[0] == words_ + "."
    # unmarked blocks of little evidence, which max-flow has to decide together
    assert len(op07_html.content("".join(f"<div>Odd bit {i}</div><p>A sentence of some words, number {i}.</p>" for i in range(4000)))) == 8000
    d = spark.createDataFrame([(1, text, 5, 6, 7), (2, text, 5, 6, 7)], "doc_id long, text string, length int, start int, p_uid int")
    packed = op04_packing.packed(d).toPandas()
    assert packed.groupby("doc_id").length.sum().tolist() == packed.groupby("doc_id").doc_tokens.first().tolist()


def test_scratch_needs_a_shared_folder():
    from loomstone.llm.scratch import shared_dir

    class Away:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(RuntimeError):
        shared_dir(Away)


def test_stages_keep_clean_documents(spark, docs):
    clean = docs.filter("doc_id IN (1, 7, 9)").withColumn("lang", F.lit("en"))
    assert stages.line_stage(spark, clean, "").count() == 3 and stages.jaccard_stage(spark, clean, "").count() == 3
    assert stages.jaccard_stage(spark, docs, "").columns == docs.columns
