"""Literal fixtures and invariants of page analytics."""

import duckdb
import pytest
from pyspark.sql import functions as F
from util import rows

from loomstone.functions import text as T
from loomstone.operators import controller, corpus, graph, mining, models, scoring, sectioning, tiling
from loomstone.plans import oracles, oracles_more, queries
from loomstone.sources import elements

D = "/root/testdata/sf0.001"
E = "unit string, seq int, tag string, x long, y long, w long, h long, depth int, text string"


def box(seq, tag, x, y, w, h, depth=3, text="t"):
    return {"seq": seq, "tag": tag, "x": x, "y": y, "w": w, "h": h, "depth": depth, "text": text}


def test_nested_is_pruned_siblings_stay():
    assert [e["tag"] for e in tiling.prune([box(0, "figure", 0, 0, 300, 220), box(1, "img", 0, 0, 300, 200, 4)])] == ["figure"]
    assert len(tiling.prune([box(0, "p", 0, 0, 200, 100), box(1, "p", 150, 0, 200, 100)])) == 2


def test_overlap_groups():
    assert len(tiling.overlap_groups([box(0, "p", 0, 0, 300, 100), box(1, "table", 200, 10, 150, 80)])) == 1
    assert len(tiling.overlap_groups([box(0, "p", 0, 0, 200, 100), box(1, "p", 199, 0, 200, 100)])) == 2
    assert len(tiling.overlap_groups([box(i, "p", 80 * i, 0, 100, 100) for i in range(3)])) == 1
    assert len(tiling.overlap_groups([box(0, "h2", 0, 0, 300, 100), box(1, "p", 0, 0, 300, 100)])) == 2


def test_overlapping_elements_make_one_tile():
    t = tiling.pack_page([box(0, "p", 0, 0, 300, 100), box(1, "table", 200, 10, 150, 80)])
    assert [(t[0][k] for k in ("x", "y", "width", "height"))] and (t[0]["x"], t[0]["y"], t[0]["width"], t[0]["height"]) == (0, 0, 350, 100)
    assert t[0]["source_ids"] == [0, 1] and t[0]["dom_tag"] == "p+table"


def test_heading_goes_with_what_follows_and_low_text_is_merged():
    t = tiling.pack_page([box(0, "h2", 0, 0, 100, 40), box(1, "p", 0, 50, 100, 30), box(2, "p", 0, 90, 100, 30), box(3, "p", 0, 130, 100, 60), box(4, "h2", 0, 200, 100, 40)])
    assert [x["dom_tag"] for x in t] == ["h2+p", "merged", "h2"]


def test_sections(spark):
    e = spark.createDataFrame([("u", 0, "p", 0, 0, 9, 50, 3, "intro"), ("u", 1, "h2", 0, 60, 9, 10, 3, "A"), ("u", 2, "p", 0, 100, 9, 50, 3, "x"), ("u", 3, "h2", 0, 160, 9, 10, 3, "B"), ("u", 4, "p", 0, 200, 9, 50, 3, "y")], E)
    assert [(r.sec_idx, r.title) for r in sectioning.heading_sections(e).orderBy("seq").collect()] == [(0, ""), (1, "A"), (1, "A"), (2, "B"), (2, "B")]
    long = spark.createDataFrame([("u", 0, "h2", 0, 0, 9, 10, 3, "L"), ("u", 1, "p", 0, 20, 9, 100, 3, "x"), ("u", 2, "p", 0, 130, 9, 100, 3, "y")], E)
    got = [r.section_title for r in sectioning.split_sections(long, 100).orderBy("seq").collect()]
    assert got == ["L", "L (suite 2)", "L (suite 3)"]


def test_section_hierarchy(spark):
    t = spark.createDataFrame([("u", i, tag, i) for i, tag in enumerate(["h1", "h2+p", "p", "h3+p", "p"])], "unit string, seq int, tag string, read_pos int")
    assert sorted((r.src, r.dst) for r in graph.section_edges(t).collect()) == [(0, 1), (1, 2), (1, 3), (3, 4)]


def test_similar_pairs_and_cap(spark):
    x = ["elephant heavy grey", "tomato red plant", "elephant grey trunk", "tomato plant salad"]
    t = spark.createDataFrame([("u", i, s) for i, s in enumerate(x)], "unit string, pos int, text string")
    assert {(r.i, r.j) for r in scoring.similar_pairs(t, 0.1).collect()} == {(0, 2), (1, 3)}
    assert scoring.similar_pairs(t, 0.99).count() == 0
    same = spark.createDataFrame([("u", i, f"common words here n{i}") for i in range(4)], "unit string, pos int, text string")
    got = graph.capped_neighbours(scoring.similar_pairs(same, 0.1), 1).collect()
    assert 1 <= len(got) <= 2 and len({k for r in got for k in (r.i, r.j)}) == 2 * len(got)


def test_controller():
    log, state = controller.run_controller([0.0, 0.9, 0.4, 0.01], {1: [0, 2], 2: [1, 3]}, controller.Config(budget=2, seed_top_k=1))
    assert [(i, a) for i, a, *_ in log] == [(1, "seed"), (1, "open"), (2, "activate"), (2, "open")]
    assert "active" not in state and state.count("opened") == 2
    log, _ = controller.run_controller([0.0, 0.01], {}, controller.Config(budget=2, seed_top_k=2))
    assert [a for _, a, *_ in log] == ["seed", "seed", "prune", "prune"]


def test_qa_parsing(spark):
    x = ['{"question": "Q", "answer": "A"}', '```json\n{"question": "Q", "answer": "A"}\n```', "SKIP", "not json at all"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(x)], "i int, s string")
    assert [r.q for r in df.select("i", T.parsed_qa(df.s)["question"].alias("q")).orderBy("i").collect()] == ["Q", "Q", None, None]


def test_text_functions(spark):
    r = spark.createDataFrame([("Kiss and Tell (1945 film)", "https://en.wikipedia.org/wiki/Ed_Wood#x")], "t string, u string").select(T.title_slug(F.col("t")).alias("s"), T.wiki_slug(F.col("u")).alias("w")).first()
    assert r.s == "Kiss_and_Tell_(1945_film)" and r.w == "Ed_Wood"
    with pytest.raises(ValueError):
        T.scaled_side(None, 1)


def test_mining_leak_and_judge(spark):
    tiles = spark.createDataFrame([("u", 0, "Population: the town had 4200 people"), ("u", 1, "population 4200."), ("u", 2, "town people map"), ("u", 3, "References of the town")], "unit string, pos int, text string")
    qa = spark.createDataFrame([("u", "How many people in the town", "4200", 0)], "unit string, question string, answer string, positive int")
    s = scoring.question_scores(tiles, qa.selectExpr("unit", "question AS text"))
    assert {r.pos for r in mining.hard_negatives(s, tiles, qa).collect()} == {2, 3}
    judged = spark.createDataFrame([("u", 3, True)], "unit string, pos int, relevant boolean")
    assert [r.pos for r in mining.hard_negatives(s, tiles, qa, judged=judged).collect()] == [2]


SQL = oracles.SQL | oracles_more.MORE


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def test_each_query_has_sql():
    assert set(SQL) == set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, D).toPandas()) == rows(duck.execute(SQL[name]).fetchdf())


def test_graph_invariants(spark):
    t = queries.placed(spark, D)
    n = {r["unit"]: r["count"] for r in t.groupBy("unit").count().collect()}
    e = graph.edges(t).groupBy("unit", "relation").count().collect()
    assert all(r["count"] == n[r["unit"]] - (r["relation"] == "reading_order") for r in e if r["relation"] in ("contains", "reading_order"))


def test_idempotent_ingest(spark, tmp_path):
    from loomstone.sources.stores import append_attempt, append_unseen, attempted_ids, read_jsonl, read_snapshot, save_jsonl

    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v int")
    assert append_unseen(df, str(tmp_path / "s"), ["k"]) == 2 and append_unseen(df, str(tmp_path / "s"), ["k"]) == 0
    assert read_jsonl(spark, str(tmp_path / "none"), "k string").count() == 0
    save_jsonl(df, str(tmp_path / "j"))
    save_jsonl(df.limit(1), str(tmp_path / "j"))
    assert read_jsonl(spark, str(tmp_path / "j"), "k string, v int", ("k",)).count() == 1
    ids = spark.createDataFrame([("x",), ("y",)], "id string")
    assert attempted_ids(spark, str(tmp_path / "m")).count() == 0
    append_attempt(ids, ids.limit(1), str(tmp_path / "m"))
    assert {r.id for r in attempted_ids(spark, str(tmp_path / "m")).collect()} == {"x", "y"}
    (tmp_path / "snap.json").write_text('{"u": {"revid": 3, "pinned_url": "u?oldid=3", "pinned_at": "2020-01-01T00:00:00Z"}}')
    assert [tuple(r) for r in read_snapshot(spark, str(tmp_path / "snap.json")).collect()] == [("u", 3, "u?oldid=3", "2020-01-01T00:00:00Z")]
    assert read_snapshot(spark, str(tmp_path / "none.json")).count() == 0


def test_streamed_ingest(spark, tmp_path):
    from loomstone.streaming.ingest import ingest

    rows_ = lambda n: spark.createDataFrame([(f"k{i % 5}", i) for i in range(n)], "k string, v int")
    for n in (7, 9):  # the second run brings the same keys again, and no new one
        rows_(n).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema("k string, v int").json(str(tmp_path / "in"))
        ingest(stream, str(tmp_path / "out"), ["k"], str(tmp_path / "check")).awaitTermination(120)
    assert sorted(r.k for r in spark.read.json(str(tmp_path / "out")).collect()) == [f"k{i}" for i in range(5)]


def test_images_are_written_once(spark, tmp_path):
    from loomstone.sources.stores import save_tile_images

    df = spark.createDataFrame([("s", "tile_0000", b"one"), ("s", "tile_0001", None)], "page_slug string, tile_id string, image binary")
    folder = f"file://{tmp_path}/images"
    assert {r.id: r.image_path for r in save_tile_images(df, folder).collect()} == {"s__tile_0000": f"{folder}/s__tile_0000.png", "s__tile_0001": f"{folder}/s__tile_0001.png"}
    save_tile_images(df.withColumn("image", F.lit(b"two")), folder).collect()
    assert [(f.name, f.read_bytes()) for f in sorted((tmp_path / "images").iterdir())] == [("s__tile_0000.png", b"one"), ("s__tile_0001.png", b"two")]


def test_slices_and_merged_tiles():
    t = tiling.pack_page([box(0, "p", 10, 5, 100, 25)])
    assert [(x["dom_tag"], x["x"], x["y"], x["width"], x["height"]) for x in t] == [("merged", 10, 5, 100, 25)]
    t = tiling.pack_page([box(0, "pre", -5, 0, 100, 1000)], tiling.Config(max_tile_height=300))
    assert [(x["x"], x["y"], x["width"], x["height"]) for x in t] == [(0, 0, 95, 250), (0, 250, 95, 250), (0, 500, 95, 250), (0, 750, 95, 250)]
    t = tiling.pack_page([box(0, "table", 0.5, 0.6, 90.9, 1000.7)], tiling.Config(max_tile_height=300), (80, 900))
    assert [(x["y"], x["height"], x["width"]) for x in t] == [(0, 250, 80), (250, 250, 80), (500, 250, 80), (751, 149, 80)]
    links = [{"href": "h", "anchor_text": "a"}]
    t = tiling.pack_page([box(0, "h2", 0, 0, 9, 20) | {"links": []}, box(1, "p", 0, 30, 9, 20) | {"links": links}])
    assert t[0]["links"] == links and t[0]["source_ids"] == [0, 1]


def test_prune_is_as_a_plain_scan():
    import random

    r = random.Random(4)
    for _ in range(200):
        items = [box(i, "p", r.randint(0, 30), r.randint(0, 30), r.randint(1, 20), r.randint(1, 20), r.randint(1, 4)) for i in range(r.randint(1, 25))]
        kept = []
        for e in sorted(items, key=lambda e: (e["depth"], e["seq"])):
            if not any(e["x"] >= k["x"] - 1 and e["y"] >= k["y"] - 1 and e["x"] + e["w"] <= k["x"] + k["w"] + 1 and e["y"] + e["h"] <= k["y"] + k["h"] + 1 for k in kept):
                kept.append(e)
        assert tiling.prune(items) == sorted(kept, key=lambda e: e["seq"])


def test_parsed_elements():
    html = """<html><head><title>no</title></head><body><nav><p>no</p></nav><div id="siteNotice"><p>no</p></div><h1>T &amp; u</h1><p>One <a href="/x#y">link</a> <a href="#z">z</a>
    <p>Two<div class="a navbox b"><ul><li>no</li></ul></div><table><tr><td>A<td>B<p>in</p></table><figure><img src=i></figure><ul><li><a href="/no">L</a><li>M</ul>"""
    got = elements.page_elements(html, "https://s.org/d/p")
    assert [(t, x) for t, _, x, _ in got] == [("h1", "T & u"), ("p", "One link z"), ("p", "Two"), ("table", "ABin"), ("p", "in"), ("figure", ""), ("img", ""), ("ul", "LM")]
    assert got[1][3] == [{"href": "https://s.org/x#y", "anchor_text": "link"}] and all(not x[3] for x in got if x[0] != "p")
    depth = {t: d for t, d, _, _ in got}
    assert depth["img"] == depth["figure"] + 1


def test_page_graph_with_sections(spark):
    e = spark.createDataFrame([("u", 0, "h1", 0, 0, 900, 50, 3, "Top"), ("u", 1, "p", 0, 60, 900, 40, 3, "intro"), ("u", 2, "h2", 0, 5000, 900, 50, 3, "History"), ("u", 3, "p", 0, 5100, 900, 19850, 3, "long")], E)
    n, edges = corpus.page_graph(e)
    pages = {r.node_id for r in n.filter("type = 'page'").collect()}
    assert pages == {"u__sec0::page", "u__sec1::page"}
    assert [(r.src, r.dst) for r in edges.filter("relation = 'continues'").collect()] == [("u__sec0::page", "u__sec1::page")]
    assert all(r.src.split("::")[0] == r.dst.split("::")[0] for r in edges.filter("relation != 'continues'").collect())
    n, _ = corpus.page_graph(e.filter("seq < 2"))
    assert {r.node_id for r in n.collect()} == {"page", "tile_0000"}


def test_answer(spark):
    pages = spark.createDataFrame([(1, "https://s.org/a", "<h1>Animals</h1><p>Elephants weigh 6000 kilograms and are heavy. <a href='/e'>more</a></p><p>Tomatoes are red plants that people eat.</p>"), (2, "https://s.org/b", None)], "page_id long, url string, html string")
    said = []
    ask = lambda r: said.append(1) or r.select("key", F.when(F.contains("prompt", F.lit("Question:")), F.when(F.contains("prompt", F.lit("6000")), "6000 kg").otherwise("?")).alias("reply")).filter("reply IS NOT NULL")
    a = models.answer(spark, pages, "How much do elephants weigh?", ask)
    assert {r.unit: r.answer for r in a.answer.collect()} == {"p1": "6000 kg", "p2": models.NOTHING_FOUND}
    assert [r.used_as_evidence for r in a.links.collect()] == [True] and a.log.filter("action = 'open'").count() >= 1
    with pytest.raises(ValueError):
        models.answer(spark, pages, "  ", ask)
    with pytest.raises(ValueError):
        models.provider("other", table=ask)


def test_cached_questions_are_asked_once(spark):
    r = spark.createDataFrame([("a",), ("a",), ("b",)], "prompt string")
    calls = []
    ask = lambda x: calls.append(x.count()) or x.select("key", F.upper("prompt").alias("reply"))
    out, new = models.asked(r, ask)
    assert sorted(x.reply for x in out.collect()) == ["A", "A", "B"] and calls == [2]
    models.asked(r.union(spark.createDataFrame([("c",)], "prompt string")), ask, new)
    assert calls == [2, 1]


def test_lazy_names():
    import loomstone

    assert loomstone.pack_page is tiling.pack_page and all(getattr(loomstone, n) is not None for n in loomstone.__all__)
    with pytest.raises(AttributeError):
        loomstone.nothing_of_the_kind


def test_links_in_any_form(spark):
    html = """<a href="/a">One</a> <a class="x" href='b?x=1&amp;y=2'><b>Two</b> &amp; more</a> <A HREF=../c>Three</A><a name="n">none</a>
    <a href="mailto:m@n.org">m</a><a href="javascript:f()">j</a><a href="#top">t</a><a href="">e</a><!-- <a href="/no">no</a> --><a href="//other.org/d" title="a > b">Four
    lines</a><script>var s = '<a href="/no">no</a>'</script><a href="http://[bad">bad</a><a href="HTTPS://else.org/">Five"""
    pages = spark.createDataFrame([(1, "https://site.org/p/q/page", html), (2, "https://site.org/p/", '<base href="/r/"><a href="s">S</a>'), (3, "https://site.org/", None)], "page_id long, url string, html string")
    got = [tuple(r) for r in elements.html_links(pages).orderBy("page_id", "seq").collect()]
    assert got == [
        (1, 0, "https://site.org/a", "One"), (1, 1, "https://site.org/p/q/b?x=1&y=2", "Two & more"), (1, 2, "https://site.org/p/c", "Three"),
        (1, 7, "https://other.org/d", "Four lines"), (1, 9, "https://else.org/", "Five"), (2, 0, "https://site.org/r/s", "S"),
    ]


def on_pages(spark, tmp_path, name, pages):
    """(rows of a query, rows of its SQL) over other pages."""
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    return rows(queries.QUERIES[name](spark, str(tmp_path)).toPandas()), rows(c.execute(SQL[name]).fetchdf())


def test_snapshot_of_repeated_addresses(spark, tmp_path):
    from loomstone.sources.stores import read_snapshot

    pages = spark.createDataFrame([(1, "https://a.org/x", ""), (2, "https://a.org/x", ""), (3, "", ""), (4, None, "")], "page_id long, url string, html string")
    got, want = on_pages(spark, tmp_path, "s11_snapshot", pages)
    assert got == want and len(got) == 4
    (tmp_path / "snap.json").write_text('{\n "u": {"revid": 3,\n "pinned_url": "p", "pinned_at": "t"},\n "v": {"revid": 4, "pinned_url": "q", "pinned_at": "t"}\n}')
    assert sorted(tuple(r) for r in read_snapshot(spark, str(tmp_path / "snap.json")).collect()) == [("u", 3, "p", "t"), ("v", 4, "q", "t")]


def test_pins_of_repeated_addresses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://a.org/x", ""), (2, "https://a.org/x", ""), (3, "http://b.org", ""), (4, None, "")], "page_id long, url string, html string")
    got, want = on_pages(spark, tmp_path, "k7_pin_if_absent", pages)
    assert got == want and len(got) == 4


def test_references_without_semicolon(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://a.org/x", "<h1>token = &quot</h1><p>a &lt b &lt; &ltc &amp d &amp; &amp;lt; &quot;</p><p>x &#x27</p>"), (2, "https://a.org/y", None)], "page_id long, url string, html string")
    got, want = on_pages(spark, tmp_path, "s1_parsed_elements", pages)
    assert got == want and len(got) == 3
    assert [r.text for r in elements.parsed_elements(pages).orderBy("seq").collect()][0] == 'token = "'


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_row_a_term(spark, monkeypatch):
    t = spark.createDataFrame([(f"u{i // 3}", i % 3, s) for i, s in enumerate(["red fox runs", "red dog", "fox dog runs", "red fox", "", "fox red fox"])], "unit string, pos int, text string")
    q = spark.createDataFrame([("u0", "fox"), ("u1", "red fox")], "unit string, text string")
    for x in (scoring.question_scores(t, q), scoring.count_cosine(t, q), scoring.similar_pairs(t, 0.1)):
        assert "explode" not in plan(x) and "Join" not in plan(x)
    got = rows(scoring.similar_pairs(t, 0.1).toPandas())
    monkeypatch.setattr(scoring, "MEETINGS", 1)
    assert rows(scoring.similar_pairs(t, 0.1).toPandas()) == got and len(got) == 4


def test_units_come_whole():
    import pyarrow as pa

    from loomstone.operators.whole import _whole

    b = [pa.record_batch({"unit": pa.array(u, "string"), "pos": list(range(len(u)))}) for u in (["a", "a", "b"], ["b"], ["b", "c", None], [None])]
    got = [x["unit"].to_pylist() for x in _whole(iter(b), 1)]
    assert sum(got, []) == ["a", "a", "b", "b", "b", "c", None, None] and len(got) == 3


def test_no_python_group_a_unit(spark):
    e = spark.createDataFrame([(f"u{k}", i, "p", 0, 40 * i, 90, 30, 3, "t") for k in range(3) for i in range(4)], E)
    s = e.selectExpr("unit", "seq AS pos", "cast(0.1 * seq AS double) AS score")
    p = e.selectExpr("unit", "seq AS i", "seq + 1 AS j", "0.5D AS similarity")
    for x, n in ((tiling.build_tiles(e), 6), (tiling.pruned(e), 12), (controller.controller_log(s), 18), (controller.controller_log(s, controller.reading_neighbours(s)), 18), (graph.capped_neighbours(p), 12)):
        assert "FlatMap" not in plan(x) and x.count() == n, (x.count(), n)
    assert rows(controller.controller_log(s).toPandas()) == rows(controller.controller_log(s, controller.reading_neighbours(s)).toPandas())


def test_ablation_joins_no_texts(spark):
    p = plan(queries.QUERIES["g21_ablation"](spark, D))
    assert p.count("SortMergeJoin") + p.count("BroadcastHashJoin") <= 1  # the bands of a page and their text


def test_questions_stand_beside_their_tiles(spark):
    """Rows stay as they are dealt and sorted: no row a question, so each text is sorted once."""
    for name in ("g14_static_top_k", "g17_hard_negatives", "g18_negatives_unfiltered", "j21_coverage", "a13_dataset_volumes", "p14_resolvable", "w13_positive_indices"):
        assert "Generate explode(CASE" not in plan(queries.QUERIES[name](spark, D)), name
    asked = spark.createDataFrame([("u", 0, "red fox", "fox runs"), ("u", 1, "fox runs home", "fox runs"), ("v", 0, "dog", None), ("w", 0, "", ""), ("x", 0, "cat", "cat nap"), ("x", 1, "the cat", "cat nap")], "unit string, pos int, text string, question string").withColumn("positive", F.when(F.col("unit") == "u", 1).otherwise(0))
    q = asked.filter("pos = positive").selectExpr("unit", "question AS text")
    for score in (scoring.question_scores, scoring.count_cosine, lambda *t: scoring.question_scores(*t, fit_question=True)):
        got = rows(score(scoring.with_questions(asked)).toPandas())
        assert got == rows(score(asked, q).toPandas()) and len(got) == 6


def test_evidence_brings_its_texts_along(spark):
    p = plan(queries.QUERIES["g24_evidence"](spark, D))
    assert "Join" not in p and p.count("FileScan") == 2
    s = spark.createDataFrame([("u", 2, 0.9, "c" * 300), ("u", 0, 0.9, "a"), ("u", 1, 0.1, "b"), ("v", 0, 0.0, "d")], "unit string, pos int, score double, text string")
    top = controller.static_top_k(s, 2)
    want = {"u": "a\n\n" + "c" * 200, "v": "d"}
    assert {r.unit: r.evidence for r in controller.evidence(top).collect()} == want
    assert {r.unit: r.evidence for r in controller.evidence(top.drop("text"), s).collect()} == want


def test_states_are_counted_in_one_pass(spark):
    p = plan(queries.QUERIES["p17_state_counts"](spark, D))
    assert "Join" not in p and p.count("FileScan") == 2
    s = spark.createDataFrame([("u", "opened"), ("u", "opened"), ("u", "pruned"), ("v", "inactive"), (None, "active")], "unit string, state string")
    got = {(r.unit, r.state): r.n for r in controller.state_counts(s).collect()}
    assert len(got) == 12 and {k: n for k, n in got.items() if n} == {("u", "opened"): 2, ("u", "pruned"): 1, ("v", "inactive"): 1, (None, "active"): 1}


def test_readings_move_whole_texts_to_the_model_only(spark):
    p = plan(queries.QUERIES["u3_model_evidence"](spark, D))
    assert p.count("Join [") == 1  # tiles and their replies
    t = spark.createDataFrame([("u", 1, "long " * 60), ("u", 0, "short"), ("v", 0, "long " * 60)], "unit string, pos int, text string")
    ask = lambda r: r.filter(F.length("prompt") > 100).select("key", F.concat(F.lit("read "), F.length("prompt").cast("string")).alias("reply"))
    want = {"u": "short\n\nread 300", "v": "read 300"}
    assert {r.unit: r.evidence for r in models.read_evidence(t, None, ask).collect()} == want
    assert {r.unit: r.evidence for r in models.read_evidence(t.drop("text"), t, ask).collect()} == want


def test_ranks_of_positives_read_the_tiles_once(spark):
    p = plan(queries.QUERIES["w8_rank_metrics"](spark, D))
    assert "Join" not in p and p.count("FileScan") == 2
    a = spark.createDataFrame([("u", 0, "red fox", "red", 0), ("u", 1, "dog", "red", 0), ("v", 0, "red", "dog runs", 1), ("v", 1, "dog", "dog runs", 1)], "unit string, pos int, text string, question string, positive int")
    assert sorted((r.unit, r.pos, r["rank"]) for r in queries.positive_ranks(a).collect()) == [("u", 0, 0), ("v", 1, 0)]
