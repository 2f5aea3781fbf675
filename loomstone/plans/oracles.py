"""SQL for the queries, in the dialect of an embedded engine, over the same tables."""

from __future__ import annotations

from loomstone.config import CONFIG, NOISE_TAGS, STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOKEN = r"'[\p{L}\p{N}_]+'"

ELEMENTS = """
lines AS (
  SELECT 'd' || doc_id AS unit, 0 AS part, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS text, 'p' AS tag FROM documents
  UNION ALL
  SELECT 'c' || conv_id, turn, unnest(range(0, len(string_split(text, chr(10))))), unnest(string_split(text, chr(10))), CASE role WHEN 'system' THEN 'h1' WHEN 'user' THEN 'h2' ELSE 'p' END FROM conversations),
nums AS (SELECT unit, (row_number() OVER (PARTITION BY unit ORDER BY part, i) - 1)::INT AS seq, tag, text, length(text)::BIGINT AS n FROM lines WHERE text <> ''),
flo AS (SELECT *, (tag = 'p' AND seq % 5 = 4) AS floats, CASE WHEN tag = 'p' AND seq % 5 = 4 THEN 40 ELSE 120 END AS cap FROM nums),
dims AS (SELECT *, (CASE WHEN tag = 'p' THEN 24 ELSE 40 END * greatest(1, (n + cap - 1) // cap))::BIGINT AS h, greatest(40, 8 * least(n, cap))::BIGINT AS w FROM flo),
flows AS (SELECT *, coalesce(sum(CASE WHEN floats THEN 0 ELSE h + 8 END) OVER (PARTITION BY unit ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS flow FROM dims),
e AS (SELECT unit, seq, tag, (CASE WHEN NOT floats THEN 0 WHEN seq % 10 = 9 THEN 800 ELSE 1000 END)::BIGINT AS x,
        CASE WHEN floats THEN lag(flow) OVER (PARTITION BY unit ORDER BY seq) ELSE flow END AS y, w, h, CASE WHEN floats THEN 4 ELSE 3 END AS depth, text FROM flows)
"""

QUESTIONS = """
mid AS (SELECT unit, seq AS positive, list_filter(string_split_regex(text, '[ \t]+'), lambda q: q <> '') AS ws FROM (SELECT *, count(*) OVER (PARTITION BY unit) AS cnt FROM e) WHERE seq = cnt // 2),
q AS (SELECT unit, positive, array_to_string(ws[1:8], ' ') AS question, coalesce(ws[len(ws)], '') AS answer FROM mid)
"""


def _terms(name: str, source: str, keys: str, stop: bool = True) -> str:
    keep = f"WHERE length(term) >= 2 AND term NOT IN ({_STOP})" if stop else ""
    return f"{name} AS (SELECT {keys}, term, count(*) AS tf FROM (SELECT {keys}, unnest(regexp_extract_all(lower(text), {_TOKEN})) AS term FROM {source}) {keep} GROUP BY {keys}, term)"


def _scores(fit: bool) -> str:
    seen = "(SELECT unit, term, tf FROM tt UNION ALL SELECT unit, term, tf FROM qt)" if fit else "tt"
    n = "n + 1" if fit else "n"
    return f"""
qq AS (SELECT unit, question AS text FROM q), {_terms('tt', 'e', 'unit, seq')}, {_terms('qt', 'qq', 'unit')},
sz AS (SELECT unit, count(*) AS n FROM e GROUP BY unit),
df AS (SELECT unit, term, count(*) AS df FROM {seen} GROUP BY unit, term),
idf AS (SELECT df.unit, term, ln((1 + {n}) / (1 + df)::DOUBLE) + 1 AS idf FROM df JOIN sz ON df.unit = sz.unit),
tr AS (SELECT tt.unit, seq, tt.term, tf * idf AS w FROM tt JOIN idf ON tt.unit = idf.unit AND tt.term = idf.term),
qr AS (SELECT qt.unit, qt.term, tf * idf AS w FROM qt JOIN idf ON qt.unit = idf.unit AND qt.term = idf.term),
tn AS (SELECT unit, seq, sqrt(sum(w * w)) AS nn FROM tr GROUP BY unit, seq), qn AS (SELECT unit, sqrt(sum(w * w)) AS nn FROM qr GROUP BY unit),
dots AS (SELECT tr.unit, tr.seq, sum(tr.w * qr.w / tn.nn / qn.nn) AS s FROM tr JOIN qr ON tr.unit = qr.unit AND tr.term = qr.term JOIN tn ON tn.unit = tr.unit AND tn.seq = tr.seq JOIN qn ON qn.unit = tr.unit GROUP BY tr.unit, tr.seq),
sc AS (SELECT e.unit, e.seq AS pos, round(coalesce(s, 0), 6) AS score FROM e JOIN q ON e.unit = q.unit LEFT JOIN dots ON dots.unit = e.unit AND dots.seq = e.seq)
"""


HEADINGS = """
hs AS (SELECT *, sum(CASE WHEN tag IN ('h1', 'h2') THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY y, seq) AS k, first_value(tag IN ('h1', 'h2')) OVER (PARTITION BY unit ORDER BY y, seq) AS f,
        last_value(CASE WHEN tag IN ('h1', 'h2') THEN text END IGNORE NULLS) OVER (PARTITION BY unit ORDER BY y, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM e),
sec AS (SELECT unit, seq, tag, x, y, w, h, text, (k - CASE WHEN f THEN 1 ELSE 0 END)::INT AS sec_idx, coalesce(t, '') AS title FROM hs)
"""

ROWS = f"""
ord AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY y, seq) AS o FROM e),
walk AS (SELECT unit, o, seq, y::DOUBLE AS top, 0 AS row_idx FROM ord WHERE o = 1
  UNION ALL SELECT ord.unit, ord.o, ord.seq, CASE WHEN ord.y - walk.top > {CONFIG.row_tolerance} THEN ord.y ELSE walk.top END, walk.row_idx + CASE WHEN ord.y - walk.top > {CONFIG.row_tolerance} THEN 1 ELSE 0 END
  FROM walk JOIN ord ON ord.unit = walk.unit AND ord.o = walk.o + 1),
cols AS (SELECT e.*, row_idx, row_number() OVER (PARTITION BY e.unit, row_idx ORDER BY e.x, e.y, e.seq) - 1 AS col_idx FROM e JOIN walk ON e.unit = walk.unit AND e.seq = walk.seq),
pl AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY row_idx, col_idx) - 1 AS read_pos FROM cols)
"""


def _e(*more: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join((ELEMENTS, *more))


_LINKS = r"""
al AS (SELECT page_id, url, unnest(range(0, len(a))) AS seq, unnest(a) AS a FROM (SELECT page_id, url, regexp_extract_all(html, '(?s)<a href="[^"]*">[^<]*</a>') AS a FROM pages)),
hl AS (SELECT page_id, seq, url, regexp_extract(a, 'href="([^"]*)"', 1) AS href0, regexp_extract(a, '>([^<]*)<', 1) AS t FROM al),
links AS (SELECT page_id, seq::INT AS seq, CASE WHEN href0 LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/]+)', 1) || href0 ELSE href0 END AS href, left(trim(t), 100) AS anchor_text FROM hl WHERE href0 <> '' AND href0 NOT LIKE '#%')
"""

_SLUG = r"""
regexp_replace(CASE WHEN lastseg = '' THEN host ELSE lastseg END, '[^A-Za-z0-9_.-]', '_', 'g')"""
_SLUGS = rf"""
rest AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^[a-zA-Z]+://', ''), '[?#].*$', '') AS r FROM pages),
segs AS (SELECT page_id, url, split_part(r, '/', 1) AS host, split_part(regexp_replace(regexp_replace(r, '^[^/]*', ''), '/+$', ''), '/', -1) AS lastseg FROM rest),
sl AS (SELECT page_id, url, {_SLUG} AS slug FROM segs)
"""


def _html() -> str:
    h = r"regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in NOISE_TAGS:
        h = rf"regexp_replace({h}, '(?si)<{tag}[ >].*?</{tag}>', '', 'g')"
    h = rf"regexp_replace({h}, '(?si)<head[ >].*?</head>', '', 'g')"
    h = rf"regexp_replace({h}, '(?i)<(h1|h2|h3|h4|p|table|figure|ul|ol|blockquote|pre)( [^>]*)?>', chr(1) || '\1' || chr(2), 'g')"
    return rf"""
WITH p AS (SELECT page_id, string_split({h}, chr(1))[2:] AS ps FROM pages),
r AS (SELECT page_id, unnest(range(0, len(ps)))::INT AS seq, unnest(ps) AS raw FROM p)
SELECT page_id, seq, lower(split_part(raw, chr(2), 1)) AS tag, left(trim(regexp_replace(regexp_replace(split_part(raw, chr(2), -1), '<[^>]*>', '', 'g'), '[ \t\n\r]+', ' ', 'g')), 200) AS text_preview FROM r"""


_TOP = "tk AS (SELECT unit, pos, score, row_number() OVER (PARTITION BY unit ORDER BY score DESC, pos) AS rk FROM sc)"
_NEG = """neg AS (SELECT unit, pos, nth FROM (SELECT sc.unit, sc.pos, (row_number() OVER (PARTITION BY sc.unit ORDER BY score DESC, sc.pos) - 1)::INT AS nth FROM sc JOIN e ON e.unit = sc.unit AND e.seq = sc.pos JOIN q ON q.unit = sc.unit
 {judge} WHERE sc.pos <> q.positive {leak}) WHERE nth < 2)"""
_LEAK = "AND NOT (lower(answer) <> '' AND contains(lower(text), lower(answer)))"

SQL = {
    "s1_html_elements": _html(),
    "s1_html_links": f"WITH {_LINKS} SELECT page_id, seq, href, anchor_text FROM links",
    "s1_flow_layout": _e() + "SELECT unit, seq, tag, x, y, w, h, depth, left(text, 200) AS text_preview FROM e",
    "s5_last_image_path": "SELECT role AS slug, 'tile_' || turn AS tile_id, 'p' || max(conv_id) AS image_path FROM conversations GROUP BY 1, 2",
    "s7_existing_keys": "SELECT DISTINCT user_id, event_type FROM events",
    "s9_attempted_ids": "SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1",
    "s12_candidate_urls": "SELECT url, min(page_id) AS first_seen FROM pages WHERE NOT contains(split_part(url, '/', -1), '__sec') GROUP BY url",
    "k2_append_unseen": "SELECT DISTINCT user_id, event_type FROM events WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_type = 'view')",
    "k6_upsert": "SELECT coalesce(n.doc_id, l.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'old' ELSE 'new' END AS origin, CASE WHEN n.doc_id IS NULL THEN quality ELSE v END::INT AS v FROM labels l FULL JOIN (SELECT doc_id, length(lang) AS v FROM documents WHERE lang = 'en') n ON l.doc_id = n.doc_id",
    "k7_pin_if_absent": "SELECT page_id, CASE WHEN contains(url, 'https') THEN url || '?oldid=1' ELSE url END AS read_url FROM pages",
    "k9_graph_xml": _e(ROWS, recursive=True) + """SELECT unit, '<?xml version="1.0" ?>' || chr(10) || '<page url="" title="' || unit || '">' || chr(10) || string_agg('  <element id="tile_' || CASE WHEN seq < 10000 THEN lpad(seq::VARCHAR, 4, '0') ELSE seq::VARCHAR END || '" tag="' || tag || '" state="inactive">' || replace(replace(replace(replace(left(text, 200), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</element>', chr(10) ORDER BY read_pos) || chr(10) || '</page>' || chr(10) AS xml FROM pl GROUP BY unit""",
    "p3_contained_pairs": _e() + "SELECT a.unit, a.seq AS i, b.seq AS j FROM e a JOIN e b ON a.unit = b.unit AND a.seq <> b.seq WHERE a.x >= b.x - 1 AND a.y >= b.y - 1 AND a.x + a.w <= b.x + b.w + 1 AND a.y + a.h <= b.y + b.h + 1",
    "p8_page_height": _e() + "SELECT unit, max(y + h) - min(y) AS height, max(y + h) - min(y) > 2000 AS oversized FROM e GROUP BY unit",
    "p11_contains_answer": _e(QUESTIONS) + "SELECT e.unit, count(*) AS n FROM e JOIN q ON e.unit = q.unit WHERE trim(answer) <> '' AND contains(lower(text), lower(trim(answer))) GROUP BY e.unit",
    "p16_preview": _e() + "SELECT unit, left(string_agg(left(text, 200), ' ' ORDER BY seq), 200) AS text_preview FROM e GROUP BY unit",
    "p17_state_counts": _e(QUESTIONS, _scores(False), _TOP) + "SELECT unit, s.state, CASE s.state WHEN 'opened' THEN sum((rk <= 5)::INT) WHEN 'inactive' THEN sum((rk > 5)::INT) ELSE 0 END::BIGINT AS n FROM tk, (VALUES ('inactive'), ('active'), ('opened'), ('pruned')) s(state) GROUP BY unit, s.state",
    "t1_tokens": f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), {_TOKEN})) AS token FROM documents) GROUP BY token",
    "t11_slugs": f"WITH {_SLUGS} SELECT page_id, slug, split_part(url, '/', -1) AS raw_slug, split_part(split_part(url, '/', -1) || '__sec3', '__sec', 1) AS root FROM sl",
    "t17_cache_key": "SELECT conv_id, turn, sha256(encode(role) || '\\x00'::BLOB || encode(text) || '\\x00'::BLOB) AS key FROM conversations",
    "t18_scaled_size": _e() + "SELECT unit, seq, greatest(1, round_even(w * 0.5, 0)::INT) AS w, greatest(1, round_even(h * 0.35::DOUBLE, 0)::INT) AS h FROM e",
    "t3_count_cosine": _e(QUESTIONS, "qq AS (SELECT unit, question AS text FROM q)", _terms("tt", "e", "unit, seq", False), _terms("qt", "qq", "unit", False), "tn AS (SELECT unit, seq, sum(tf * tf) AS v FROM tt GROUP BY unit, seq)", "qn AS (SELECT unit, sum(tf * tf) AS v FROM qt GROUP BY unit)", "d AS (SELECT tt.unit, seq, sum(tt.tf * qt.tf) AS dot FROM tt JOIN qt ON tt.unit = qt.unit AND tt.term = qt.term GROUP BY tt.unit, seq)") + "SELECT e.unit, e.seq AS pos, round(coalesce(dot / sqrt((tn.v * qn.v)::DOUBLE), 0), 6) AS score FROM e JOIN q ON q.unit = e.unit LEFT JOIN d ON d.unit = e.unit AND d.seq = e.seq LEFT JOIN tn ON tn.unit = e.unit AND tn.seq = e.seq LEFT JOIN qn ON qn.unit = e.unit",
    "t6_dense_scores": "SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "j1_unnested": _e() + "SELECT unit, seq FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE a.unit = b.unit AND (b.depth < a.depth OR (b.depth = a.depth AND b.seq < a.seq)) AND a.x >= b.x AND a.y >= b.y AND a.x + a.w <= b.x + b.w AND a.y + a.h <= b.y + b.h)",
    "j2_overlap_pairs": _e("f AS (SELECT * FROM e WHERE tag NOT IN ('h1', 'h2', 'h3', 'h4'))", "o AS (SELECT a.unit, a.seq AS i, b.seq AS j, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS ow, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS oh, least(a.w * a.h, b.w * b.h) AS small FROM f a JOIN f b ON a.unit = b.unit AND a.seq < b.seq)") + f"SELECT unit, i, j, round(ow * oh / small::DOUBLE, 6) AS ratio FROM o WHERE ow > 0 AND oh > 0 AND ow * oh / small::DOUBLE >= {CONFIG.min_overlap_ratio}",
    "j4_below_edges": _e(ROWS, "j AS (SELECT a.unit, a.seq AS src, b.seq AS dst, row_number() OVER (PARTITION BY a.unit, a.seq ORDER BY abs((a.x + a.w / 2) - (b.x + b.w / 2)), b.x, b.seq) AS n FROM pl a JOIN pl b ON a.unit = b.unit AND b.row_idx = a.row_idx + 1 AND b.x < a.x + a.w AND a.x < b.x + b.w)", recursive=True) + "SELECT unit, src, dst, 'below' AS direction FROM j WHERE n = 1 UNION ALL SELECT unit, dst, src, 'above' FROM j WHERE n = 1",
    "j6_question_scores": _e(QUESTIONS, _scores(False)) + "SELECT unit, pos, score FROM sc",
    "a1_union_boxes": _e(HEADINGS, "g AS (SELECT unit, sec_idx, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, list_distinct(list(tag)) AS d, list(tag ORDER BY seq) AS l, count(*) AS n_elements FROM sec GROUP BY unit, sec_idx)") + "SELECT unit, sec_idx, x, y, w, h, array_to_string(list_sort(d), '+') AS tags, n_elements FROM g",
    "a15_pixel_budget": _e() + "SELECT unit, count(*) AS n_units, sum(w * h)::BIGINT AS pixels, sum(least(w * h, 50000))::BIGINT AS capped_pixels, round(sum(w * h) / 784.0::DOUBLE, 4) AS visual_tokens FROM e GROUP BY unit",
    "w1_reading_order": _e(ROWS, recursive=True) + "SELECT * FROM (SELECT unit, seq AS src, lead(seq) OVER (PARTITION BY unit ORDER BY read_pos) AS dst FROM pl) WHERE dst IS NOT NULL",
    "w2_side_edges": _e(ROWS, "r AS (SELECT unit, seq AS src, lead(seq) OVER (PARTITION BY unit, row_idx ORDER BY col_idx) AS dst FROM pl)", recursive=True) + "SELECT unit, src, dst, 'right' AS direction FROM r WHERE dst IS NOT NULL UNION ALL SELECT unit, dst, src, 'left' FROM r WHERE dst IS NOT NULL",
    "w4_link_budget": f"WITH {_LINKS}, f AS (SELECT page_id, seq, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS n FROM (SELECT DISTINCT page_id, seq FROM links)) SELECT links.page_id AS unit, links.seq AS src, href AS dst, anchor_text FROM links JOIN f ON f.page_id = links.page_id AND f.seq = links.seq WHERE n <= 3",
    "w7_first_tiles": _e() + "SELECT unit, seq AS pos FROM e WHERE seq < 25",
    "w12_layout_positions": _e(ROWS, recursive=True) + "SELECT unit, seq, round(CASE WHEN hi > lo THEN 6.0::DOUBLE * (x - lo) / (hi - lo) ELSE 0 END, 6) AS px, -read_pos AS py FROM (SELECT *, min(x) OVER (PARTITION BY unit) AS lo, max(x) OVER (PARTITION BY unit) AS hi FROM pl)",
    "g4_rows": _e(ROWS, recursive=True) + "SELECT unit, seq, row_idx, col_idx, read_pos FROM pl",
    "g11_crawl": f"WITH {_LINKS} SELECT page_id, n, href FROM (SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY min(seq)) - 1 AS n FROM links GROUP BY page_id, href) WHERE n < 3",
    "g12_unit_slugs": f"WITH {_SLUGS}, r AS (SELECT page_id, slug, row_number() OVER (PARTITION BY slug ORDER BY page_id) AS n FROM sl) SELECT page_id, CASE WHEN n = 1 THEN slug ELSE slug || '_' || n END AS slug FROM r",
    "g14_static_top_k": _e(QUESTIONS, _scores(False), _TOP) + "SELECT unit, pos, score FROM tk WHERE rk <= 5",
    "g17_hard_negatives": _e(QUESTIONS, _scores(False), _NEG.format(judge="LEFT JOIN (SELECT 'd' || doc_id AS ju, quality FROM labels) ON ju = sc.unit", leak=_LEAK + " AND NOT coalesce(quality = 1 AND sc.pos % 2 = 1, FALSE)")) + "SELECT unit, pos, nth FROM neg",
    "g18_negatives_unfiltered": _e(QUESTIONS, _scores(True), _NEG.format(judge="", leak="")) + "SELECT unit, pos, nth FROM neg",
    "g24_evidence": _e(QUESTIONS, _scores(False), _TOP) + "SELECT tk.unit, string_agg(left(text, 200), chr(10) || chr(10) ORDER BY pos) AS evidence FROM tk JOIN e ON e.unit = tk.unit AND e.seq = tk.pos WHERE rk <= 5 GROUP BY tk.unit",
    "j21_coverage": _e(QUESTIONS, _scores(False), _TOP) + "SELECT left(q.unit, 2) AS question, count(DISTINCT q.unit) AS pages, count(DISTINCT CASE WHEN rk = 1 THEN q.unit END) AS covered FROM q LEFT JOIN tk ON tk.unit = q.unit AND tk.pos = q.positive GROUP BY 1",
    "a13_dataset_volumes": _e(QUESTIONS, _scores(False), _NEG.format(judge="", leak=_LEAK)) + "SELECT n_negatives::INT AS n_negatives, count(*) AS examples FROM (SELECT q.unit, count(neg.pos) AS n_negatives FROM q LEFT JOIN neg ON neg.unit = q.unit GROUP BY q.unit) GROUP BY 1",
    "w8_rank_metrics": _e(QUESTIONS, _scores(True), "r AS (SELECT sc.unit, sc.pos, row_number() OVER (PARTITION BY sc.unit ORDER BY score DESC, sc.pos) - 1 AS rank FROM sc)") + "SELECT left(r.unit, 1) AS kind, count(*) AS n, round(avg((rank < 1)::INT), 4) AS recall_at_1, round(avg((rank < 3)::INT), 4) AS recall_at_3, round(avg((rank < 5)::INT), 4) AS recall_at_5, round(avg(1.0::DOUBLE / (rank + 1)), 4) AS mrr FROM r JOIN q ON q.unit = r.unit AND q.positive = r.pos GROUP BY 1",
}
