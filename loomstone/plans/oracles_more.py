"""More SQL twins: sections, edges, similarity, controller, multi-hop and corpus queries."""

from __future__ import annotations

from loomstone.config import CONFIG, STOP_WORDS
from loomstone.operators.models import ASK_QUESTION, JUDGE
from loomstone.plans.oracles import SQL, _LINKS, _NEG, _SLUGS, _TOKEN, _TOP, ELEMENTS, HEADINGS, QUESTIONS, ROWS, _e, _html, _scores, _terms

_STOP_LIST = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_HIGH = 2000


def _tile(seq: str) -> str:
    return f"'tile_' || CASE WHEN {seq} < 10000 THEN lpad({seq}::VARCHAR, 4, '0') ELSE {seq}::VARCHAR END"


_LEVEL = "CASE WHEN regexp_full_match(split_part(tag, '+', 1), 'h[1-4]') THEN substr(tag, 2, 1)::INT END"
#: The parent of a tile: of the headings before it whose level is smaller (any, for content), the last.
_PARENTS = f"""
lev AS (SELECT unit, seq, read_pos, {_LEVEL} AS level FROM pl),
par AS (SELECT b.unit, arg_max(a.seq, a.read_pos) AS src, b.seq AS dst FROM lev a JOIN lev b ON a.unit = b.unit AND a.read_pos < b.read_pos AND a.level IS NOT NULL AND (b.level IS NULL OR a.level < b.level) GROUP BY b.unit, b.seq)
"""
_EDGES = f"""
{_PARENTS},
nx AS (SELECT unit, seq, lead(seq) OVER (PARTITION BY unit ORDER BY read_pos) AS nxt, lead(seq) OVER (PARTITION BY unit, row_idx ORDER BY col_idx) AS rgt FROM pl),
bl AS (SELECT a.unit, a.seq AS src, b.seq AS dst, row_number() OVER (PARTITION BY a.unit, a.seq ORDER BY abs((a.x + a.w / 2) - (b.x + b.w / 2)), b.x, b.seq) AS n FROM pl a JOIN pl b ON a.unit = b.unit AND b.row_idx = a.row_idx + 1 AND b.x < a.x + a.w AND a.x < b.x + b.w),
ed AS (SELECT unit, 'page' AS src, {_tile('seq')} AS dst, 'contains' AS relation, NULL::VARCHAR AS direction FROM pl
  UNION ALL SELECT unit, {_tile('seq')}, {_tile('nxt')}, 'reading_order', NULL FROM nx WHERE nxt IS NOT NULL
  UNION ALL SELECT unit, {_tile('seq')}, {_tile('rgt')}, 'layout_adjacency', 'right' FROM nx WHERE rgt IS NOT NULL
  UNION ALL SELECT unit, {_tile('rgt')}, {_tile('seq')}, 'layout_adjacency', 'left' FROM nx WHERE rgt IS NOT NULL
  UNION ALL SELECT unit, {_tile('src')}, {_tile('dst')}, 'layout_adjacency', 'below' FROM bl WHERE n = 1
  UNION ALL SELECT unit, {_tile('dst')}, {_tile('src')}, 'layout_adjacency', 'above' FROM bl WHERE n = 1
  UNION ALL SELECT unit, {_tile('src')}, {_tile('dst')}, 'section_hierarchy', NULL FROM par)
"""
#: A chunk of a section starts where an element ends more than _HIGH below the first element of the chunk before.
_SPLIT = f"""
so AS (SELECT *, row_number() OVER (PARTITION BY unit, sec_idx ORDER BY y, seq) AS o FROM sec),
ch AS (SELECT unit, sec_idx, seq, o, y::DOUBLE AS top, 0 AS chunk FROM so WHERE o = 1
  UNION ALL SELECT so.unit, so.sec_idx, so.seq, so.o, CASE WHEN so.y + so.h - ch.top > {_HIGH} THEN so.y ELSE ch.top END, ch.chunk + CASE WHEN so.y + so.h - ch.top > {_HIGH} THEN 1 ELSE 0 END
  FROM ch JOIN so ON so.unit = ch.unit AND so.sec_idx = ch.sec_idx AND so.o = ch.o + 1),
sp AS (SELECT sec.*, ch.chunk, dense_rank() OVER (PARTITION BY sec.unit ORDER BY sec.sec_idx, ch.chunk) - 1 AS section, CASE WHEN ch.chunk = 0 THEN title ELSE title || ' (suite ' || (ch.chunk + 1) || ')' END AS section_title FROM sec JOIN ch ON ch.unit = sec.unit AND ch.sec_idx = sec.sec_idx AND ch.seq = sec.seq)
"""
_UNITS = f"""
{_SPLIT},
ph AS (SELECT unit, max(y + h) - min(y) > {_HIGH} AS high FROM e GROUP BY unit),
us AS (SELECT sp.unit, high, CASE WHEN high THEN section ELSE 0 END::INT AS section, CASE WHEN high THEN section_title ELSE '' END AS section_title, y, h FROM sp JOIN ph ON ph.unit = sp.unit),
su AS (SELECT unit, CASE WHEN high THEN unit || '__sec' || section ELSE unit END AS section_unit, section, section_title, CASE WHEN high AND section > 0 THEN '#section-' || section ELSE '' END AS url_suffix, min(y)::BIGINT AS top, (max(y + h) - min(y))::BIGINT AS height, count(*) AS n_elements FROM us GROUP BY unit, high, section, section_title)
"""
_CHAIN = "cn AS (SELECT * FROM (SELECT unit, section_unit || '::page' AS src, lead(section_unit) OVER (PARTITION BY unit ORDER BY section) || '::page' AS dst FROM su) WHERE dst IS NOT NULL)"
_BANDS = f"""
bp AS (SELECT unit, max(y + h) AS height, max(x + w) AS page_w FROM e GROUP BY unit),
bb AS (SELECT unit, height, page_w, unnest(range(0, ceil(height / {CONFIG.band_height}.0)::BIGINT))::INT AS band FROM bp),
bt AS (SELECT bb.unit, band, string_agg(left(text, 200), ' ' ORDER BY seq) AS t FROM bb JOIN e ON e.unit = bb.unit AND e.y < (band + 1) * {CONFIG.band_height} AND e.y + e.h > band * {CONFIG.band_height} AND trim(text) <> '' GROUP BY bb.unit, band),
gb AS (SELECT bb.unit, bb.band, greatest(0, (page_w - {CONFIG.band_width}) // 2)::BIGINT AS x, (bb.band * {CONFIG.band_height})::BIGINT AS y, least({CONFIG.band_height}, height - bb.band * {CONFIG.band_height})::BIGINT AS h, left(coalesce(t, ''), 200) AS text_preview FROM bb LEFT JOIN bt ON bt.unit = bb.unit AND bt.band = bb.band)
"""


def _chunks(where: str = "") -> str:
    return f"""
ct AS (SELECT unit, string_agg(text, ' ' ORDER BY seq) AS t FROM e WHERE trim(text) <> '' {where} GROUP BY unit),
ck AS (SELECT unit, chunk, substring(t, chunk * 400 + 1, 400) AS chunk_text FROM (SELECT unit, t, unnest(range(0, ceil(length(t) / 400.0)::BIGINT))::INT AS chunk FROM ct))
"""


_PAIRS = f"""
{_terms('tt', 'e', 'unit, seq')},
sz AS (SELECT unit, count(*) AS n FROM e GROUP BY unit),
df AS (SELECT unit, term, count(*) AS df FROM tt GROUP BY unit, term),
wr AS (SELECT tt.unit, seq, tt.term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS r FROM tt JOIN df ON df.unit = tt.unit AND df.term = tt.term JOIN sz ON sz.unit = tt.unit),
wn AS (SELECT unit, seq, sqrt(sum(r * r)) AS nn FROM wr GROUP BY unit, seq),
wt AS (SELECT wr.unit, wr.seq, term, r / nn AS w FROM wr JOIN wn ON wn.unit = wr.unit AND wn.seq = wr.seq),
sm AS (SELECT a.unit, a.seq AS i, b.seq AS j, round(sum(a.w * b.w), 6) AS similarity FROM wt a JOIN wt b ON a.unit = b.unit AND a.term = b.term AND a.seq < b.seq GROUP BY a.unit, a.seq, b.seq HAVING round(sum(a.w * b.w), 6) >= {CONFIG.semantic_threshold})
"""
#: Pairs in turn, kept while both ends have room.
_GREEDY = f"""
so AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY similarity DESC, i, j) AS o FROM sm),
gr AS (SELECT unit, 0::BIGINT AS o, []::STRUCT(i INT, j INT)[] AS kept FROM so GROUP BY unit
  UNION ALL SELECT so.unit, so.o, CASE WHEN len(list_filter(kept, lambda k: k.i = so.i OR k.j = so.i)) < {CONFIG.max_semantic_neighbours} AND len(list_filter(kept, lambda k: k.i = so.j OR k.j = so.j)) < {CONFIG.max_semantic_neighbours} THEN list_append(kept, {{'i': so.i::INT, 'j': so.j::INT}}) ELSE kept END
  FROM gr JOIN so ON so.unit = gr.unit AND so.o = gr.o + 1),
gk AS (SELECT unit, unnest(arg_max(kept, o)) AS k FROM gr GROUP BY unit)
"""
_OVERLAP = "len(list_intersect({s}, {t})) >= 0.5 * len({s}) AND len({s}) > 0"


def _words(text: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({text}), {_TOKEN})), lambda w: NOT list_contains({_STOP_LIST}, w))"


_HOTPOT = """
dl AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents),
hp AS (SELECT a.doc_id::VARCHAR AS id, a.doc_id AS d, a.s AS s, b.s AS t FROM dl a JOIN dl b ON b.doc_id = a.doc_id + 1),
ss AS (SELECT id, 'Doc ' || d AS title, 0 AS sent_id, s[1] AS sentence FROM hp WHERE s[1] IS NOT NULL UNION ALL SELECT id, 'Doc ' || (d + 1), 1, t[2] FROM hp WHERE t[2] IS NOT NULL)
"""
_MULTI = f"""
{_HOTPOT},
sw AS (SELECT id, replace(title, ' ', '_') AS page, {_words('sentence')} AS ws FROM ss),
tw AS (SELECT replace(unit, 'd', 'Doc_') AS page, {_tile('seq')} AS tile, {_words('text')} AS ts FROM e WHERE unit LIKE 'd%'),
ht AS (SELECT DISTINCT id, sw.page, tile FROM sw JOIN tw ON tw.page = sw.page WHERE {_OVERLAP.format(s='ws', t='ts')}),
pp AS (SELECT DISTINCT id, page FROM sw),
pg AS (SELECT pp.id, count(*) AS pages, bool_and(pp.page IN (SELECT page FROM tw)) AS have, bool_and((pp.id, pp.page) IN (SELECT (id, page) FROM ht)) AS hit FROM pp GROUP BY pp.id),
st AS (SELECT hp.id, CASE WHEN coalesce(pages, 0) < 2 THEN 'single_page' WHEN NOT have THEN 'unavailable' WHEN NOT hit THEN 'unmatched' ELSE 'ok' END AS status FROM hp LEFT JOIN pg ON pg.id = hp.id),
pos AS (SELECT id, string_agg(page || '/' || tile, ',' ORDER BY page, tile) AS positives, count(*) AS k FROM ht GROUP BY id),
al AS (SELECT pp.id, count(*) AS k FROM pp JOIN tw ON tw.page = pp.page GROUP BY pp.id)
"""
_A, _O, _SEED = CONFIG.activate_threshold, CONFIG.open_threshold, CONFIG.seed_top_k
_PLACED_AS_E = "e0 AS (SELECT * FROM pl)"


#: Neighbours of a tile in page order, those tried first in front: (unit, pos, list of places from 1).
_BEFORE_AND_AFTER = "nb AS (SELECT unit, pos, list_filter([pos, pos + 2], lambda p: p BETWEEN 1 AND n) AS near FROM (SELECT unit, pos, count(*) OVER (PARTITION BY unit) AS n FROM sc))"


def _controller(near: str = _BEFORE_AND_AFTER) -> str:
    """The state machine, a step of its main loop an iteration; states 0 inactive, 1 active, 2 opened, 3 pruned."""
    names = "['inactive', 'active', 'opened', 'pruned']"
    return f"""
{near},
sl AS (SELECT sc.unit, list(score ORDER BY sc.pos) AS s, list(coalesce(near, []) ORDER BY sc.pos) AS nb FROM sc LEFT JOIN nb ON nb.unit = sc.unit AND nb.pos = sc.pos GROUP BY sc.unit),
sr AS (SELECT unit, pos, row_number() OVER (PARTITION BY unit ORDER BY score DESC, pos) AS k FROM sc),
sd AS (SELECT unit, list({{'p': (pos + 1)::INT, 'a': 'seed', 'f': 0, 't': 1}} ORDER BY k) FILTER (WHERE k <= {_SEED}) AS log, list((k <= {_SEED})::INT ORDER BY pos) AS st FROM sr GROUP BY unit),
run AS (SELECT sl.unit, s, nb, st, 0 AS opened, log FROM sl JOIN sd ON sd.unit = sl.unit
  UNION ALL
  SELECT unit, s, nb,
    list_transform(st, lambda v, i: coalesce(list_extract(list_transform(list_filter(new, lambda n: n.p = i), lambda n: n.t), -1), v)), opened + (new[1].a = 'open')::INT, list_concat(log, new)
  FROM (SELECT unit, s, nb, st, opened, log, CASE WHEN s[b] < {_O} THEN [{{'p': b::INT, 'a': 'prune', 'f': 1, 't': 3}}] ELSE list_concat([{{'p': b::INT, 'a': 'open', 'f': 1, 't': 2}}], list_transform(list_filter(nb[b], lambda i: st[i] = 0 AND s[i] >= {_A}), lambda i: {{'p': i::INT, 'a': 'activate', 'f': 0, 't': 1}})) END AS new
    FROM (SELECT *, list_position(m, list_max(m)) AS b FROM (SELECT *, list_transform(s, lambda v, i: CASE WHEN st[i] = 1 THEN v ELSE -1 END) AS m FROM run WHERE opened < {CONFIG.budget} AND list_contains(st, 1))))),
fin AS (SELECT unit, s, list_concat(log, list_transform(list_filter(range(1, len(s) + 1), lambda i: st[i] = 1), lambda i: {{'p': i::INT, 'a': 'prune', 'f': 1, 't': 3}})) AS log FROM run WHERE opened = {CONFIG.budget} OR NOT list_contains(st, 1)),
lg AS (SELECT unit, s, unnest(log) AS l, unnest(range(0, len(log)))::INT AS step FROM fin),
cl AS (SELECT unit, step, l.p - 1 AS pos, l.a AS action, s[l.p] AS score, {names}[l.f + 1] AS state_before, {names}[l.t + 1] AS state_after FROM lg)
"""


#: The tiles in reading order take the place of the elements: `seq` is the place, as the controller sees it.
_READ = "WITH RECURSIVE " + _e(ROWS, recursive=True).removeprefix("WITH RECURSIVE ").replace("pl AS (SELECT *, row_number()", "pl0 AS (SELECT *, row_number()").rstrip()
_READ_E = "er AS (SELECT unit, read_pos::INT AS seq, text FROM pl0)"


def _on_read(sql: str) -> str:
    """The same SQL over `er`."""
    return sql.replace(" FROM e)", " FROM er)").replace(" FROM e JOIN", " FROM er e JOIN").replace(" FROM e ", " FROM er ")


_CONTROLLED = f"{_READ}, {_READ_E}, {_on_read(QUESTIONS)}, {_on_read(_scores(True))}, {_controller()}"


def _ablation() -> str:
    return _e(QUESTIONS, _BANDS, _chunks(), f"""
it AS (SELECT 'dom' AS c, unit, seq AS pos, text FROM e UNION ALL SELECT 'grid', unit, band, text_preview FROM gb UNION ALL SELECT 'text', unit, chunk, chunk_text FROM ck),
qq AS (SELECT unit, question AS text FROM q), {_terms('xt', 'it', 'c, unit, pos')}, {_terms('qt', 'qq', 'unit')},
cs AS (SELECT c, unit, count(*) AS n FROM it GROUP BY c, unit),
cq AS (SELECT c, cs.unit, term, tf FROM cs JOIN qt ON qt.unit = cs.unit),
dx AS (SELECT c, unit, term, count(*) AS df FROM (SELECT c, unit, term FROM xt UNION ALL SELECT c, unit, term FROM cq) GROUP BY c, unit, term),
ix AS (SELECT dx.c, dx.unit, term, ln((2 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM dx JOIN cs ON cs.c = dx.c AND cs.unit = dx.unit),
xr AS (SELECT xt.c, xt.unit, pos, xt.term, tf * idf AS w FROM xt JOIN ix USING (c, unit, term)), yr AS (SELECT cq.c, cq.unit, cq.term, tf * idf AS w FROM cq JOIN ix USING (c, unit, term)),
xn AS (SELECT c, unit, pos, sqrt(sum(w * w)) AS nn FROM xr GROUP BY ALL), yn AS (SELECT c, unit, sqrt(sum(w * w)) AS nn FROM yr GROUP BY ALL),
xd AS (SELECT c, unit, xr.pos, sum(xr.w * yr.w) AS d FROM xr JOIN yr USING (c, unit, term) GROUP BY ALL),
xs AS (SELECT it.c, it.unit, it.pos, it.text, round(coalesce(d / (xn.nn * yn.nn), 0), 6) AS score FROM it JOIN q ON q.unit = it.unit JOIN qq ON qq.unit = it.unit LEFT JOIN xd ON xd.c = it.c AND xd.unit = it.unit AND xd.pos = it.pos LEFT JOIN xn ON xn.c = it.c AND xn.unit = it.unit AND xn.pos = it.pos LEFT JOIN yn ON yn.c = it.c AND yn.unit = it.unit),
xk AS (SELECT c, unit, text, row_number() OVER (PARTITION BY c, unit ORDER BY score DESC, pos) AS rk FROM xs),
att AS (SELECT c, xk.unit, min(CASE WHEN trim(answer) <> '' AND contains(lower(text), lower(trim(answer))) THEN rk END) AS best, count(*) AS n FROM xk JOIN q ON q.unit = xk.unit GROUP BY c, xk.unit),
a2 AS (SELECT *, count(best) OVER (PARTITION BY unit) = 3 AS every FROM att), a3 AS (SELECT *, 'all' AS questions_of FROM a2 UNION ALL SELECT *, 'paired' FROM a2 WHERE every)
""") + """SELECT c AS condition, questions_of, count(*) AS questions, count(best) AS attributable, round(count(best) / count(*)::DOUBLE, 4) AS attachment_rate, round(avg((best <= 1)::INT), 4) AS recall_at_1, round(avg((best <= 5)::INT), 4) AS recall_at_5,
 round(avg(CASE WHEN best IS NULL THEN NULL WHEN n <= 1 THEN 1.0 ELSE 1 - (best - 1) / (n - 1)::DOUBLE END), 4) AS percentile_rank FROM a3 GROUP BY c, questions_of"""


#: Words between white space once punctuation is gone; edit distances are differences of length, since predictions here are the gold text with a part left out or added.
_NORMAL = r"array_to_string(list_filter(string_split_regex(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"
_METRICS = rf"""
nm AS (SELECT *, {_NORMAL.format('gold')} AS g, {_NORMAL.format('predicted')} AS p, trim(regexp_replace(lower(gold), '\s+', ' ', 'g')) AS lg, trim(regexp_replace(lower(predicted), '\s+', ' ', 'g')) AS lp FROM ab),
tk AS (SELECT *, list_filter(string_split(g, ' '), lambda t: t <> '') AS gs, list_filter(string_split(p, ' '), lambda t: t <> '') AS ps FROM nm),
cm AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(ps), lambda t: least(len(list_filter(ps, lambda u: u = t)), len(list_filter(gs, lambda u: u = t))))), 0) AS c, 1 - abs(length(lp) - length(lg)) / greatest(length(lp), length(lg), 1)::DOUBLE AS a FROM tk),
mt AS (SELECT *, (g = p)::INT::DOUBLE AS em, round(CASE WHEN len(ps) = 0 OR len(gs) = 0 THEN (len(ps) = len(gs))::INT WHEN c = 0 THEN 0 ELSE 2.0::DOUBLE * c / (len(ps) + len(gs)) END, 6) AS f1, round(CASE WHEN a < 0.5 THEN 0 ELSE a END, 6) AS anls FROM cm)
"""
_HOST = "regexp_extract({0}, '^([a-z]+://[^/]+)', 1)"
_CONTRAST = _e(QUESTIONS, "qq AS (SELECT unit, question AS text FROM q)", _terms("tt", "e", "unit, seq", False), _terms("qt", "qq", "unit", False), "tn AS (SELECT unit, seq, sum(tf * tf) AS v FROM tt GROUP BY unit, seq)", "qn AS (SELECT unit, sum(tf * tf) AS v FROM qt GROUP BY unit)", "d AS (SELECT tt.unit, seq, sum(tt.tf * qt.tf) AS dot FROM tt JOIN qt ON tt.unit = qt.unit AND tt.term = qt.term GROUP BY tt.unit, seq)", "sc AS (SELECT e.unit, e.seq AS pos, round(coalesce(dot / sqrt((tn.v * qn.v)::DOUBLE), 0), 6) AS score FROM e JOIN q ON q.unit = e.unit LEFT JOIN d ON d.unit = e.unit AND d.seq = e.seq LEFT JOIN tn ON tn.unit = e.unit AND tn.seq = e.seq LEFT JOIN qn ON qn.unit = e.unit)", _NEG.format(judge="", leak="AND NOT (lower(answer) <> '' AND contains(lower(text), lower(answer)))"))

_DECODED = "regexp_replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&amp;?', '&', 'g')"


def _tiles(least: int = CONFIG.min_tile_height, most: int = CONFIG.max_tile_height) -> str:
    """The packer over `e`: prune in turn, components of overlap, roles, then a walk over the groups for tile numbers."""
    box = "STRUCT(seq INT, x BIGINT, y BIGINT, w BIGINT, h BIGINT)"
    heads = "('h1', 'h2', 'h3', 'h4')"
    return f"""
pz AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY depth, seq) AS o FROM e),
kp AS (SELECT unit, 0::BIGINT AS o, []::{box}[] AS kept FROM (SELECT DISTINCT unit FROM e)
  UNION ALL SELECT pz.unit, pz.o, CASE WHEN len(list_filter(kept, lambda k: pz.x >= k.x - 1 AND pz.y >= k.y - 1 AND pz.x + pz.w <= k.x + k.w + 1 AND pz.y + pz.h <= k.y + k.h + 1)) > 0 THEN kept ELSE list_append(kept, {{'seq': pz.seq, 'x': pz.x, 'y': pz.y, 'w': pz.w, 'h': pz.h}}::{box}) END
  FROM kp JOIN pz ON pz.unit = kp.unit AND pz.o = kp.o + 1),
kl AS (SELECT unit, unnest(arg_max(kept, o)).seq AS seq FROM kp GROUP BY unit),
k AS (SELECT e.* FROM e JOIN kl ON kl.unit = e.unit AND kl.seq = e.seq),
po AS (SELECT a.unit, a.seq AS i, b.seq AS j, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS ow, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS oh, least(a.w * a.h, b.w * b.h) AS sm FROM k a JOIN k b ON a.unit = b.unit AND a.seq <> b.seq AND a.tag NOT IN {heads} AND b.tag NOT IN {heads}),
ov AS (SELECT unit, i, j FROM po WHERE ow > 0 AND oh > 0 AND ow * oh / sm::DOUBLE >= {CONFIG.min_overlap_ratio}),
cm AS (SELECT unit, seq, seq AS root FROM k UNION SELECT ov.unit, ov.j, cm.root FROM cm JOIN ov ON ov.unit = cm.unit AND ov.i = cm.seq),
gp AS (SELECT unit, seq, min(root) AS g FROM cm GROUP BY unit, seq),
gm AS (SELECT k.*, g, row_number() OVER (PARTITION BY k.unit, g ORDER BY y, x, k.seq) AS gi, count(*) OVER (PARTITION BY k.unit, g) AS n FROM k JOIN gp ON gp.unit = k.unit AND gp.seq = k.seq),
gf AS (SELECT unit, g, n, y, h, tag IN {heads} AS head, row_number() OVER (PARTITION BY unit ORDER BY y, x, seq) AS o FROM gm WHERE gi = 1),
gh AS (SELECT *, coalesce(lag(head) OVER (PARTITION BY unit ORDER BY o), FALSE) AS ph, coalesce(lead(head) OVER (PARTITION BY unit ORDER BY o), TRUE) AS nh FROM gf),
gr AS (SELECT *, CASE WHEN head AND nh THEN 'alone' WHEN head THEN 'head' WHEN ph THEN 'led' WHEN n = 1 AND h < {least} THEN 'low' ELSE 'alone' END AS kind FROM gh),
wk AS (SELECT unit, o, g, kind, 0 AS t, y AS top, y + h AS bottom, kind = 'head' OR (kind = 'low' AND h < {least}) AS more FROM gr WHERE o = 1
  UNION ALL SELECT unit, o, g, kind, t, top, bottom, kind = 'head' OR (kind = 'low' AND bottom - top < {least}) FROM (
    SELECT gr.unit, gr.o, gr.g, gr.kind, CASE WHEN c THEN wt ELSE wt + 1 END AS t, CASE WHEN c THEN least(wtop, y) ELSE y END AS top, CASE WHEN c THEN greatest(wbottom, y + h) ELSE y + h END AS bottom
    FROM (SELECT gr.*, wk.t AS wt, wk.top AS wtop, wk.bottom AS wbottom, gr.kind = 'led' OR (gr.kind = 'low' AND wk.kind = 'low' AND wk.more) AS c FROM wk JOIN gr ON gr.unit = wk.unit AND gr.o = wk.o + 1) gr)),
tm AS (SELECT gm.*, wk.o, wk.t, wk.kind FROM wk JOIN gm ON gm.unit = wk.unit AND gm.g = wk.g),
ft AS (SELECT unit, t, tag, kind = 'head' AS lead, min(o * 100000 + gi) AS place FROM tm GROUP BY ALL),
tt0 AS (SELECT unit, t, string_agg(tag, '+' ORDER BY place) AS tags FROM ft GROUP BY unit, t),
tb AS (SELECT unit, t, bool_or(kind = 'low') AS low, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, left(string_agg(left(text, 200), ' ' ORDER BY o, gi), 200) AS text_preview FROM tm GROUP BY unit, t),
pw AS (SELECT unit, max(x + w) AS pw, max(y + h) AS ph FROM e GROUP BY unit),
ts AS (SELECT tb.unit, tb.t, CASE WHEN low THEN 'merged' ELSE tags END AS dom_tag, x, y, w, h, text_preview, pw, ph, greatest(1, ceil(h / {most}.0))::INT AS n FROM tb JOIN tt0 ON tt0.unit = tb.unit AND tt0.t = tb.t JOIN pw ON pw.unit = tb.unit),
tk0 AS (SELECT *, unnest(range(0, n)) AS s FROM ts),
tl0 AS (SELECT *, floor(y + s * (h / n::DOUBLE))::BIGINT AS top FROM tk0), tl1 AS (SELECT *, floor(least(h / n::DOUBLE, ph - top))::BIGINT AS high, least(pw, x + w) - x AS width FROM tl0),
tiles AS (SELECT unit, (row_number() OVER (PARTITION BY unit ORDER BY t, s) - 1)::INT AS tile_seq, x::INT AS x, top::INT AS y, width::INT AS width, high::INT AS height, dom_tag, text_preview FROM tl1 WHERE high > 0 AND width > 0)
"""


def _html_page() -> str:
    """`e` of html pages: whole decoded texts in the flow layout."""
    full = _html().replace(", 200) AS text_preview", ", 100000000) AS text_preview")
    lines = f"lines AS (SELECT 'p' || page_id AS unit, 0 AS part, seq AS i, {_DECODED.format('text_preview')} AS text, tag FROM ({full}))"
    return "WITH RECURSIVE " + lines + ", " + ELEMENTS[ELEMENTS.index("nums AS") :]


def _cross_page() -> str:
    """Own scoring of a question over a pool of several pages."""
    return _e(QUESTIONS, f"""
dq AS (SELECT unit, positive, question, substr(unit, 2)::BIGINT AS d FROM q WHERE unit LIKE 'd%'),
pl0 AS (SELECT dq.unit AS id, e.unit AS page, e.seq AS tile, text, row_number() OVER (PARTITION BY dq.unit ORDER BY e.unit <> dq.unit, e.seq) - 1 AS pos FROM dq JOIN e ON e.unit IN (dq.unit, 'd' || (d + 1)) WHERE NOT (e.unit = dq.unit AND e.seq = dq.positive)),
qq AS (SELECT unit AS id, question AS text FROM dq), {_terms('xt', 'pl0', 'id, pos')}, {_terms('qt', 'qq', 'id')},
cs AS (SELECT id, count(*) AS n FROM pl0 GROUP BY id),
dx AS (SELECT id, term, count(*) AS df FROM (SELECT id, term FROM xt UNION ALL SELECT id, term FROM qt) GROUP BY id, term),
ix AS (SELECT dx.id, term, ln((2 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM dx JOIN cs ON cs.id = dx.id),
xr AS (SELECT id, pos, term, tf * idf AS w FROM xt JOIN ix USING (id, term)), yr AS (SELECT id, term, tf * idf AS w FROM qt JOIN ix USING (id, term)),
xn AS (SELECT id, pos, sqrt(sum(w * w)) AS nn FROM xr GROUP BY ALL), yn AS (SELECT id, sqrt(sum(w * w)) AS nn FROM yr GROUP BY ALL),
xd AS (SELECT id, xr.pos, sum(xr.w * yr.w) AS d FROM xr JOIN yr USING (id, term) GROUP BY ALL),
xs AS (SELECT p.id, page, tile, row_number() OVER (PARTITION BY p.id ORDER BY round(coalesce(d / (xn.nn * yn.nn), 0), 6) DESC, p.pos) - 1 AS nth FROM pl0 p LEFT JOIN xd ON xd.id = p.id AND xd.pos = p.pos LEFT JOIN xn ON xn.id = p.id AND xn.pos = p.pos LEFT JOIN yn ON yn.id = p.id)
""") + "SELECT id, nth, page AS page_slug, tile AS tile_id FROM xs WHERE nth < 2"


#: Around a tile its neighbours of the section, then the tiles of the next section.
_ACROSS = """
nr AS (SELECT unit, seq AS pos, lag(seq) OVER (PARTITION BY unit, section ORDER BY seq) AS b, lead(seq) OVER (PARTITION BY unit, section ORDER BY seq) AS a, section FROM sp),
nx AS (SELECT unit, section, list(seq + 1 ORDER BY seq) AS every FROM sp GROUP BY unit, section),
nb AS (SELECT nr.unit, nr.pos, list_concat(list_filter([b + 1, a + 1], lambda p: p IS NOT NULL), coalesce(every, [])) AS near FROM nr LEFT JOIN nx ON nx.unit = nr.unit AND nx.section = nr.section + 1)"""

MORE = {
    "s3_qa_pairs": "SELECT conv_id || '_' || turn AS id, text AS question, upper(role) AS answer FROM conversations",
    "s4_contrastive_examples": _CONTRAST.rstrip() + f" SELECT q.unit AS qa_id, answer, {_tile('q.positive')} AS positive_tile_id, coalesce(string_agg({_tile('neg.pos')}, ',' ORDER BY nth), '') AS negatives FROM q LEFT JOIN neg ON neg.unit = q.unit GROUP BY q.unit, answer, q.positive",
    "s10_url_list": "SELECT url FROM pages WHERE page_id % 5 <> 0",
    "s11_snapshot": "SELECT url, page_id * 10 AS revid, url || '?oldid=1' AS pinned_url FROM pages",
    "k1_saved_images": "SELECT role || '__' || conv_id || '_' || turn AS id, md5(text) AS digest FROM conversations",
    "k9_page_xml": _e(ROWS, recursive=True) + """SELECT pl.unit, '<?xml version="1.0" ?>' || chr(10) || '<page url="https://x.org/?a=1&amp;b=' || substr(pl.unit, 2) || '" title="&lt;' || any_value(k) || ' turns&gt;">' || chr(10) || string_agg('  <element id="' || """ + _tile("seq") + """ || '" tag="' || tag || '" state="inactive">' || replace(replace(replace(replace(left(text, 200), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</element>', chr(10) ORDER BY read_pos) || chr(10) || '</page>' || chr(10) AS xml FROM pl JOIN (SELECT 'c' || conv_id AS unit, count(*) AS k FROM conversations GROUP BY conv_id) c ON c.unit = pl.unit GROUP BY pl.unit""",
    "k2_idempotent_append": "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type",
    "k5_attempt_log": "SELECT doc_id::VARCHAR AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "k8_results": SQL["w8_rank_metrics"],
    "j1_pruned": "WITH RECURSIVE " + _e(_tiles(), recursive=True).removeprefix("WITH RECURSIVE ") + "SELECT unit, seq FROM k",
    "a3_tile_sources": _e(_tiles(), recursive=True) + ", sc0 AS (SELECT unit, t, string_agg(seq::VARCHAR, ',' ORDER BY o, gi) AS sources FROM tm GROUP BY unit, t) SELECT tl1.unit, (row_number() OVER (PARTITION BY tl1.unit ORDER BY tl1.t, s) - 1)::INT AS tile_seq, sources FROM tl1 JOIN sc0 ON sc0.unit = tl1.unit AND sc0.t = tl1.t WHERE high > 0 AND width > 0",
    "g8_semantic_edges": f"{_READ}, {_READ_E}, {_on_read(_PAIRS)}, {_GREEDY}, at0 AS (SELECT unit, read_pos, seq FROM pl0) SELECT gk.unit, {_tile('a.seq')} AS src, {_tile('b.seq')} AS dst, similarity FROM gk JOIN sm ON sm.unit = gk.unit AND sm.i = k.i AND sm.j = k.j JOIN at0 a ON a.unit = gk.unit AND a.read_pos = k.i JOIN at0 b ON b.unit = gk.unit AND b.read_pos = k.j",
    "g13_across_sections": _e(QUESTIONS, HEADINGS, _SPLIT, _scores(True), _controller(_ACROSS), recursive=True) + "SELECT unit, step, pos, action, score, state_before, state_after FROM cl",
    "g1_tiles": _e(_tiles(), recursive=True) + f"SELECT unit, tile_seq, {_tile('tile_seq')} AS tile_id, x, y, width, height, dom_tag, text_preview FROM tiles",
    "g10_page_graph": _html_page() + ", " + _tiles() + ", " + ROWS.replace("FROM e)", "FROM te)").replace("e.*", "e.*").replace("FROM e JOIN", "FROM te e JOIN").replace("\nord AS", "\nte AS (SELECT unit, tile_seq AS seq, dom_tag AS tag, x, y, width AS w, height AS h FROM tiles),\nord AS") + ", " + _EDGES + "SELECT unit, src, dst, relation, direction FROM ed",
    "j7_cross_page_negatives": _cross_page(),
    "s1_parsed_elements": f"SELECT page_id, tag, left({_DECODED.format('text_preview')}, 200) AS text_preview FROM ({_html().replace(', 200) AS text_preview', ', 1000000) AS text_preview')}) WHERE tag IN ('h1', 'p')",
    "s6_last_text": "SELECT role AS slug, 'tile_' || turn AS tile_id, arg_max(text, conv_id) AS text FROM conversations GROUP BY 1, 2",
    "s8_new_records": "SELECT doc_id AS id, lang AS split FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels)",
    "s8_first_records": "SELECT doc_id AS id, lang AS split FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 50",
    "s13_title_from_url": "SELECT item_id, split_part(replace(text, '_', ' '), '#', 1) AS title FROM benchmark",
    "k1_image_paths": "SELECT conv_id, turn, 'images/' || role || '__tile_' || turn || '.png' AS image_path FROM conversations",
    "k3_generated_qa": f"WITH t AS (SELECT 'c' || conv_id || '__tile_' || turn || '__qa' AS id, turn, '{ASK_QUESTION}' || chr(10) || text AS p FROM conversations WHERE role = 'assistant') SELECT id, 'old?' AS question, 'old' AS answer FROM t WHERE turn = 2 UNION ALL SELECT id, 'how many?', len(list_filter(string_split_regex(p, '[ ' || chr(10) || ']+'), lambda w: w <> ''))::VARCHAR FROM t WHERE turn <> 2 AND length(p) % 3 <> 0",
    "k5_attempts": "SELECT doc_id AS id FROM labels WHERE quality = 1 OR toxic = 1",
    "k10_edge_ids": _e(ROWS, _EDGES, recursive=True) + "SELECT unit, src || '__' || dst || '__' || (row_number() OVER (PARTITION BY unit, src, dst ORDER BY relation, direction NULLS FIRST) - 1) AS id, relation FROM ed",
    "k10_graph_json": _e(ROWS, _EDGES, recursive=True) + "SELECT unit, (SELECT count(*) + 1 FROM pl WHERE pl.unit = u.unit) AS n_nodes, (SELECT count(*) FROM ed WHERE ed.unit = u.unit) AS n_edges FROM (SELECT DISTINCT unit FROM pl) u",
    "k12_cache_misses": r"WITH r AS (SELECT role, sha256(encode(role) || '\x00'::BLOB || encode(text) || '\x00'::BLOB) AS key FROM conversations), c AS (SELECT DISTINCT key FROM r WHERE role = 'system') SELECT key, CASE WHEN key IN (SELECT key FROM c) THEN 'hit' ELSE 'miss' END AS kind, CASE WHEN key IN (SELECT key FROM c) THEN count(*) ELSE 1 END AS n FROM r GROUP BY key",
    "p2_size_filter": _e() + "SELECT unit, seq, w % 7 AS w, seq % 5 AS h FROM e WHERE w % 7 > 2 AND seq % 5 > 2",
    "p5_tag_functions": r"""WITH a AS (SELECT item_id, array_to_string(string_split_regex(lower(text), '[^a-z0-9]+')[1:2], '+') AS a FROM benchmark),
      t AS (SELECT item_id, unnest([a, 'h2+p', 'h1', 'merged', 'h3+ul+table', 'figure', 'blockquote']) AS tag FROM a), k AS (SELECT *, split_part(tag, '+', 1) AS f, split_part(tag, '+', -1) AS l FROM t),
      m(c, name) AS (VALUES ('h1', 'heading'), ('h2', 'heading'), ('h3', 'heading'), ('h4', 'heading'), ('p', 'text'), ('merged', 'text'), ('table', 'table'), ('ul', 'list'), ('ol', 'list'), ('img', 'media'), ('figure', 'media'), ('blockquote', 'quote_code'), ('pre', 'quote_code'))
      SELECT item_id, tag, CASE WHEN f IN ('h1', 'h2', 'h3', 'h4') THEN right(f, 1)::INT ELSE 0 END AS level, coalesce((SELECT name FROM m WHERE c = l), 'other') AS by_last, coalesce((SELECT name FROM m WHERE c = f), 'other') AS by_first FROM k""",
    "p10_sentence_overlap": _e(QUESTIONS, f"o AS (SELECT e.unit, e.seq AS pos, {_words('question')} AS s, {_words('text')} AS t FROM e JOIN q ON q.unit = e.unit)") + f"SELECT unit, pos FROM o WHERE {_OVERLAP.format(s='s', t='t')}",
    "p14_resolvable": _CONTRAST + "SELECT q.unit, count(neg.pos)::INT AS n FROM q LEFT JOIN neg ON neg.unit = q.unit GROUP BY q.unit, q.positive HAVING q.positive % 7 <> 3 AND coalesce(bool_and(neg.pos % 7 <> 3), TRUE)",
    "p18_tables_of_manifest": "SELECT * FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'h2+table' WHEN 1 THEN 'table+p' ELSE 'table' END AS dom_tag FROM conversations) WHERE dom_tag = 'table' OR dom_tag LIKE '%+table'",
    "t7_info_nce": "WITH e AS (SELECT vec_id, vec_id // 8 AS b, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT x.b, x.vec_id AS q, y.vec_id AS t, list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) / 0.05 AS s FROM e x JOIN e y ON x.b = y.b), l AS (SELECT b, q, ln(sum(exp(s - m))) + max(m) - max(CASE WHEN t = q THEN s END) AS l FROM (SELECT *, max(s) OVER (PARTITION BY b, q) AS m FROM s) GROUP BY b, q) SELECT b AS batch, round(avg(l), 4) AS loss, count(*) AS n FROM l GROUP BY b",
    "t8_answer_metrics": "WITH ab AS (SELECT item_id, text AS gold, regexp_replace(regexp_replace(text, '^[^ ]+ ', ''), 'a', 'A', 'g') AS predicted FROM benchmark UNION ALL SELECT item_id + 100000, text, text || ' the end of it ' || text FROM benchmark), " + _METRICS + "SELECT item_id, em, f1, anls, g AS normalized FROM mt",
    "a11_answer_means": "WITH ab AS (SELECT 'cut' AS run, text AS gold, regexp_replace(text, '^[^ ]+ ', '') AS predicted FROM benchmark UNION ALL SELECT 'same', text, '  The ' || text FROM benchmark), " + _METRICS + "SELECT run, count(*) AS n, round(avg(em), 4) AS em, round(avg(f1), 4) AS f1, round(avg(anls), 4) AS anls FROM mt GROUP BY run",
    "t16_parse_qa": r"""WITH q AS (SELECT item_id, trim(regexp_replace(text, '["\\\n\r\t{}]', '', 'g')) AS q FROM benchmark) SELECT item_id, k AS kind, CASE WHEN k IN (0, 1, 4) AND q <> '' THEN q END AS question, CASE WHEN k IN (0, 1, 4) AND q <> '' THEN 'x' END AS answer FROM q, range(6) r(k)""",
    "t19_prompts": "SELECT item_id, '" + JUDGE.replace("{question}", "' || text || '").replace("{answer}", "{question}").replace("\n", "' || chr(10) || '") + "' AS prompt FROM benchmark",
    "t20_labels": "SELECT page_id, left(replace(split_part(regexp_replace(url, '/+$', ''), '/', -1), '_', ' '), 16) AS label FROM pages",
    "j3_grid_bands": _e(_BANDS) + "SELECT unit, band, x, y, h, text_preview FROM gb",
    "j5_similar_pairs": _e(_PAIRS) + "SELECT unit, i, j, similarity FROM sm",
    "j11_rewired_links": f"WITH {_LINKS}, {_SLUGS}, u AS (SELECT page_id, url, slug, row_number() OVER (PARTITION BY slug ORDER BY page_id) AS n FROM sl), en AS (SELECT {_HOST.format('url')} AS key, min(CASE WHEN n = 1 THEN slug ELSE slug || '_' || n END) AS s FROM u GROUP BY 1) SELECT page_id, seq, coalesce(s || '::page', 'ext::' || {_HOST.format('href')}) AS dst, s IS NOT NULL AS resolved FROM links LEFT JOIN en ON en.key = {_HOST.format('href')}",
    "j12_rewired_wiki": "SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'conv_' || conv_id || '::page' ELSE 'ext::https://en.wikipedia.org/wiki/conv%5F' || conv_id || '#a' END AS dst FROM conversations WHERE turn <= 1",
    "j13_frontier": _e(HEADINGS, _UNITS, _CHAIN, "ce AS (SELECT sp.unit || '__sec' || section || '::page' AS page, sp.unit || '::' || seq AS el FROM sp JOIN ph ON ph.unit = sp.unit WHERE sp.unit IN (SELECT unit FROM su GROUP BY unit HAVING count(*) > 1))", recursive=True) + "SELECT DISTINCT a.el AS src, b.el AS dst FROM ce a JOIN cn ON cn.src = a.page JOIN ce b ON b.page = cn.dst",
    "j14_neighbours": _e(ROWS, "nx AS (SELECT unit, seq, lag(seq) OVER (PARTITION BY unit ORDER BY read_pos) AS b, lead(seq) OVER (PARTITION BY unit ORDER BY read_pos) AS a FROM pl)", recursive=True) + f"SELECT unit, {_tile('seq')} AS node, {_tile('b')} AS near, 0 AS side FROM nx WHERE b IS NOT NULL UNION ALL SELECT unit, {_tile('seq')}, {_tile('a')}, 1 FROM nx WHERE a IS NOT NULL",
    "j15_containing_page": _e() + f"SELECT unit, {_tile('seq')} AS node, 'page' AS page FROM e",
    "j16_supporting_sentences": f"WITH {_HOTPOT} SELECT id, title, sent_id, sentence FROM ss",
    "j22_page_links": f"WITH {_LINKS} SELECT page_id AS unit, href, min(seq) AS first_seq FROM links GROUP BY page_id, href",
    "j9_orphans_dropped": "SELECT conv_id AS page_slug, turn AS tile_id, role FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations t WHERE t.role <> 'user' AND t.conv_id = c.conv_id AND t.turn + 1 = c.turn)",
    "a9_size_means": _e("p AS (SELECT left(unit, 1) AS kind, unit, count(*) AS n, avg(w * h) AS m, sum(w * h) AS s FROM e GROUP BY unit)") + "SELECT kind, round(avg(n), 4) AS units_per_page, round(avg(m), 4) AS pixels_per_unit, round(avg(s), 4) AS pixels_per_page FROM p GROUP BY kind",
    "a12_relation_stats": _e(ROWS, _EDGES, "k AS (SELECT unit, relation, count(*) AS k FROM ed GROUP BY unit, relation)", recursive=True) + "SELECT relation, sum(k)::BIGINT AS n_edges, quantile_cont(k, 0.5)::DOUBLE AS median_per_unit FROM k GROUP BY relation",
    "w3_section_hierarchy": _e(ROWS, _PARENTS, recursive=True) + "SELECT unit, src, dst FROM par",
    "w5_sections": _e(HEADINGS) + "SELECT unit, seq, sec_idx, title FROM sec",
    "w10_continues": _e(HEADINGS, _UNITS, _CHAIN, recursive=True) + "SELECT unit, src, dst FROM cn",
    "w11_chain_order": _e(HEADINGS, _UNITS, recursive=True) + "SELECT left(unit, 3) AS kind, section_unit, row_number() OVER (PARTITION BY left(unit, 3) ORDER BY unit, section) - 1 AS place FROM su",
    "w13_positive_indices": _CONTRAST.rstrip() + ", ex AS (SELECT unit, count(*) AS k FROM neg GROUP BY unit HAVING count(*) >= 2), nb AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS i FROM ex) SELECT unit, i // 4 AS batch_no, (i % 4) * 3 AS positive_index FROM nb",
    "g3_patches": _e("p AS (SELECT unit, seq, x, y, w, h, greatest(1, ceil(h / 300.0))::INT AS n, max(y + h) OVER (PARTITION BY unit) AS ph FROM e)", "k AS (SELECT *, unnest(range(0, n))::INT AS patch FROM p)", "b AS (SELECT unit, seq, patch, x, floor(y + patch * (h / n::DOUBLE))::BIGINT AS y, w, h / n::DOUBLE AS slice, ph FROM k)") + "SELECT unit, seq, patch, x, y, w, floor(least(slice, ph - y))::BIGINT AS h FROM b WHERE floor(least(slice, ph - y)) > 0 AND w > 0",
    "g5_semantic_neighbours": _e(_PAIRS, _GREEDY, recursive=True) + "SELECT gk.unit, k.i AS i, k.j AS j, similarity FROM gk JOIN sm ON sm.unit = gk.unit AND sm.i = k.i AND sm.j = k.j",
    "g6_split_sections": _e(HEADINGS, _SPLIT, recursive=True) + "SELECT unit, seq, section, section_title FROM sp",
    "g8_edges": _e(ROWS, _EDGES, recursive=True) + "SELECT unit, src, dst, relation, direction FROM ed",
    "g9_section_units": _e(HEADINGS, _UNITS, recursive=True) + "SELECT unit, section_unit, section, section_title, url_suffix, top, height, n_elements FROM su",
    "g11_corpus_edges": f"""WITH {_LINKS}, el AS ({_html()}), en AS (SELECT {_HOST.format('url')} AS key, min(page_id) AS page FROM pages GROUP BY 1),
      kl AS (SELECT page_id, seq, {_HOST.format('href')} AS key FROM links), tg AS (SELECT kl.page_id, page, row_number() OVER (PARTITION BY kl.page_id ORDER BY min(seq)) AS n FROM kl JOIN en ON en.key = kl.key WHERE page <> kl.page_id GROUP BY kl.page_id, page),
      cr AS (SELECT page_id AS seed, page FROM tg WHERE n <= 3), me AS (SELECT seed, page FROM cr UNION SELECT p, p FROM (SELECT page_id AS p FROM el UNION SELECT page_id FROM kl))
      SELECT 'p' || seed AS seed, 'p' || page || '::page' AS src, 'p' || page || '::el_' || seq AS dst, 'contains' AS relation FROM me JOIN el ON el.page_id = me.page
      UNION ALL SELECT 'p' || me.seed, 'p' || me.page || '::a_' || seq, CASE WHEN me.page = me.seed AND cr.page IS NOT NULL THEN 'p' || cr.page || '::page' ELSE 'ext::' || kl.key END, 'links_to' FROM me JOIN kl ON kl.page_id = me.page LEFT JOIN en ON en.key = kl.key LEFT JOIN cr ON cr.seed = me.seed AND cr.page = en.page""",
    "g12_namespaced": _e(ROWS, recursive=True) + "SELECT * FROM (SELECT unit, unit || '::' || seq AS src, unit || '::' || lead(seq) OVER (PARTITION BY unit ORDER BY read_pos) AS dst FROM pl) WHERE dst IS NOT NULL",
    "g13_controller": _CONTROLLED + "SELECT unit, step, pos, action, score, state_before, state_after FROM cl",
    "a10_coverage_rates": _CONTROLLED.rstrip() + f", {_TOP}, op AS (SELECT 'controller' AS method, unit, pos FROM cl WHERE action = 'open' UNION ALL SELECT 'static', unit, pos FROM tk WHERE rk <= {CONFIG.budget}), pc AS (SELECT method, op.unit, max((pos = positive)::INT) AS covered, count(*) AS opened FROM op JOIN q ON q.unit = op.unit GROUP BY method, op.unit) SELECT method, count(*) AS questions, round(avg((covered = 1)::INT), 4) AS full_coverage, round(avg(opened), 4) AS mean_opened FROM pc GROUP BY method",
    "g16_text_chunks": _e(_chunks("AND y < 5000")) + "SELECT unit, chunk, chunk_text FROM ck",
    "g19_multihop": _e(_MULTI) + "SELECT st.id, status, positives, CASE WHEN status = 'ok' AND al.k > pos.k THEN least(2, al.k - pos.k) ELSE -1 END::INT AS n_negatives FROM st LEFT JOIN pos ON pos.id = st.id LEFT JOIN al ON al.id = st.id",
    "g20_split": _e(HEADINGS, _UNITS, "ar AS (SELECT split_part(section_unit, '__sec', 1) AS article, count(*) AS n FROM su GROUP BY 1)", "rn AS (SELECT *, coalesce(sum(n) OVER (ORDER BY md5(article) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS al FROM ar)", recursive=True) + "SELECT article, n, CASE WHEN before < round_even(al * 0.2::DOUBLE, 0) THEN 'val' ELSE 'train' END AS split FROM rn",
    "g21_ablation": _ablation(),
    "g22_sample": "SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100",
    "g23_external_links": f"WITH {_LINKS}, f AS (SELECT page_id AS unit, seq // 2 AS s, seq AS nth, href, anchor_text FROM links), k AS (SELECT *, row_number() OVER (PARTITION BY unit, s, href ORDER BY nth) AS k, s = 1 AS used FROM f) SELECT unit, href, anchor_text, s::INT AS source_seq, used AS used_as_evidence, (row_number() OVER (PARTITION BY unit ORDER BY used DESC, s, nth) - 1)::INT AS place FROM k WHERE k.k = 1",
    "u3_model_evidence": _e(QUESTIONS, _scores(False), _TOP) + "SELECT tk.unit, string_agg(CASE WHEN length(text) > 100 THEN 'read ' || length(text) ELSE left(text, 200) END, chr(10) || chr(10) ORDER BY pos) AS evidence FROM tk JOIN e ON e.unit = tk.unit AND e.seq = tk.pos WHERE rk <= 5 GROUP BY tk.unit",
    "u4_embedded": "SELECT doc_id AS key, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
    "u9_batches_agree": "WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_transform(embedding, lambda v: (v * 1.001::FLOAT + CASE WHEN label = 3 THEN 0.05 ELSE 0 END::FLOAT)::DOUBLE) AS y FROM embeddings) SELECT vec_id, list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) >= 0.99 AS agrees FROM a",
}
