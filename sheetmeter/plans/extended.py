"""More registered queries over the driver's tables, with the SQL that has to give the same rows: boxes, texts, bands, labels, hatch bands, the model
pass's relational steps, scoring with mappings, marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetmeter import engine
from sheetmeter.functions import geometry as g
from sheetmeter.functions import text as t
from sheetmeter.operators import items, layout, legends, scoring, symbols, tiles, titleblock, vision
from sheetmeter.plans.catalogue import _DET, _TOTALS, COUNTS, SPANS, _table, _view, query
from sheetmeter.sources import drawings

_CORNERS = "SELECT event_id, CAST(event_id % 900 AS DOUBLE) AS x1, CAST(event_id % 37 AS DOUBLE) AS y1, CAST(event_id % 900 - event_id % 37 * 3 AS DOUBLE) AS x2, CAST(event_id % 37 + 20 AS DOUBLE) AS y2 FROM events"


@query(f"""WITH c AS ({_CORNERS}), b AS (SELECT event_id, least(x1, x2) AS x, least(y1, y2) AS y, abs(x2 - x1) AS w, abs(y2 - y1) AS h FROM c)
SELECT event_id, x, y, w, h, x - 5 AS ex, y - 2 AS ey, w + 10 AS ew, h + 4 AS eh, greatest(0.0, x)::DOUBLE AS cx, greatest(0.0, least(500.0, x + w) - greatest(0.0, x))::DOUBLE AS cw, greatest(0.0, least(40.0, y + h) - greatest(0.0, y))::DOUBLE AS ch,
  x * 2.5 AS sx, h * 2.5 AS sh, 800 - y - h AS py, least(x + w / 2 - 100 * 0.36, 1124 * 0.36 - (x + w / 2), y + h / 2, 1024 * 0.36 - (y + h / 2))::DOUBLE AS edge FROM b""")
def box_arithmetic(spark, d):
    """Corners to boxes; grown, clamped, scaled; in page space; distance to a tile's edge."""
    c = [F.col(k) for k in ("x1", "y1", "x2", "y2")]
    b = _view(spark, d, _CORNERS).select("event_id", g.from_corners(*c).alias("b")).select("event_id", "b.*")
    e, k, s, p = g.expand("", F.lit(5.0), F.lit(2.0)), g.clamp_to_page("", F.lit(500.0), F.lit(40.0)), g.scale_box("", 2.5), g.pdf_box(F.lit(800.0))
    edge = g.edge_margin(F.lit(100), F.lit(0), F.lit(1024), F.lit(1024), F.lit(200))
    return b.select("event_id", "x", "y", "w", "h", e["x"].alias("ex"), e["y"].alias("ey"), e["w"].alias("ew"), e["h"].alias("eh"), k["x"].alias("cx"), k["w"].alias("cw"), k["h"].alias("ch"), s["x"].alias("sx"), s["h"].alias("sh"), p["y"].alias("py"), edge.alias("edge"))


_SAID = """SELECT event_id, CASE event_id % 12 WHEN 0 THEN 'Legend' WHEN 1 THEN 'Key to  symbols:' WHEN 2 THEN 'LIGHTING LEGEND' WHEN 3 THEN 'legendary' WHEN 4 THEN 'General notes' WHEN 5 THEN 'Drawing title'
  WHEN 6 THEN 'Mounting height' WHEN 7 THEN 'Cat. no' WHEN 8 THEN 'type' WHEN 9 THEN 'typed' WHEN 10 THEN concat('Dwg no: E-', event_id) ELSE concat('Title  Level ', event_id % 7) END AS said FROM events"""
_SAID_N = "upper(trim(regexp_replace(said, '\\s+', ' ', 'g')))"
_Q = lambda p: p.replace("'", "''")


@query(f"""WITH s AS ({_SAID}), n AS (SELECT event_id, {_SAID_N} AS n FROM s)
SELECT event_id, regexp_matches(n, '{_Q(t.HEADING)}') AS heading, regexp_matches(n, '{_Q(t.STOP_HEADING)}') AS stop, regexp_matches(n, '{_Q(t.COLUMN)}') AS column_title,
  nullif(regexp_extract(n, '{_Q(t.DRAWING_NO)}', 1), '') AS number, nullif(regexp_extract(n, '{_Q(t.TITLE)}', 1), '') AS title FROM n""")
def heading_words(spark, d):
    n = t.normalise("said")
    part = lambda p: F.when(F.regexp_extract(n, p, 1) != "", F.regexp_extract(n, p, 1))
    return _view(spark, d, _SAID).select("event_id", t.is_heading(n).alias("heading"), t.is_stop_heading(n).alias("stop"), t.is_column_title(n).alias("column_title"), part(t.DRAWING_NO).alias("number"), part(t.TITLE).alias("title"))


_BILLED = """SELECT p_partkey, p_name AS description, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS tag, CASE p_partkey % 6 WHEN 0 THEN 'vector' WHEN 1 THEN 'symbol' WHEN 2 THEN 'vision' WHEN 3 THEN 'mixed' WHEN 4 THEN 'none' ELSE 'file' END AS source,
  p_partkey % 4 AS needs_review FROM part"""


@query(f"""WITH b AS ({_BILLED}) SELECT p_partkey, CASE WHEN tag IS NULL THEN description ELSE description || ' (type ' || tag || ')' END AS text,
CASE source WHEN 'vector' THEN 'tag printed on the drawing' WHEN 'symbol' THEN 'glyph geometry matched' WHEN 'vision' THEN 'seen by the model' WHEN 'mixed' THEN 'several methods' WHEN 'none' THEN 'not found' ELSE source END
  || CASE WHEN needs_review > 0 THEN '; check ' || needs_review ELSE '' END AS basis FROM b""")
def bill_texts(spark, d):
    return _view(spark, d, _BILLED).select("p_partkey", t.bill_text(F.col("description"), F.col("tag")).alias("text"), t.bill_basis(F.col("source"), F.col("needs_review")).alias("basis"))


@query("""WITH e AS (SELECT event_id, repeat(' ', (event_id % 3)::INTEGER) || CASE event_id % 4 WHEN 0 THEN 'a  1' WHEN 1 THEN 'toolongtag' WHEN 2 THEN '' ELSE event_type END AS said FROM events), n AS (SELECT event_id, upper(trim(regexp_replace(said, '\\s+', ' ', 'g'))) AS n FROM e)
SELECT event_id, CASE WHEN length(n) BETWEEN 1 AND 6 THEN n END AS tag FROM n""")
def model_tags(spark, d):
    said = F.expr("concat(repeat(' ', cast(event_id % 3 AS int)), CASE event_id % 4 WHEN 0 THEN 'a  1' WHEN 1 THEN 'toolongtag' WHEN 2 THEN '' ELSE event_type END)")
    return _table(spark, d, "events").select("event_id", t.model_tag(said).alias("tag"))


@query(r"""SELECT page_id, left(regexp_replace('error at projects/' || page_id || '/models: ' || url || ' projects/x y', 'projects/[^/\s"'']+', 'projects/<redacted>', 'g'), 300) AS message FROM pages""")
def redacted_errors(spark, d):
    said = F.concat(F.lit("error at projects/"), F.col("page_id").cast("string"), F.lit("/models: "), F.col("url"), F.lit(" projects/x y"))
    return _table(spark, d, "pages").select("page_id", t.redacted(said).alias("message"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'a' || event_id || 'b' WHEN 1 THEN 'only ' || event_id END AS answer FROM events")
def json_answer(spark, d):
    """The model's answer out of its response: thoughts left out, null for none."""
    part = lambda text, thought=False: '{"text":"' + text + '"' + (',"thought":true' if thought else "") + "}"
    of = lambda *parts: F.format_string('{"candidates":[{"content":{"parts":[' + ",".join(parts) + "]}}]}", "event_id")
    k = F.col("event_id") % 5
    response = F.when(k == 0, of(part("hm", True), part("a%d"), part("b"))).when(k == 1, of(part("only %d"))).when(k == 2, '{"candidates":[]}').when(k == 3, "no json").otherwise(of(part("t%d", True)))
    return _table(spark, d, "events").select("event_id", t.model_answer(response).alias("answer"))


@query("""SELECT event_id, 'I' || (event_id % 4) AS item_id, CASE event_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence, (event_id % 300)::DOUBLE AS xmin FROM events WHERE event_id % 4 < 3""")
def model_detections(spark, d):
    """Detections of known items out of a model's answers, confidences held between 0 and 1."""
    known = spark.createDataFrame([("I0",), ("I1",), ("I2",)], "item_id string")
    e = F.col("event_id")
    c = F.when(e % 3 == 0, "0.5").when(e % 3 == 1, "1.7").otherwise("null")
    answer = F.format_string('{"d":[{"t":"I%d","b":[%d,%d,%d,%d],"c":%s},{"t":"Z","b":[0,0,9,9],"c":1}]}', e % 4, e % 500, e % 300, e % 500 + 40, e % 300 + 60, c)
    return tiles.detections_of(_table(spark, d, "events").select("event_id", answer.alias("answer")), known).select("event_id", "item_id", "confidence", F.get("raw", F.lit(1)).alias("xmin"))


_ROWS = "SELECT user_id, event_id AS id, CAST(event_id % 4000 AS DOUBLE) AS top, CAST(event_id % 4000 + 12 AS DOUBLE) AS bottom FROM events WHERE event_id % 3 = 0"
_MARKS = "SELECT user_id, event_id AS mark, event_id AS seq, concat('t', event_id) AS str, CAST((event_id * 7) % 4000 AS DOUBLE) AS at FROM events WHERE event_id % 3 = 1"
_BAND = f"WITH r AS ({_ROWS}), m AS ({_MARKS}), j AS (SELECT r.user_id, r.id, m.*, abs(m.at - (r.top + r.bottom) / 2) AS dist FROM r JOIN m ON m.user_id = r.user_id AND m.at BETWEEN r.top - 20 AND r.bottom + 20) "


@query(_BAND + "SELECT user_id, id, mark FROM j QUALIFY row_number() OVER (PARTITION BY user_id, id ORDER BY dist, mark) = 1")
def band_marks(spark, d):
    """The mark nearest to the middle of each row, within a band around it."""
    return layout.band_nearest(_view(spark, d, _ROWS), _view(spark, d, _MARKS), ["user_id"], 20.0)


@query(_BAND + "SELECT user_id, id, string_agg(str, ' ' ORDER BY seq) AS text FROM j GROUP BY user_id, id")
def band_references(spark, d):
    """All texts within a band around each row, in order."""
    return layout.band_texts(_view(spark, d, _ROWS), _view(spark, d, _MARKS), ["user_id"], 20.0)


_NOTED = """SELECT CAST(o_custkey % 7 AS STRING) AS drawing_id, o_custkey AS page, o_orderkey AS seq, CASE o_orderkey % 4 WHEN 0 THEN 'Drawing no' WHEN 1 THEN 'REV' ELSE concat(' V', o_orderkey, ' ') END AS str,
  CAST(o_orderkey * 37 % 90 AS DOUBLE) AS x, CAST(o_orderkey * 11 % 40 AS DOUBLE) AS y, CAST(10 AS DOUBLE) AS w, CAST(8 AS DOUBLE) AS h, CAST(8 AS DOUBLE) AS font_size FROM orders"""


@query(f"""WITH s AS ({_NOTED}), l AS (SELECT * FROM s WHERE str = 'Drawing no'),
j AS (SELECT l.drawing_id, l.page, l.seq, v.str, v.seq AS vs, v.x AS vx, v.y AS vy, v.str IN ('REV', 'Drawing no') AS label, abs(v.y + v.h / 2 - (l.y + l.h / 2)) < l.h AND v.x > l.x + l.w - 1 AND v.x - (l.x + l.w) < l.h * 30 AS beside,
  v.y > l.y + l.h / 2 AND v.y - (l.y + l.h) < l.h * 2 AND abs(v.x - l.x) < l.h * 4 AS below FROM l JOIN s v ON v.drawing_id = l.drawing_id AND v.page = l.page AND v.seq <> l.seq),
a AS (SELECT drawing_id, page, seq, label, str FROM j WHERE beside QUALIFY row_number() OVER (PARTITION BY drawing_id, page, seq ORDER BY vx, vs) = 1),
b AS (SELECT drawing_id, page, seq, label, str FROM j WHERE below QUALIFY row_number() OVER (PARTITION BY drawing_id, page, seq ORDER BY vy, vs) = 1)
SELECT l.drawing_id, l.page, l.seq, coalesce(CASE WHEN NOT a.label THEN trim(a.str) END, CASE WHEN NOT b.label THEN trim(b.str) END) AS value FROM l LEFT JOIN a USING (drawing_id, page, seq) LEFT JOIN b USING (drawing_id, page, seq)
WHERE coalesce(CASE WHEN NOT a.label THEN a.str END, CASE WHEN NOT b.label THEN b.str END) IS NOT NULL""")
def label_values(spark, d):
    """The value of each label: the nearest to the right on its line, else the nearest below, unless that is a label too."""
    s = _view(spark, d, _NOTED).withColumn("n", t.normalise("str"))
    return titleblock.values_near(s.where("n = 'DRAWING NO'"), s)


_LINES = "SELECT user_id, event_id, event_id % 5000 AS place, event_type FROM events"


@query(f"""WITH e AS ({_LINES}), o AS (SELECT *, event_type = 'error' OR coalesce(event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) > 300, false) AS over_, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM e),
k AS (SELECT *, max(over_::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS ended FROM o)
SELECT user_id, event_id, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS row_id FROM k WHERE ended = 0""")
def table_rows(spark, d):
    """Rows of lines that lie close together, up to where the table ends: at a wide gap or a line that stops it."""
    return layout.gap_rows(_view(spark, d, _LINES), ["user_id"], ["event_id"], "event_id", 50, 300, F.col("event_type") == "error").select("user_id", "event_id", "row_id")


@query("""WITH g AS (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events), l AS (SELECT user_id, list_sort(list(gap)) AS v FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT user_id, v[len(v) // 2 + 1] AS pitch FROM l""")
def row_pitch(spark, d):
    return layout.pitch_of(_table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id")


_BANDS = """SELECT CAST(event_id % 3 AS STRING) AS drawing_id, CAST(event_id / 150 AS INT) AS page, CAST(event_id % 150 / 3 AS INT) AS index, CAST(0 AS DOUBLE) AS x, CAST(event_id % 150 / 3 AS INT) + CASE WHEN event_id % 11 = 0 THEN 5.0 ELSE 0.0 END AS y,
  CAST(10 AS DOUBLE) AS w, CASE WHEN event_id % 8 = 0 THEN 2.0 ELSE 1.0 END AS h, event_id % 13 > 0 AS fill, event_id % 17 = 0 AS stroke, CAST(1 AS DOUBLE) AS line_width FROM events"""
_BANDS_SQL = _BANDS.replace("CAST(event_id / 150 AS INT)", "(event_id // 150)::INTEGER").replace("CAST(event_id % 150 / 3 AS INT)", "((event_id % 150) // 3)::INTEGER").replace("AS index", "AS idx")


@query(f"""WITH p AS ({_BANDS_SQL}), q AS (SELECT *, fill AND least(w, h) < 1.5 AS band FROM p),
r AS (SELECT *, lag(band) OVER o AS was, lag(idx) OVER o AS pi, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(w) OVER o AS pw, lag(h) OVER o AS ph FROM q WINDOW o AS (PARTITION BY drawing_id, page ORDER BY idx)),
s AS (SELECT *, sum(CASE WHEN coalesce(band AND was AND idx = pi + 1 AND px <= x + w + 0.6 AND x <= px + pw + 0.6 AND py <= y + h + 0.6 AND y <= py + ph + 0.6, false) THEN 0 ELSE 1 END) OVER (PARTITION BY drawing_id, page ORDER BY idx) AS run FROM r),
n AS (SELECT *, count(*) OVER (PARTITION BY drawing_id, page, run) AS n, min(idx) OVER (PARTITION BY drawing_id, page, run) AS first_, min(y) OVER (PARTITION BY drawing_id, page, run) AS y1, max(y + h) OVER (PARTITION BY drawing_id, page, run) AS y2 FROM s)
SELECT drawing_id, page, idx AS index, CASE WHEN n >= 3 THEN y1 ELSE y END::DOUBLE AS y, CASE WHEN n >= 3 THEN y2 - y1 ELSE h END::DOUBLE AS h, CASE WHEN n >= 3 THEN false ELSE stroke END AS stroke FROM n WHERE n < 3 OR idx = first_""")
def hatch_boxes(spark, d):
    """Runs of thin filled bands that touch become one box."""
    p = _view(spark, d, _BANDS).withColumn("subpaths", F.array(F.struct(F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y"))).alias("points"), F.lit(True).alias("closed"), F.lit(0).alias("curves"))))
    p = p.select("drawing_id", "page", "index", F.col("subpaths").cast(symbols.SUBPATHS).alias("subpaths"), "x", F.col("y").cast("double").alias("y"), "w", F.col("h").cast("double").alias("h"), "fill", "stroke", "line_width")
    return symbols.merge_hatch_bands(p).select("drawing_id", "page", "index", "y", "h", "stroke")


_GLYPHS = "SELECT CAST(p_size AS STRING) AS drawing_id, 1 AS page, p_partkey AS index, CAST(p_partkey * 37 % 300 AS DOUBLE) AS x, CAST(p_partkey * 61 % 300 AS DOUBLE) AS y, CAST(p_partkey % 40 AS DOUBLE) AS w, CASE WHEN p_partkey % 3 = 0 THEN 0.2 ELSE 6.0 END AS h, p_partkey % 2 = 0 AS straight FROM part"
_CELLS = "SELECT CAST(s_suppkey % 50 + 1 AS STRING) AS drawing_id, 1 AS page, s_suppkey AS item_seq, CAST(s_suppkey * 13 % 250 AS DOUBLE) AS x, CAST(s_suppkey * 29 % 250 AS DOUBLE) AS y, CAST(30 AS DOUBLE) AS w, CAST(25 AS DOUBLE) AS h FROM supplier"


@query(f"""WITH e AS ({_GLYPHS}), c AS ({_CELLS}) SELECT c.drawing_id, c.item_seq, count(*) AS n, sum(e.index)::BIGINT AS indexes FROM c JOIN e ON e.drawing_id = c.drawing_id AND e.page = c.page
  AND e.x + e.w / 2 BETWEEN c.x AND c.x + c.w AND e.y + e.h / 2 BETWEEN c.y AND c.y + c.h AND greatest(e.w, e.h) <= 30 * 1.05 AND NOT (e.straight AND (e.w >= 27 AND e.h < 0.5 OR e.h >= 22.5 AND e.w < 0.5)) GROUP BY 1, 2""")
def glyph_cells(spark, d):
    """The shapes that draw the glyph in a legend's symbol cell: centred in it, no larger, no rule across it."""
    e = _view(spark, d, _GLYPHS).withColumn("h", F.col("h").cast("double"))
    c = _view(spark, d, _CELLS).select("drawing_id", "page", "item_seq", F.struct(*"xywh").alias("symbol_box"))
    return symbols.glyphs(e, c).groupBy("drawing_id", "item_seq").agg(F.count("*").alias("n"), F.sum("e.index").cast("long").alias("indexes"))


_SIGHTINGS = """SELECT p_partkey AS id, CAST(p_size AS STRING) AS drawing_id, 1 AS page, concat('I', p_partkey % 5) AS item_id, CAST(p_partkey * 37 % 997 AS DOUBLE) AS x, CAST(p_partkey * 61 % 991 AS DOUBLE) AS y, CAST(6 + p_partkey % 5 AS DOUBLE) AS w, CAST(8 AS DOUBLE) AS h,
  CASE WHEN p_partkey % 9 = 0 THEN 0.5 ELSE 0.9 END AS confidence, CASE WHEN p_partkey % 4 = 0 THEN 'symbol' ELSE 'vision' END AS source, p_partkey % 20 = 0 AS needs_review FROM part"""
_DOUBT = f"""WITH s AS ({_SIGHTINGS}), v AS (SELECT * FROM s WHERE source = 'vision'),
q AS (SELECT id, drawing_id, page FROM v WHERE confidence < 0.75 OR needs_review OR NOT EXISTS (SELECT 1 FROM s o WHERE o.drawing_id = v.drawing_id AND o.page = v.page AND o.id <> v.id
  AND sqrt((o.x + o.w / 2 - v.x - v.w / 2) * (o.x + o.w / 2 - v.x - v.w / 2) + (o.y + o.h / 2 - v.y - v.h / 2) * (o.y + o.h / 2 - v.y - v.h / 2)) < 6 * (v.w + v.h) / 2)) """


@query(_DOUBT + "SELECT id, drawing_id, page FROM q")
def doubtful_sightings(spark, d):
    """Detections of the model that deserve a second look: unsure, flagged, or alone."""
    return vision.doubtful(_view(spark, d, _SIGHTINGS)).select("id", "drawing_id", "page")


@query(_DOUBT + ", n AS (SELECT *, row_number() OVER (PARTITION BY drawing_id, page ORDER BY id) - 1 AS k FROM q) SELECT id, drawing_id, page, (k // 12)::BIGINT AS batch, (k % 12 + 1)::BIGINT AS index FROM n")
def verify_batches(spark, d):
    return vision.batched(vision.doubtful(_view(spark, d, _SIGHTINGS))).select("id", "drawing_id", "page", "batch", "index")


_LOOKED = """SELECT s.*, CASE id % 5 WHEN 0 THEN item_id WHEN 1 THEN 'none' WHEN 2 THEN 'I1' WHEN 3 THEN 'unknown' END AS item, CASE WHEN id % 2 = 0 THEN 0.95 ELSE 0.7 END AS c FROM s"""


@query(f"""WITH s AS ({_SIGHTINGS}), l AS ({_LOOKED}) SELECT id, CASE WHEN item IN ('I0', 'I1', 'I2', 'I3', 'I4') AND c >= 0.8 THEN item ELSE item_id END AS item_id,
CASE WHEN item = item_id THEN greatest(confidence, c) WHEN item IN ('I0', 'I1', 'I2', 'I3', 'I4') AND c >= 0.8 THEN c ELSE confidence END::DOUBLE AS confidence,
CASE WHEN item IS NULL THEN needs_review WHEN item = item_id THEN CASE WHEN c >= 0.9 THEN false ELSE needs_review END ELSE true END AS needs_review FROM l WHERE NOT coalesce(item = 'none' AND c >= 0.8, false)""")
def second_looks(spark, d):
    """Detections after the model has looked again: agreed, dropped, reclassified or flagged."""
    s = _view(spark, d, _SIGHTINGS).withColumn("confidence", F.col("confidence").cast("double"))
    item = F.expr("CASE id % 5 WHEN 0 THEN item_id WHEN 1 THEN 'none' WHEN 2 THEN 'I1' WHEN 3 THEN 'unknown' END")
    looked = s.select("id", item.alias("item"), F.when(F.col("id") % 2 == 0, 0.95).otherwise(0.7).alias("confidence"))
    return tiles.second_look(s, looked, s.select("item_id").distinct()).select("id", "item_id", "confidence", "needs_review")


_PAGES = "SELECT l_suppkey AS drawing_id, l_linenumber AS page FROM lineitem GROUP BY l_suppkey, l_linenumber"
_DRAWN = "SELECT l_suppkey AS drawing_id, l_linenumber AS page FROM lineitem WHERE l_returnflag <> 'N'"
_ASKED = "SELECT s_suppkey AS drawing_id, concat('I', p_size) AS item_id, p_size AS item_seq FROM supplier JOIN part ON p_partkey = s_suppkey"
_HIT = "SELECT l_suppkey AS drawing_id, concat('I', l_linenumber) AS item_id FROM lineitem WHERE l_quantity > 40"


@query(f"WITH p AS ({_PAGES}), n AS (SELECT p.drawing_id, p.page, count(d.page) AS n FROM p LEFT JOIN ({_DRAWN}) d USING (drawing_id, page) GROUP BY 1, 2) SELECT drawing_id, bool_or(n < 50) AS raster FROM n GROUP BY 1")
def raster_drawings(spark, d):
    return items.raster_drawings(_view(spark, d, _DRAWN), _view(spark, d, _PAGES))


@query(f"""WITH p AS ({_PAGES}), n AS (SELECT p.drawing_id, p.page, count(d.page) AS n FROM p LEFT JOIN ({_DRAWN}) d USING (drawing_id, page) GROUP BY 1, 2), r AS (SELECT drawing_id, bool_or(n < 50) AS raster FROM n GROUP BY 1),
i AS ({_ASKED}), h AS ({_HIT}) SELECT i.drawing_id, i.item_id FROM i LEFT JOIN r USING (drawing_id) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.drawing_id = i.drawing_id AND h.item_id = i.item_id) AND (raster OR item_seq % 3 = 0 OR item_seq % 2 = 0)""")
def vision_fallback(spark, d):
    """Items that a model is asked for: no hit, and a scanned drawing, no signature, or an anchor that was seen."""
    i = _view(spark, d, _ASKED).withColumn("signature", F.when(F.col("item_seq") % 3 != 0, F.lit(1)))
    seen = i.where("item_seq % 2 = 0").select("drawing_id", "item_id", F.lit(1).alias("anchors"))
    return engine.vision_items(i, _view(spark, d, _HIT), _view(spark, d, _DRAWN), _view(spark, d, _PAGES), seen, "auto", False).select("drawing_id", "item_id")


_MAPPED = """SELECT concat('S', n_nationkey % 5) AS "set", k.key AS key, CAST(k.truth AS BIGINT) AS truth, CAST(NULL AS STRING) AS description, k.a AS a, k.b AS b
  FROM nation CROSS JOIN (VALUES ('lamps', 3400, 't2', 'line 3'), ('rest', 900, 'nothing', 'T4'), ('none', 5, 'zzz', 'zzz')) AS k(key, truth, a, b) WHERE n_nationkey < 5"""


@query(_TOTALS.split("tr AS (")[0] + f"""tr AS ({_MAPPED}), byd AS (SELECT "set", upper(description) AS d, max_by(key, entered) AS k FROM tot GROUP BY ALL),
w AS (SELECT "set", key, truth, upper(a) AS n FROM tr UNION SELECT "set", key, truth, upper(b) FROM tr),
m AS (SELECT DISTINCT w."set", w.key, w.truth, coalesce(t1.key, b1.k) AS match_key FROM w LEFT JOIN tot t1 ON t1."set" = w."set" AND t1.key = w.n LEFT JOIN byd b1 ON b1."set" = w."set" AND b1.d = w.n),
s AS (SELECT m."set", m.key, m.truth, coalesce(sum(tot.count), 0)::BIGINT AS predicted, count(tot.count) > 0 AS matched FROM m LEFT JOIN tot ON tot."set" = m."set" AND tot.key = m.match_key GROUP BY 1, 2, 3)
SELECT "set", key, truth, predicted, abs(predicted - truth) AS abs_error, matched FROM s""")
def score_mapping(spark, d):
    """Truth lines that name the totals they take, by key or by description."""
    tr = _view(spark, d, _MAPPED).withColumn("mapping", F.array("a", "b")).drop("a", "b")
    totals = scoring.engine_totals(_view(spark, d, COUNTS))
    return scoring.score_items(scoring.resolve(tr, totals), totals).select("set", "key", "truth", "predicted", "abs_error", "matched")


@query("""WITH s AS (SELECT o_custkey % 50 AS "set", (o_custkey % 50) % 7 = 0 AS failed, bool_and(o_orderstatus <> 'P') AS strict_pass, bool_or(o_orderstatus = 'F') AS weighted_pass, CASE WHEN (o_custkey % 50) % 7 = 0 THEN 1.0 ELSE 0.25 END::DOUBLE AS weighted_error FROM orders WHERE o_orderkey % 40 = 0 GROUP BY 1, 2)
SELECT count(*) AS sets, count(*) FILTER (strict_pass AND NOT failed) AS strict, count(*) FILTER (weighted_pass AND NOT failed) AS weighted, avg(weighted_error) AS mean_error, count(*) FILTER (failed) AS failed FROM s""")
def summary_with_failures(spark, d):
    """Passes over the sets that ran, means over all sets."""
    o = _table(spark, d, "orders").where("o_orderkey % 40 = 0").withColumn("set", F.col("o_custkey") % 50)
    s = o.groupBy("set").agg(F.bool_and(F.col("o_orderstatus") != "P").alias("strict_pass"), F.bool_or(F.col("o_orderstatus") == "F").alias("weighted_pass")).withColumn("failed", F.col("set") % 7 == 0)
    return scoring.summary(s.withColumn("weighted_error", F.when(F.col("failed"), 1.0).otherwise(0.25)))


@query("""WITH u AS (SELECT conv_id, turn, length(text) AS a, turn AS b, 0 AS c, turn % 3 = 0 AS cached, CASE WHEN turn % 4 = 0 THEN 'none' ELSE role END AS model, conv_id * 1000 + turn AS place FROM conversations)
SELECT count(*) AS calls, sum(a)::BIGINT AS tokens_in, sum(b)::BIGINT AS tokens_out, 0::BIGINT AS tokens_thought, count(*) FILTER (cached) AS cached_calls, (SELECT model FROM u WHERE model <> 'none' ORDER BY place DESC, model LIMIT 1) AS model,
  (sum(a)::BIGINT * 1.5 + sum(b)::BIGINT * 7.5)::DOUBLE / 1e6 AS cost_usd FROM u""")
def usage_by_model(spark, d):
    """Usage with cached calls and the last model that is not none."""
    c = _table(spark, d, "conversations")
    model = F.when(F.col("turn") % 4 == 0, "none").otherwise(F.col("role"))
    return scoring.usage(c.select(F.length("text").alias("tokens_in"), F.col("turn").alias("tokens_out"), F.lit(0).alias("tokens_thought"), (F.col("turn") % 3 == 0).alias("cached"), model.alias("model"), (F.col("conv_id") * 1000 + F.col("turn")).alias("place")))


@query(f"""WITH d AS ({_DET}) SELECT CASE WHEN needs_review THEN 'review' ELSE source END AS colour, CASE WHEN multiplier > 1 THEN item_id || ' x' || multiplier ELSE item_id END AS label, count(*) AS n FROM d GROUP BY ALL""")
def mark_labels(spark, d):
    """Labels and colours of the marks that detections make on a drawing."""
    zero = [F.lit(0.0).alias(c) for c in "xywh"]
    seen = _view(spark, d, _DET).select("*", F.lit("d").alias("drawing_id"), *zero)
    return engine.marks(seen).groupBy("colour", "label").agg(F.count("*").alias("n"))


@query(f"""WITH d AS ({_DET}), b AS (SELECT item_id, min(CASE source WHEN 'vector' THEN 0 WHEN 'symbol' THEN 1 ELSE 2 END) AS best FROM d GROUP BY 1)
SELECT item_id, sum(multiplier)::BIGINT AS count FROM d JOIN b USING (item_id) WHERE CASE source WHEN 'vector' THEN 0 WHEN 'symbol' THEN 1 ELSE 2 END = best GROUP BY 1""")
def best_source_counts(spark, d):
    """With a cross check an item's count is that of its best source: tags before symbols before the model."""
    seen = _view(spark, d, _DET).withColumn("drawing_id", F.lit("d"))
    return engine.counted(seen).groupBy("item_id").agg(F.sum("multiplier").cast("long").alias("count"))


@query(f"""WITH s AS ({SPANS}), l AS (SELECT drawing_id, page, list_sort(list({{'y': y, 'x': x, 'seq': seq, 'cy': y + h / 2, 'h': h}})) AS a FROM s GROUP BY ALL),
f AS (SELECT drawing_id, page, list_reduce(list_transform(a, lambda e: [{{'first': e.cy, 'h': e.h, 'line': 0, 'x': e.x, 'seq': e.seq}}]),
  lambda acc, e: list_concat(acc, [CASE WHEN abs(acc[-1].first - e[1].first) <= e[1].h * 0.6 THEN {{'first': acc[-1].first, 'h': e[1].h, 'line': acc[-1].line, 'x': e[1].x, 'seq': e[1].seq}} ELSE {{'first': e[1].first, 'h': e[1].h, 'line': acc[-1].line + 1, 'x': e[1].x, 'seq': e[1].seq}} END])) AS m FROM l),
u AS (SELECT drawing_id, page, unnest(m) AS m FROM f)
SELECT drawing_id, page, m.line::INTEGER AS line, m.seq::BIGINT AS seq, row_number() OVER (PARTITION BY drawing_id, page, m.line ORDER BY m.x, m.seq)::INTEGER AS place FROM u""")
def line_words(spark, d):
    """Which line of the page each span stands on, and its place in it."""
    return layout.line_members(_view(spark, d, SPANS))


@query("SELECT event_id, 100 + event_id % 4000 AS width, 50 + event_id % 70000 AS height FROM events")
def png_sizes(spark, d):
    """Width and height out of PNG headers."""
    head = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex(100 + F.col("event_id") % 4000), 8, "0"), F.lpad(F.hex(50 + F.col("event_id") % 70000), 8, "0"))
    e = _table(spark, d, "events").select("event_id", drawings.png_size(F.unhex(head)).alias("s"))
    return e.select("event_id", F.col("s.width").cast("long").alias("width"), F.col("s.height").cast("long").alias("height"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}') THEN true ELSE false END AS address, regexp_matches(text, 'AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|xox[abp]-[0-9A-Za-z-]{10,}|-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----') AS key_shaped FROM documents
WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}') OR regexp_matches(text, 'AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|xox[abp]-[0-9A-Za-z-]{10,}|-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----')""")
def policy_kinds(spark, d):
    """Texts that hold an e-mail address or a string shaped like a key."""
    x = _table(spark, d, "documents").select("doc_id", t.holds_address("text").alias("address"), t.holds_key("text").alias("key_shaped"))
    return x.where("address or key_shaped")


_SHEETS = "SELECT CAST(p_size % 6 AS STRING) AS drawing_id, CAST(p_size AS INT) AS page, 0 AS legend, p_partkey AS item_seq, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS tag, p_type AS description FROM part"


@query(f"""WITH e AS ({_SHEETS}), f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY drawing_id, coalesce(tag, 'desc:' || description) ORDER BY page, item_seq) = 1)
SELECT drawing_id, coalesce(tag, 'L' || row_number() OVER (PARTITION BY drawing_id, tag IS NULL ORDER BY page, item_seq)) AS id, page, item_seq FROM f""")
def drawing_legends(spark, d):
    """The legend entries of each drawing merged: the first of each tag or description, untagged ones numbered."""
    return legends.legend_items(_view(spark, d, _SHEETS)).select("drawing_id", "id", "page", "item_seq")
