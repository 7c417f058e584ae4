"""The registered queries over the driver's tables, and the SQL that has to give the same rows.

The driver's tables hold no drawings, so views shaped like drawings are derived from them by arithmetic that is the same in
both dialects. A page is an order, so that pages grow in number with the data, not in size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetmeter.functions import geometry as g
from sheetmeter.functions import text as t
from sheetmeter.operators import items, layout, scoring, tags, tiles

SPANS = """SELECT l_suppkey % 3 AS drawing_id, l_orderkey AS page, l_linenumber AS seq, l_partkey, l_linenumber,
  CAST(l_partkey * 37 % 60 AS DOUBLE) AS x, CAST((l_partkey * 11 + l_linenumber * 17) % 40 AS DOUBLE) AS y,
  CAST(l_quantity AS DOUBLE) AS w, CAST(8 AS DOUBLE) AS h, CAST(l_linenumber % 4 + 1 AS DOUBLE) AS font_size,
  CASE l_linenumber % 4 WHEN 0 THEN concat(l_returnflag, l_linestatus) WHEN 1 THEN concat('12 NO. ', l_returnflag, l_linestatus)
    WHEN 2 THEN concat(' ', lower(l_returnflag), l_linestatus, '  x12') ELSE concat('12', l_returnflag, l_linestatus) END AS str FROM lineitem"""
BOXES = """SELECT o_custkey % 3 AS drawing_id, o_orderkey AS page, CAST(o_custkey % 40 AS DOUBLE) AS x, CAST(o_custkey * 7 % 30 AS DOUBLE) AS y,
  CAST(20 AS DOUBLE) AS w, CAST(15 AS DOUBLE) AS h FROM orders"""
TAGS = "SELECT DISTINCT concat(l_returnflag, l_linestatus) AS tag FROM lineitem"
COUNTS = """SELECT concat('S', s_nationkey % 5) AS "set", l_suppkey AS drawing_id, concat('B', l_linenumber) AS item_id,
  CASE WHEN l_linenumber % 2 = 0 THEN concat('T', l_linenumber) END AS tag, concat('line ', l_linenumber) AS description, count(*) AS count
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, l_suppkey, l_linenumber"""
TRUTH = """SELECT concat('S', n_nationkey % 5) AS "set", k.key AS key, CAST(k.truth AS BIGINT) AS truth, k.description AS description
  FROM nation CROSS JOIN (VALUES ('t2', 1700, NULL), ('B1', 1750, NULL), ('Line 3', 1600, NULL), ('other', 0, NULL), ('named', 1500, 'line  5')) AS k(key, truth, description) WHERE n_nationkey < 5"""
TILED = "SELECT r_regionkey, CAST(900 + r_regionkey * 1203 AS BIGINT) AS width, CAST(3309 - r_regionkey * 700 AS BIGINT) AS height FROM region"
SEEN = """SELECT l_suppkey % 3 AS drawing_id, l_orderkey AS page, l_linenumber AS item_no, concat('I', l_linenumber % 3) AS item_id, l_partkey % 4 AS tile,
  CAST(l_partkey * 37 % 60 AS DOUBLE) AS x, CAST(l_partkey % 40 AS DOUBLE) AS y FROM lineitem"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The statement over the driver's tables; double quotes mark names, as in standard SQL."""
    import re

    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    used = {n: _table(spark, sf_dir, n) for n in names if re.search(rf"\b{n}\b", sql)}
    return spark.sql(re.sub(rf"\b({'|'.join(used)})\b(?!\.)", r"{\1}", sql.replace('"', "`").replace("{", "{{").replace("}", "}}")), **used)


def _hits(spark, d) -> DataFrame:
    return tags.match_tags(_view(spark, d, SPANS), _view(spark, d, TAGS))


_N = r"upper(trim(regexp_replace(str, '\s+', ' ', 'g')))"
_READ = rf"""WITH s AS ({SPANS}), n AS (SELECT *, {_N} AS n FROM s), tg AS ({TAGS}),
hit AS (SELECT n.*, coalesce(a.tag, b.tag, c.tag, e.tag) AS tag, CASE WHEN a.tag IS NOT NULL THEN 1 WHEN b.tag IS NOT NULL THEN regexp_extract(n, '^(\d{{1,3}})', 1)::BIGINT
    WHEN c.tag IS NOT NULL THEN regexp_extract(n, '^(\d{{1,3}})', 1)::BIGINT ELSE regexp_extract(n, '(\d{{1,3}})$', 1)::BIGINT END AS multiplier
  FROM n LEFT JOIN tg a ON a.tag = n LEFT JOIN tg b ON b.tag = nullif(regexp_extract(n, '^(\d{{1,3}}) ?(?:NO\.?|NR\.?|N°|X|×|OFF) ?([A-Z]{{1,4}}-?\d{{0,3}}[A-Z]?)$', 2), '')
  LEFT JOIN tg c ON c.tag = nullif(regexp_extract(n, '^(\d{{1,3}})([A-Z]{{2,4}}-?\d{{0,3}}[A-Z]?)$', 2), '') AND c.tag NOT IN ({", ".join(f"'{u}'" for u in t.UNITS)})
  LEFT JOIN tg e ON e.tag = nullif(regexp_extract(n, '^([A-Z]{{1,4}}-?\d{{0,3}}[A-Z]?) ?[X×] ?(\d{{1,3}})$', 1), '')),
bx AS ({BOXES}), got AS (SELECT * FROM hit WHERE tag IS NOT NULL),
inn AS (SELECT got.* FROM got WHERE EXISTS (SELECT 1 FROM bx WHERE bx.drawing_id = got.drawing_id AND bx.page = got.page AND got.x + got.w / 2 BETWEEN bx.x AND bx.x + bx.w AND got.y + got.h / 2 BETWEEN bx.y AND bx.y + bx.h)),
out_ AS (SELECT got.* FROM got WHERE NOT EXISTS (SELECT 1 FROM bx WHERE bx.drawing_id = got.drawing_id AND bx.page = got.page AND got.x + got.w / 2 BETWEEN bx.x AND bx.x + bx.w AND got.y + got.h / 2 BETWEEN bx.y AND bx.y + bx.h))
"""


_KEPT = """, r AS (SELECT *, floor(x * 10 + 0.5) / 10 + floor(w * 10 + 0.5) / 10 / 2 AS kx, floor(y * 10 + 0.5) / 10 + floor(h * 10 + 0.5) / 10 / 2 AS ky FROM {0}),
lists AS (SELECT drawing_id, page, tag, list_sort(list({{'seq': seq, 'm': multiplier, 'cx': x + w / 2, 'cy': y + h / 2, 'r': least(8.0, font_size * 2.5)::DOUBLE, 'kx': kx, 'ky': ky}})) AS a FROM r GROUP BY ALL),
k AS (SELECT drawing_id, tag, unnest(list_reduce(list_transform(a, lambda e: [e]), lambda acc, s: CASE WHEN len(list_filter(acc, lambda q: sqrt((q.kx - s[1].cx) * (q.kx - s[1].cx) + (q.ky - s[1].cy) * (q.ky - s[1].cy)) < s[1].r)) > 0 THEN acc ELSE list_concat(acc, s) END)) AS s FROM lists)
"""


@query(_READ + _KEPT.format("out_") + "SELECT drawing_id, tag, sum(s.m)::BIGINT AS n, count(*) AS spans FROM k GROUP BY ALL")
def tag_count(spark, d):
    return tags.count_tags(_view(spark, d, SPANS), _view(spark, d, TAGS), _view(spark, d, BOXES))


@query(_READ + "SELECT drawing_id, tag, count(*) AS n FROM inn GROUP BY ALL")
def inside_semi(spark, d):
    return tags.inside(_hits(spark, d), _view(spark, d, BOXES)).groupBy("drawing_id", "tag").agg(F.count("*").alias("n"))


@query(_READ + """, r AS (SELECT *, floor(x * 10 + 0.5) / 10 + floor(w * 10 + 0.5) / 10 / 2 AS kx, floor(y * 10 + 0.5) / 10 + floor(h * 10 + 0.5) / 10 / 2 AS ky FROM got),
lists AS (SELECT drawing_id, page, tag, list_sort(list({'seq': seq, 'm': multiplier, 'cx': x + w / 2, 'cy': y + h / 2, 'r': least(8.0, font_size * 2.5)::DOUBLE, 'kx': kx, 'ky': ky})) AS a FROM r GROUP BY ALL),
k AS (SELECT drawing_id, tag, unnest(list_reduce(list_transform(a, lambda e: [e]), lambda acc, s: CASE WHEN len(list_filter(acc, lambda q: sqrt((q.kx - s[1].cx) * (q.kx - s[1].cx) + (q.ky - s[1].cy) * (q.ky - s[1].cy)) < s[1].r)) > 0 THEN acc ELSE list_concat(acc, s) END)) AS s FROM lists)
SELECT drawing_id, tag, count(*) AS n, sum(s.m)::BIGINT AS total FROM k GROUP BY ALL""")
def tag_twins(spark, d):
    return tags.without_twins(_hits(spark, d)).groupBy("drawing_id", "tag").agg(F.count("*").alias("n"), F.sum("multiplier").cast("long").alias("total"))


@query(r"""WITH w AS (SELECT unnest(string_split(text, ' ')) AS s FROM documents), n AS (SELECT upper(trim(regexp_replace(replace(s, 'ß', 'SS'), '[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g'))) AS word FROM w)
SELECT word, count(*) AS n FROM n WHERE regexp_matches(word, '\A[A-Z]{1,4}-?[0-9]{0,3}[A-Z]?\z') AND length(word) <= 6 GROUP BY word""")
def tag_like_words(spark, d):
    w = _table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("s")).groupBy("s").agg(F.count("*").alias("c"))
    return w.where(t.is_tag_like("s")).groupBy(t.normalise("s").alias("word")).agg(F.sum("c").cast("long").alias("n"))


@query(r"""SELECT event_id, regexp_extract(concat('SCALE 1:', event_id % 2000), '\b1\s*[:/]\s*(\d{1,4})\b', 1)::INTEGER AS scale FROM events""")
def scale_parse(spark, d):
    return _table(spark, d, "events").select("event_id", t.scale_of(F.concat(F.lit("scale  1:"), F.col("event_id") % 2000)).alias("scale"))


_SECTION = "CASE " + " ".join(f"WHEN regexp_matches(upper(description), '{s[2]}') THEN '{s[0]}'" for s in t.SECTIONS) + " ELSE 'G' END"
LINES = """SELECT p_type AS key, concat(p_type, CASE length(p_type) % 7 WHEN 0 THEN ' led panel' WHEN 1 THEN ' socket' WHEN 2 THEN ' heat detector' WHEN 3 THEN ' hose reel' WHEN 4 THEN ' vav box' WHEN 5 THEN ' wc pan' ELSE ' pump' END) AS description,
  count(*) AS count FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_type"""


@query(f"WITH l AS ({LINES}), s AS (SELECT *, {_SECTION} AS section FROM l) SELECT section, sum(count)::BIGINT AS count, count(*) AS lines FROM s GROUP BY ROLLUP (section)")
def section_bill(spark, d):
    return items.bill_totals(_view(spark, d, LINES))


@query(f"WITH l AS ({LINES}), s AS (SELECT *, {_SECTION} AS section FROM l) SELECT key, section, count, concat(section, '/', row_number() OVER (PARTITION BY section ORDER BY key)) AS ref FROM s")
def bill_references(spark, d):
    return items.bill(_view(spark, d, LINES)).select("key", "section", "count", "ref")


@query("""SELECT p_brand AS key, count(*) FILTER (l_returnflag = 'A') AS A, count(*) FILTER (l_returnflag = 'N') AS N, count(*) FILTER (l_returnflag = 'R') AS R, count(*) AS total
FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand""")
def counts_pivot(spark, d):
    return items.counts_pivot(_view(spark, d, "SELECT p_brand AS key, l_returnflag AS drawing, count(*) AS count FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand, l_returnflag"), ["A", "N", "R"])


_DET = """SELECT concat('P', l_partkey) AS item_id, l_linenumber AS page, CAST(l_quantity AS BIGINT) AS multiplier, l_suppkey % 5 = 0 AS needs_review,
  CASE l_suppkey % 3 WHEN 0 THEN 'vector' WHEN 1 THEN 'symbol' ELSE 'vision' END AS source FROM lineitem"""


@query(f"""WITH d AS ({_DET}), i AS (SELECT concat('P', p_partkey) AS item_id, p_brand AS tag, p_name AS description FROM part),
a AS (SELECT item_id, sum(multiplier)::BIGINT AS n, count(*) FILTER (needs_review) AS r, min(source) AS lo, max(source) AS hi, count(DISTINCT page) AS pages FROM d GROUP BY item_id)
SELECT item_id, tag, description, coalesce(n, 0) AS count, coalesce(r, 0) AS needs_review, CASE WHEN lo IS NULL THEN 'none' WHEN lo = hi THEN lo ELSE 'mixed' END AS source, coalesce(pages, 0) AS pages FROM i LEFT JOIN a USING (item_id)""")
def item_counts_zero_fill(spark, d):
    return items.item_counts(_view(spark, d, "SELECT concat('P', p_partkey) AS item_id, p_brand AS tag, p_name AS description FROM part"), _view(spark, d, _DET)).drop("per_page")


@query(f"""WITH c AS ({COUNTS}) SELECT coalesce(tag, item_id) AS key, sum(count)::BIGINT AS count, count(*) FILTER (drawing_id % 2 = 0) AS needs_review,
CASE WHEN min(drawing_id % 2) = max(drawing_id % 2) THEN 'one' ELSE 'mixed' END AS source, min(description) AS description, count(*) AS drawings FROM c GROUP BY 1""")
def merge_items(spark, d):
    c = _view(spark, d, COUNTS).withColumns({"needs_review": (F.col("drawing_id") % 2 == 0).cast("long"), "source": F.when(F.col("drawing_id") % 2 == 0, "vector").otherwise("symbol")})
    return items.merge_items(c).withColumn("source", F.when(F.col("source") == "mixed", "mixed").otherwise("one")).drop("tagged")


_RANKED = """SELECT l_suppkey AS drawing_id, concat('I', l_partkey % 50) AS item_id, l_quantity AS q FROM lineitem WHERE l_linenumber {}"""


@query(f"""WITH a AS ({_RANKED.format('= 1')}), b AS ({_RANKED.format('= 2')}), c AS ({_RANKED.format('> 2')}),
b2 AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.drawing_id = b.drawing_id AND a.item_id = b.item_id)),
c2 AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.drawing_id = c.drawing_id AND a.item_id = c.item_id) AND NOT EXISTS (SELECT 1 FROM b2 WHERE b2.drawing_id = c.drawing_id AND b2.item_id = c.item_id)),
u AS (SELECT *, 'vector' AS source FROM a UNION ALL SELECT *, 'symbol' FROM b2 UNION ALL SELECT *, 'vision' FROM c2)
SELECT item_id, source, count(*) AS n FROM u GROUP BY ALL""")
def precedence_filter(spark, d):
    a, b, c = (_view(spark, d, _RANKED.format(x)).withColumn("source", F.lit(s)) for x, s in (("= 1", "vector"), ("= 2", "symbol"), ("> 2", "vision")))
    return items.by_precedence(a, b, c).groupBy("item_id", "source").agg(F.count("*").alias("n"))


@query(f"""WITH d AS ({_DET}), n AS (SELECT item_id, sum(multiplier) FILTER (source = 'vision') AS v, sum(multiplier) FILTER (source <> 'vision') AS o FROM d GROUP BY 1)
SELECT item_id, v::BIGINT AS vision, o::BIGINT AS other FROM n WHERE v > 0 AND o > 0 AND abs(v - o) > greatest(1.0, o * 0.05)""")
def cross_check(spark, d):
    return items.disagreements(_view(spark, d, _DET))


_LEGEND = "SELECT p_size AS legend_seq, p_partkey AS item_seq, CASE WHEN p_size % 2 = 0 THEN p_brand END AS tag, p_type AS description FROM part"


@query(f"""WITH l AS ({_LEGEND}), r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(tag, 'desc:' || description) ORDER BY legend_seq, item_seq) AS r FROM l),
f AS (SELECT legend_seq, item_seq, tag, description, row_number() OVER (PARTITION BY tag IS NULL ORDER BY legend_seq, item_seq) AS n FROM r WHERE r = 1)
SELECT legend_seq, item_seq, tag, description, coalesce(tag, concat('L', n)) AS id FROM f""")
def legend_merge(spark, d):
    return items.merge_legends(_view(spark, d, _LEGEND))


_TOTALS = f"""WITH c AS ({COUNTS}), tot AS (SELECT "set", upper(coalesce(tag, item_id)) AS key, sum(count)::BIGINT AS count, min(description) AS description, min([lpad(drawing_id::VARCHAR, 12, '0'), item_id]) AS entered FROM c GROUP BY "set", upper(coalesce(tag, item_id))),
tr AS ({TRUTH}), byd AS (SELECT "set", upper(description) AS d, max_by(key, entered) AS k FROM tot GROUP BY ALL),
res AS (SELECT tr.*, coalesce(t1.key, CASE WHEN tr.description IS NOT NULL THEN b1.k END, b2.k) AS match_key FROM tr LEFT JOIN tot t1 ON t1."set" = tr."set" AND t1.key = upper(tr.key)
  LEFT JOIN byd b1 ON b1."set" = tr."set" AND b1.d = upper(regexp_replace(tr.description, '\\s+', ' ', 'g')) LEFT JOIN byd b2 ON b2."set" = tr."set" AND b2.d = upper(tr.key)),
sc AS (SELECT res."set", res.key, truth, coalesce(tot.count, 0) AS predicted, abs(coalesce(tot.count, 0) - truth) AS abs_error, tot.count IS NOT NULL AS matched FROM res LEFT JOIN tot ON tot."set" = res."set" AND tot.key = res.match_key),
items AS (SELECT *, CASE WHEN truth <> 0 THEN abs_error / truth END AS rel_error, CASE WHEN truth = 0 THEN predicted = 0 ELSE abs_error <= 0.05 * truth + 1e-9 END AS within FROM sc),
sets AS (SELECT "set", count(*) AS items, bool_and(within) AS strict_pass, sum(truth)::BIGINT AS truth, sum(abs_error)::BIGINT AS error FROM items GROUP BY 1),
sw AS (SELECT *, CASE WHEN truth <> 0 THEN error / truth WHEN error = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS weighted_error FROM sets)
"""


_LINE = ["set", "key", "truth", "predicted", "abs_error", "rel_error", "within", "matched"]


def _scored(spark, d):
    totals = scoring.engine_totals(_view(spark, d, COUNTS))
    resolved = scoring.resolve(_view(spark, d, TRUTH), totals)
    return totals, resolved, scoring.score_items(resolved, totals)


@query(_TOTALS + 'SELECT "set", key, truth, predicted, abs_error, rel_error, within, matched FROM items')
def score_items(spark, d):
    return _scored(spark, d)[2].select(*_LINE)


@query(_TOTALS + "SELECT *, weighted_error <= 0.05 + 1e-9 AS weighted_pass FROM sw")
def score_sets(spark, d):
    return scoring.score_sets(_scored(spark, d)[2])


@query(_TOTALS + "SELECT count(*) AS sets, count(*) FILTER (strict_pass) AS strict, count(*) FILTER (weighted_error <= 0.05 + 1e-9) AS weighted, avg(weighted_error) AS mean_error FROM sw")
def score_summary(spark, d):
    return scoring.summary(scoring.score_sets(_scored(spark, d)[2])).drop("failed")


@query(_TOTALS + 'SELECT tot."set", tot.key, tot.count FROM tot WHERE count > 0 AND NOT EXISTS (SELECT 1 FROM res WHERE res."set" = tot."set" AND res.match_key = tot.key)')
def extras(spark, d):
    totals, resolved, _ = _scored(spark, d)
    return scoring.extras(resolved, totals)


@query(_TOTALS + """SELECT "set", key, truth, predicted, abs_error, rel_error, within, matched FROM items
QUALIFY row_number() OVER (PARTITION BY "set" ORDER BY coalesce(rel_error, CASE WHEN abs_error > 0 THEN 9.0 ELSE 0.0 END) DESC, key) = 1""")
def worst_item(spark, d):
    return scoring.worst_items(_scored(spark, d)[2]).select(*_LINE)


@query("""WITH u AS (SELECT length(text) AS a, turn AS b, conv_id % 7 AS c FROM conversations)
SELECT count(*) AS calls, sum(a)::BIGINT AS tokens_in, sum(b)::BIGINT AS tokens_out, sum(c)::BIGINT AS tokens_thought, (sum(a)::BIGINT * 1.5 + (sum(b)::BIGINT + sum(c)::BIGINT) * 7.5)::DOUBLE / 1e6 AS cost_usd FROM u""")
def usage_cost(spark, d):
    return scoring.usage(_table(spark, d, "conversations").select(F.length("text").alias("tokens_in"), F.col("turn").alias("tokens_out"), (F.col("conv_id") % 7).alias("tokens_thought"))).drop("cached_calls", "model")


@query("SELECT item_id, sha256(concat('model', text)) AS key FROM benchmark")
def request_key(spark, d):
    return _table(spark, d, "benchmark").select("item_id", t.request_key(F.lit("model"), F.col("text")).alias("key"))


@query(r"SELECT page_id, right(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), 80) AS name FROM pages")
def safe_names(spark, d):
    return _table(spark, d, "pages").select("page_id", t.safe_name(F.col("url")).alias("name"))


_EVENTS = "SELECT event_id, user_id, event_id % 100000 AS place, event_type FROM events"


@query(f"""WITH e AS ({_EVENTS}), n AS (SELECT *, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) <= 50 THEN 0 ELSE 1 END AS new FROM e)
SELECT event_id, user_id, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS row_id FROM n""")
def row_grouping(spark, d):
    return layout.gap_rows(_view(spark, d, _EVENTS), ["user_id"], ["event_id"], "event_id", 50).select("event_id", "user_id", "row_id")


@query(f"""WITH e AS ({_EVENTS}), n AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM e),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM n)
SELECT user_id, run, event_type, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 3""")
def hatch_runs(spark, d):
    return layout.runs(_view(spark, d, _EVENTS), ["user_id"], ["event_id"], "event_type", 3)


@query(f"""WITH e AS ({_EVENTS}), l AS (SELECT * FROM e WHERE event_id % 3 = 0), v AS (SELECT * FROM e WHERE event_id % 3 <> 0),
m AS (SELECT l.user_id, l.event_id AS id, v.event_id AS value_id, (v.event_id - l.event_id)::DOUBLE AS distance, row_number() OVER (PARTITION BY l.user_id, l.event_id ORDER BY v.event_id) AS r FROM l LEFT JOIN v ON v.user_id = l.user_id AND v.event_id >= l.event_id)
SELECT user_id, id, value_id, distance FROM m WHERE r = 1""")
def nearest_label(spark, d):
    e = _view(spark, d, _EVENTS).withColumn("x", F.col("event_id").cast("double"))
    return layout.nearest(e.where("event_id % 3 = 0").select("user_id", F.col("x").alias("at"), F.col("event_id").alias("id")), e.where("event_id % 3 <> 0").select("user_id", F.col("x").alias("value_at"), F.col("event_id").alias("value_id")), ["user_id"])


@query(f"""WITH s AS ({SPANS}), l AS (SELECT drawing_id, page, list_sort(list({{'y': y, 'x': x, 'seq': seq, 'cy': y + h / 2, 'h': h}})) AS a FROM s GROUP BY ALL),
f AS (SELECT drawing_id, page, list_reduce(list_transform(a, lambda e: [{{'cy': e.cy, 'h': e.h, 'n': 1}}]), lambda acc, e: CASE WHEN abs(acc[-1].cy - e[1].cy) <= e[1].h * 0.6 THEN list_concat(acc[:-2], [{{'cy': acc[-1].cy, 'h': acc[-1].h, 'n': acc[-1].n + 1}}]) ELSE list_concat(acc, e) END) AS lines FROM l),
u AS (SELECT drawing_id, page, unnest(range(1, len(lines) + 1)) AS i, lines FROM f)
SELECT drawing_id, page, (i - 1)::INTEGER AS line, lines[i].cy AS y, lines[i].n::BIGINT AS spans FROM u""")
def line_fold(spark, d):
    return layout.group_lines(_view(spark, d, SPANS))


@query("""WITH l AS (SELECT l_orderkey, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1)
SELECT l_orderkey, v[(len(v) // 2) + 1] AS median, v[floor(len(v) * 0.1)::INTEGER + 1] AS rank10 FROM l""")
def upper_median(spark, d):
    v, k = _table(spark, d, "lineitem"), ["l_orderkey"]
    return layout.ranked_value(v, k, "l_extendedprice", layout.UPPER_MEDIAN, "median").join(layout.ranked_value(v, k, "l_extendedprice", layout.TENTH, "rank10"), k)


@query(f"""WITH s AS ({SPANS}) SELECT drawing_id, page, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM s GROUP BY ALL""")
def box_union(spark, d):
    return _view(spark, d, SPANS).groupBy("drawing_id", "page").agg(g.union_box().alias("b")).select("drawing_id", "page", "b.x", "b.y", "b.w", "b.h")


@query(f"""WITH s AS ({SPANS}), b AS ({BOXES}), j AS (SELECT s.drawing_id, s.page, s.seq, s.x AS x, s.y AS y, s.w AS w, s.h AS h,
  least(s.x + s.w, b.x + b.w) - greatest(s.x, b.x) AS iw, least(s.y + s.h, b.y + b.h) - greatest(s.y, b.y) AS ih, s.w * s.h + b.w * b.h AS area FROM s JOIN b USING (drawing_id, page))
SELECT drawing_id, count(*) AS n, count(*) FILTER (iw > 0 AND ih > 0) AS met, sum(floor(CASE WHEN iw > 0 AND ih > 0 THEN iw * ih / (area - iw * ih) ELSE 0 END * 1000 + 0.5)::BIGINT)::BIGINT AS iou_sum,
  sum((least(50, x + w) - x)::BIGINT)::BIGINT AS clamped FROM j GROUP BY 1""")
def box_iou(spark, d):
    s = _view(spark, d, SPANS)
    b = _view(spark, d, BOXES).select("drawing_id", "page", *[F.col(k).alias(f"b_{k}") for k in "xywh"])
    j = s.join(b, ["drawing_id", "page"])
    clamp = F.least(F.lit(50.0), F.col("x") + F.col("w")) - F.col("x")
    return j.groupBy("drawing_id").agg(F.count("*").alias("n"), F.count_if(g.intersection_area("", "b_") > 0).alias("met"), F.sum(F.floor(g.iou("", "b_") * 1000 + 0.5)).cast("long").alias("iou_sum"), F.sum(clamp.cast("long")).cast("long").alias("clamped"))


_CELLS = "SELECT p_partkey AS id, p_size AS page, CAST(p_partkey * 37 % 997 AS DOUBLE) AS x, CAST(p_partkey * 61 % 991 AS DOUBLE) AS y FROM part"


@query(f"WITH p AS ({_CELLS}) SELECT a.page, a.id AS a, b.id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM p a JOIN p b ON a.page = b.page AND a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900")
def grid_radius_join(spark, d):
    p = _view(spark, d, _CELLS)
    return layout.within_radius(p, p, ["page"], 30.0).where("a <> b")


@query(f"WITH p AS ({_CELLS}) SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE a.page = b.page AND a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900)")
def isolated(spark, d):
    return layout.isolated(_view(spark, d, _CELLS), ["page"], 30.0).select("id", "page", "x", "y")


@query(f"""WITH t AS ({TILED}), o AS (SELECT *, CASE WHEN width <= 1024 THEN [0] ELSE list_distinct(list_append(range(0, width - 1024, 864), width - 1024)) END AS xs, CASE WHEN height <= 1024 THEN [0] ELSE list_distinct(list_append(range(0, height - 1024, 864), height - 1024)) END AS ys FROM t),
a AS (SELECT r_regionkey, width, height, xs, unnest(ys) AS py FROM o) SELECT r_regionkey, width, height, py::BIGINT AS py, unnest(xs)::BIGINT AS px FROM a""")
def tile_grid(spark, d):
    return tiles.tiles(_view(spark, d, TILED))


@query("""WITH e AS (SELECT event_id, (event_id % 900)::DOUBLE AS a, (event_id % 37 + event_id % 900)::DOUBLE AS b FROM events), p AS (SELECT event_id, a / 1000 * 1024 AS x1, b / 1000 * 1024 AS x2 FROM e)
SELECT event_id, (864 + x1) * (72.0 / 200)::DOUBLE AS x, (x2 - x1) * (72.0 / 200)::DOUBLE AS w FROM p WHERE x2 - x1 >= 1""")
def tile_box(spark, d):
    e = _table(spark, d, "events").select("event_id", (F.col("event_id") % 900).cast("double").alias("a"), (F.col("event_id") % 37 + F.col("event_id") % 900).cast("double").alias("b"))
    x = e.select("event_id", g.tile_box_to_page(F.array("a", "a", "b", "b"), F.lit(864), F.lit(0), F.lit(1024), F.lit(1024), F.lit(200)).alias("t")).where("t is not null")
    return x.select("event_id", "t.x", "t.w")


@query()
def dedupe_claims(spark, d):
    s = _view(spark, d, SEEN)
    s = s.select("drawing_id", "page", F.col("item_no").alias("seq"), "item_id", "x", "y", F.lit(9.0).alias("w"), F.lit(9.0).alias("h"), (F.lit(1.0) - (F.col("x") % 10) / 20).alias("confidence"), (F.col("y") % 7).alias("edge_margin"), "tile", F.lit(False).alias("needs_review"), F.lit(None).cast("string").alias("review_reason"))
    return tiles.dedupe(s)


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')")
def policy_hits(spark, d):
    return _table(spark, d, "documents").where(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")).select("doc_id")


@query("""WITH e AS (SELECT vec_id, label, embedding[1:8] AS v FROM embeddings), f AS (SELECT vec_id, list_sum(list_transform(range(1, 9), lambda i: abs(v[i]::DOUBLE - embedding[i + 8]::DOUBLE))) AS l1 FROM e JOIN embeddings USING (vec_id))
SELECT vec_id, floor(l1 * 1000000 + 0.5)::BIGINT AS l1 FROM f""")
def histogram_l1(spark, d):
    e = _table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    l1 = F.aggregate(F.zip_with(F.slice("v", 1, 8), F.slice("v", 9, 8), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", F.floor(l1 * 1000000 + 0.5).alias("l1"))


from sheetmeter.plans import extended  # noqa: E402, F401  registers its queries here
