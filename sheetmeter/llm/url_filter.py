"""URL filters by a temporal list join, in DataFrame functions only.

Dated list entries (add or remove a rule on a day) become validity intervals: an entry holds until the next one of the same list and
rule. Every capture is evaluated against the rules in force on the day it was fetched. A rule is a host, which also covers its
subdomains, or a host with a path, which covers what lies below it. A capture is expanded into the rules that would cover
it, no deeper than the deepest rule of the lists, and these are joined by equality with the intervals that hold its day. The
most specific rule decides (the longest; a path before a bare host of the same length cannot occur, since a path is longer);
ties: allow before block, then the later begin, then the list's name.

Null, empty or relative urls have no host and are covered by nothing (verdict none), as are captures without a day. Two entries
of a list and rule on one day: remove counts last. Entries with nulls are passed over; an empty list covers nothing. Ports, users,
queries and fragments are no part of a rule; hosts are compared in lower case. Very long urls cost no more than the
lists' depth. Captures of equal url and day are evaluated once; every row is returned. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS

#: The dated entries that the query applies: list, kind, rule, action, day.
ENTRIES = (
    ("spam", "block", "spam-farm.example.org", "add", "2024-01-20"),
    ("spam", "block", "spam-farm.example.org", "remove", "2024-06-01"),
    ("spam", "block", "spam-farm.example.org", "add", "2024-09-01"),
    ("spam", "block", "cheap-pills.example.com", "add", "2024-02-10"),
    ("spam", "block", "tionsh.example.net", "add", "2024-03-01"),
    ("spam", "block", "tionsh.example.net", "remove", "2024-10-15"),
    ("review", "allow", "tionsh.example.net/en", "add", "2024-05-01"),
    ("review", "allow", "tionsh.example.net/en", "remove", "2024-08-01"),
    ("review", "allow", "blog.tionsh.example.net", "add", "2024-04-01"),
    ("legal", "block", "ththan.example.net/de", "add", "2024-01-01"),
    ("legal", "block", "ththan.example.net", "add", "2024-07-01"),
    ("legal", "block", "ththon.example.net/fr", "add", "2024-02-01"),
    ("adult", "block", "therou.example.com", "add", "2024-03-15"),
    ("adult", "block", "therou.example.com", "remove", "2024-03-20"),
    ("adult", "block", "m.thther.example.org", "add", "2024-11-01"),
    ("adult", "block", "example.edu", "add", "2024-01-01"),
)


def entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ENTRIES), "list string, kind string, rule string, action string, day string").withColumn("day", F.to_date("day"))


def intervals(dated: DataFrame) -> DataFrame:
    """list, kind, rule, since, until (exclusive; null for still in force) of each stretch in which a rule is in force."""
    clean = dated.select("list", "kind", F.lower("rule").alias("rule"), "action", "day").where("list is not null and kind in ('allow', 'block') and rule is not null and rule <> '' and action in ('add', 'remove') and day is not null")
    day = clean.groupBy("list", "kind", "rule", "day").agg(F.max("action").alias("action"))  # 'remove' sorts after 'add'
    w = Window.partitionBy("list", "kind", "rule").orderBy("day")
    return day.withColumn("until", F.lead("day").over(w)).where("action = 'add'").select("list", "kind", "rule", F.col("day").alias("since"), "until")


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def path_of(url) -> F.Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^?#]*)", 1)


def verdicts(captures: DataFrame, dated: DataFrame, url_col: str, day_col: str) -> DataFrame:
    """All rows of captures as url, day and what decides: verdict (allow, block or none), rule, list and since."""
    lists = intervals(dated).withColumn("labels", F.size(F.split(F.substring_index("rule", "/", 1), r"\."))).withColumn("depth", F.size(F.split("rule", "/")) - 1)
    most = lists.agg(F.coalesce(F.max("labels"), F.lit(0)), F.coalesce(F.max("depth"), F.lit(0))).first()
    small = lists.limit(BROADCAST_ROWS // 10 + 1).count() <= BROADCAST_ROWS // 10
    lists = lists.drop("labels", "depth")
    one = captures.select(F.col(url_col).alias("url"), F.col(day_col).alias("day")).where("url is not null and day is not null").distinct()
    one = one.withColumn("host", host_of(F.col("url"))).where("host <> ''")
    parts = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most[0]))), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
    steps = F.array_remove(F.split(path_of(F.col("url")), "/"), "")
    paths = F.transform(F.filter(F.sequence(F.lit(0), F.least(F.size(steps), F.lit(most[1]))), lambda k: F.lit(True)), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.lower(F.array_join(F.slice(steps, 1, k), "/")))))
    if not most[0]:
        keys = one.select("url", "day", F.explode(F.array().cast("array<string>")).alias("rule"))
    else:
        keys = one.select("url", "day", F.explode(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))).alias("rule"))
    hit = keys.join(F.broadcast(lists) if small else lists, "rule").where("day >= since and (until is null or day < until)")
    # allow sorts before block and the least name is wanted, so both are compared by what is least
    order = F.struct((-F.length("rule")).alias("l"), "kind", F.datediff(F.lit("9999-12-31").cast("date"), "since").alias("s"), "list", "rule", "since")
    best = hit.groupBy("url", "day").agg(F.min(order).alias("x")).select("url", "day", F.col("x.kind").alias("verdict"), "x.rule", "x.list", "x.since")
    return captures.withColumnsRenamed({url_col: "url", day_col: "day"}).join(best, ["url", "day"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("none")))


def page_verdicts(pages: DataFrame, dated: DataFrame) -> DataFrame:
    """page_id, url, day, verdict, rule, list and since of every page; a page has no date, so its id gives the day of 2024 it counts as fetched on."""
    rows = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int")).alias("day"))
    return verdicts(rows, dated, "url", "day").select("page_id", "url", "day", "verdict", "rule", "list", "since")


_VALUES = ", ".join(f"('{a}', '{b}', '{c}', '{d}', DATE '{e}')" for a, b, c, d, e in ENTRIES)
SQL = f"""
WITH e(list, kind, rule, action, day) AS (VALUES {_VALUES}),
i AS (SELECT list, kind, rule, day AS since, lead(day) OVER (PARTITION BY list, kind, rule ORDER BY day) AS until, action FROM e),
p AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS day,
  lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
  '/' || array_to_string(list_filter(string_split(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^?#]*)', 1)), '/'), lambda x: x <> ''), '/') || '/' AS path FROM pages),
h AS (SELECT page_id, url, day, kind, rule, list, since FROM p JOIN i ON action = 'add' AND day >= since AND (until IS NULL OR day < until)
  AND ('.' || host LIKE '%.' || split_part(rule, '/', 1))
  AND (position('/' IN rule) = 0 OR starts_with(path, substr(rule, position('/' IN rule)) || '/'))),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, url, day ORDER BY length(rule) DESC, kind, since DESC, list) AS r FROM h)
SELECT p.page_id, p.url, p.day, coalesce(r.kind, 'none') AS verdict, r.rule, r.list, r.since
FROM p LEFT JOIN r ON r.r = 1 AND r.page_id = p.page_id AND r.url = p.url
"""
