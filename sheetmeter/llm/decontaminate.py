"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text becomes its words (runs of letters and digits). Numbers, unit words after a number, and names (capitalised words
that do not begin a sentence) become the placeholders <num>, <unit> and <name>; all other words are taken in lower case. All
windows of WINDOW template words, at least half of them no placeholders, are joined by hash between benchmark items and
documents. Windows that meet at the same distance between item and document are one alignment. An alignment is a leak if it covers
at least COVERAGE of the item's windows and its slots are consistent: within the windows that met, equal slots of a type in the
item hold equal values in the document, and different ones different values, as in a copy with other parameters.

That is the exact way, and the one that SQL states. A pair it does not find is looked for in a second way, for copies whose number of
words has changed: a number with separators (1,250) and a run of name words (New York) are one placeholder each, a capitalised
word that begins a sentence is <name> too, and windows with more placeholders than other words meet by their raw words.
Item windows that meet are then counted once over a band of neighbouring shifts, as wide as half the item and BAND words at
least; bands overlap by half. Where a window meets at several shifts of a band, the shift with the most windows gives its slots.
The same coverage is asked and the same consistency, except that words that begin a sentence are no slots there. n_matched,
n_windows and n_slots then count merged words; first_word is a place in the document's words in both ways.

Items with fewer words than a window are one window of their own length. Null or empty texts, and texts without words, match nothing.
Texts are taken whole. Per document and item the alignment with the most windows is returned (ties: the one earliest in the
document). Rows of equal id and text give one result, as do rows without an id; items of equal id are told apart by text. Empty tables give
an empty result. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialise

WINDOW, COVERAGE = 8, 0.5
#: Words that are units when they follow a number.
UNITS = ("mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "lb", "oz", "ml", "l", "s", "sec", "min", "h", "hr", "hours", "hour", "minutes", "seconds", "days", "day", "weeks", "years", "year", "percent", "dollars", "cents", "euros", "usd", "eur", "meters", "metres", "miles", "feet", "inches", "degrees", "kw", "kwh", "w", "v", "hz", "gb", "mb", "kb")
#: Words that a band of shifts is wide at least.
BAND = 16
PLACES = ("<num>", "<unit>", "<name>")
SENTENCE = r"""([.!?\r\n]["')\]]*[ \t\r\n]*)(\p{Lu})"""
BETWEEN = r"[^\p{L}\p{N}^]+"


def words(text) -> F.Column:
    """The words of a text; a word that begins a sentence with a capital has a ^ before it."""
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), SENTENCE, "$1 ^$2")
    return F.array_remove(F.split(marked, BETWEEN), "")


def _begins(x, first: str, last: str) -> F.Column:
    """Whether x begins with one of the ASCII characters first to last. Bytes are compared, as F.ascii() makes two strings a call; words that
    begin behind last, as most do where this is asked, fail the first comparison."""
    return (x < chr(ord(last) + 1)) & (x >= first)


def _digit(x) -> F.Column:
    return _begins(x, "0", "9")


def _marked(x) -> F.Column:
    return _begins(x, "^", "^")


def template(x, before) -> F.Column:
    """The template word for a word and the word before it (null for none)."""
    return _template(x, _digit(before))


def _template(x, counted) -> F.Column:
    """The same, told whether the word before is a number."""
    low = F.lower(x)
    unit = F.coalesce(counted, F.lit(False)) & low.isin(*UNITS)
    name = (F.substring(x, 1, 1) != F.substring(low, 1, 1)) & (F.length(x) > 1) & (F.substring(x, 2, 1) == F.substring(low, 2, 1)) & ~_digit(F.substring(x, 2, 1))
    # the commonest cases come first: most words begin with a small letter
    small = F.when(unit, "<unit>").otherwise(low)
    return F.when(_begins(x, "a", "z"), small).when(_marked(x), F.ltrim(low, F.lit("^"))).when(_digit(x), "<num>").when(unit, "<unit>").when(name, "<name>").otherwise(low)


def _templates(col: str) -> F.Column:
    return F.transform(col, lambda x, i: template(x, F.get(F.col(col), i - 1)))


def _once(df: DataFrame, name: str, value: F.Column) -> DataFrame:
    """Adds a column through a generator of one row, so that the optimiser can't repeat its expression where it is used."""
    return df.withColumn(name, F.explode(F.array(value)))


def _windows(df: DataFrame, length: int) -> DataFrame:
    """df has words w and hashes h; adds at and the hash of each window of that length."""
    at = df.where(F.size("h") >= length).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("h") - length)))
    return at.withColumn("key", F.xxhash64(F.lit(length), *[F.get("h", F.col("at") + j) for j in range(length)]))


def _exact(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The leaks whose windows meet at one shift."""
    b = items.select(items[item_col].cast("long").alias("item_id"), items[item_text].cast("string").alias("body")).distinct()
    b = _once(_once(_once(b, "w", words(F.col("body"))), "t", _templates("w")), "h", F.transform("t", lambda x: F.xxhash64(x)))
    b = b.where(F.size("h") > 0).withColumn("body", F.xxhash64("body"))  # a number stands for an item's text from here on
    lengths = sorted(r[0] for r in b.select(F.least(F.size("h"), F.lit(window))).distinct().collect())  # at most `window` values
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), F.explode(F.array(words(docs[text_col].cast("string")))).alias("w"))
    d = _once(d, "h", F.transform("w", lambda x, i: F.xxhash64(template(x, F.get(F.col("w"), i - 1)))))
    met = None
    for n in lengths:
        own = _windows(b.where(F.least(F.size("h"), F.lit(window)) == n), n)
        plain = F.size(F.filter(F.slice("t", F.col("at") + 1, n), lambda x: ~x.isin("<num>", "<unit>", "<name>")))
        own = own.where(plain * 2 >= n).select("key", "item_id", "body", F.col("at").alias("item_at"), F.slice("t", F.col("at") + 1, n).alias("kinds"), F.slice("w", F.col("at") + 1, n).alias("values"))
        small = own.limit(BROADCAST_ROWS // 10 + 1).count() <= BROADCAST_ROWS // 10
        got = _windows(d, n).join(F.broadcast(own) if small else own, "key")
        got = got.select("doc_id", "item_id", "body", "at", "item_at", "kinds", "values", F.slice("w", F.col("at") + 1, n).alias("found"))
        met = got if met is None else met.unionByName(got)
    if met is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    # a slot: its type, value in the item, value in the document; a sentence mark is no part of a value
    bare = lambda x: F.ltrim(x, F.lit("^"))
    slots = F.filter(F.transform(F.arrays_zip("kinds", "values", "found"), lambda s: F.struct(s["kinds"].alias("k"), bare(s["values"]).alias("x"), bare(s["found"]).alias("y"))), lambda s: s["k"].isin("<num>", "<unit>", "<name>"))
    rows = met.select("doc_id", "item_id", "body", (F.col("at") - F.col("item_at")).cast("long").alias("shift"), "item_at", slots.alias("slots")).dropDuplicates(["doc_id", "item_id", "body", "shift", "item_at"])
    # an alignment has at most as many rows as its item has windows
    one = rows.groupBy("doc_id", "item_id", "body", "shift").agg(F.count("*").alias("n_matched"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
    whole = b.select("item_id", "body", F.greatest(F.lit(1), F.size("h") - window + 1).cast("long").alias("n_windows"))
    whole = F.broadcast(whole) if whole.limit(BROADCAST_ROWS // 10 + 1).count() <= BROADCAST_ROWS // 10 else whole
    out = one.join(whole, ["item_id", "body"]).where(_fair() & (F.col("n_matched") >= coverage * F.col("n_windows")))
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_matched", (-F.col("shift")).alias("back"), "n_windows", F.size("slots").cast("long").alias("n_slots"), F.exists("slots", lambda s: s["x"] != s["y"]).alias("other"))).alias("x"))
    return best.select("doc_id", "item_id", F.greatest(F.lit(0).cast("long"), -F.col("x.back")).alias("first_word"), "x.n_matched", "x.n_windows", (F.col("x.n_matched") / F.col("x.n_windows")).alias("coverage"), "x.n_slots", F.col("x.other").alias("reparameterised"))


SCHEMA = "doc_id long, item_id long, first_word long, n_matched long, n_windows long, coverage double, n_slots long, reparameterised boolean"


def _merged(df: DataFrame, text: str) -> DataFrame:
    """Adds the words w, the places idx in them where a merged word begins, and of each merged word its template t, the hash h
    of that, and the hash raw of the word itself. Only t is made of strings anew; where it is not asked for, words are told apart by hash."""
    joined = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?<=\p{N})[.,](?=[0-9])", " ^")  # the words stay as many
    df = _once(df, "w", words(joined)).where(F.size("w") > 0)

    def kind(x, i):
        before = F.get(F.col("w"), i - 1)
        rest = F.ltrim(x, F.lit("^"))
        first = F.when(_digit(rest), "<more>").otherwise(template(rest, F.lit(None).cast("string")))
        return F.when(_marked(x), first).otherwise(_template(x, _digit(before) | _marked(before) & _digit(F.ltrim(before, F.lit("^")))))

    df = _once(df, "all", F.transform("w", lambda x, i: F.xxhash64(kind(x, i))))
    more, name = _hashed("<more>"), _hashed("<name>")
    again = lambda i: (F.get("all", i) == more) & (i > 0) | (F.get("all", i) == name) & (F.coalesce(F.get("all", i - 1), F.lit(0)) == name) & ~_marked(F.get("w", i))
    df = _once(df, "idx", F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: ~again(i)))
    df = _once(df, "h", F.transform("idx", lambda i: F.get("all", i)))
    df = _once(df, "raw", F.transform("idx", lambda i, k: F.when(_place(F.get("h", k)), F.xxhash64(F.lower(_value(i, k)))).otherwise(F.get("h", k))))
    return df.withColumn("t", F.transform("idx", lambda i: kind(F.get("w", i), i)))


def _hashed(word: str) -> F.Column:
    return F.xxhash64(F.lit(word))


def _place(h) -> F.Column:
    """Whether a hash is that of a placeholder."""
    return h.isin(*map(_hashed, PLACES))


def _value(i, k) -> F.Column:
    """The merged word k, which begins at word i."""
    return F.array_join(F.slice("w", i + 1, F.coalesce(F.get("idx", k + 1), F.size("w")) - i), " ")


def _merged_windows(df: DataFrame, length: int) -> DataFrame:
    """Adds at and the key of each window: of its templates, or of its raw words if most are placeholders."""
    at = df.where(F.size("h") >= length).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("h") - length)))
    places = sum((_place(F.get("h", F.col("at") + j)).cast("int") for j in range(length)), F.lit(0))
    key = lambda salt, col: F.xxhash64(F.lit(salt), *[F.get(col, F.col("at") + j) for j in range(length)])
    return at.withColumn("key", F.when(places * 2 <= length, key(length, "h")).otherwise(key(-length, "raw")))


def _values(length: int) -> F.Column:
    """The merged words of the window at `at`."""
    return F.transform(F.sequence(F.col("at"), F.col("at") + length - 1), lambda k: _value(F.get("idx", k), k))


def _banded(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, window: int, coverage: float) -> DataFrame:
    """The leaks whose windows meet within a band of shifts."""
    b = _merged(items.select(items[item_col].cast("long").alias("item_id"), items[item_text].cast("string").alias("body")).distinct(), "body").withColumn("body", F.xxhash64("body"))
    lengths = sorted(r[0] for r in b.select(F.least(F.size("h"), F.lit(window))).distinct().collect())
    d = _merged(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("body")), "body").drop("body", "all", "t")
    met = None
    for n in lengths:
        own = _merged_windows(b.where(F.least(F.size("h"), F.lit(window)) == n), n)
        own = own.select("key", "item_id", "body", F.col("at").alias("item_at"), F.get("idx", "at").alias("item_word"), F.slice("t", F.col("at") + 1, n).alias("kinds"), _values(n).alias("values"), F.greatest(F.lit(1), F.size("h") - window + 1).cast("long").alias("n_windows"), F.greatest(F.lit(BAND), F.size("h") / 2).cast("long").alias("wide"))
        small = own.limit(BROADCAST_ROWS // 10 + 1).count() <= BROADCAST_ROWS // 10
        got = _merged_windows(d, n).join(F.broadcast(own) if small else own, "key")
        got = got.select("doc_id", "item_id", "body", "n_windows", "wide", "item_at", (F.col("at") - F.col("item_at")).cast("long").alias("shift"), (F.get("idx", "at") - F.col("item_word")).cast("long").alias("first"), "kinds", "values", _values(n).alias("found"))
        met = got if met is None else met.unionByName(got)
    if met is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    zipped = F.transform(F.arrays_zip("kinds", "values", "found"), lambda s: F.struct(s["kinds"].alias("k"), s["values"].alias("x"), s["found"].alias("y")))
    slots = F.filter(zipped, lambda s: s["k"].isin(*PLACES) & (F.ascii(s["x"]) != 94) & (F.ascii(s["y"]) != 94))
    pair = ["doc_id", "item_id", "body", "n_windows"]
    rows = met.select(*pair, "wide", "item_at", "shift", "first", slots.alias("slots")).dropDuplicates([*pair, "shift", "item_at"])
    at = rows.withColumn("many", F.count("*").over(Window.partitionBy(*pair, "shift")))
    half = F.floor(F.col("wide") / 2)
    bands = at.withColumn("band", F.explode(F.array(F.floor(F.col("shift") / F.col("wide")) * 2, F.floor((F.col("shift") + half) / F.col("wide")) * 2 + 1)))
    each = bands.groupBy(*pair, "band", "item_at").agg(F.max(F.struct("many", (-F.col("shift")).alias("back"), "first", "slots")).alias("x"))
    one = each.groupBy(*pair, "band").agg(F.count("*").alias("n_matched"), F.min("x.first").alias("first"), F.array_distinct(F.flatten(F.collect_list("x.slots"))).alias("slots"))
    out = one.where(_fair() & (F.col("n_matched") >= coverage * F.col("n_windows")))
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_matched", (-F.col("first")).alias("back"), "n_windows", F.size("slots").cast("long").alias("n_slots"), F.exists("slots", lambda s: s["x"] != s["y"]).alias("other"))).alias("x"))
    return best.select("doc_id", "item_id", F.greatest(F.lit(0).cast("long"), -F.col("x.back")).alias("first_word"), "x.n_matched", "x.n_windows", (F.col("x.n_matched") / F.col("x.n_windows")).alias("coverage"), "x.n_slots", F.col("x.other").alias("reparameterised"))


def _fair() -> F.Column:
    """Whether equal slots of a type have equal values, and different ones different values."""
    size = lambda f: F.size(F.array_distinct(F.transform("slots", f)))
    return (size(lambda s: F.struct(s["k"], s["x"])) == F.size("slots")) & (size(lambda s: F.struct(s["k"], s["y"])) == F.size("slots"))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, first_word (in the document), n_matched, n_windows, coverage, n_slots, reparameterised of each leak."""
    args = docs, items, id_col, text_col, item_col, item_text, window, coverage
    names = SCHEMA.replace(",", "").split()[::2]
    both = _exact(*args).select(*names, F.lit(1).alias("way")).unionByName(_banded(*args).select(*names, F.lit(0).alias("way")))
    best = both.groupBy("doc_id", "item_id").agg(F.max(F.struct("way", *names[2:])).alias("x"))
    return best.select("doc_id", "item_id", *[f"x.{c}" for c in names[2:]])


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs in which no item leaks; rows without an id stay."""
    bad = materialise(leaks(docs, items, id_col).select(F.col("doc_id").alias("__bad")).distinct())  # counted and joined, but found once
    bad = F.broadcast(bad) if bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else bad
    return docs.join(bad, docs[id_col] == bad["__bad"], "left_anti")


_LIST = ", ".join(f"'{u}'" for u in UNITS)


def _sql_words(col: str) -> str:
    return rf"""list_filter(string_split_regex(regexp_replace(chr(10) || coalesce({col}, ''), '([.!?\r\n]["'')\]]*[ \t\r\n]*)(\p{{Lu}})', '\1 ^\2', 'g'), '[^\p{{L}}\p{{N}}^]+'), lambda x: x <> '')"""


_SQL_TEMPLATE = f"""CASE WHEN regexp_matches(w[i], '^[0-9]') THEN '<num>'
  WHEN lower(w[i]) IN ({_LIST}) AND i > 1 AND regexp_matches(w[i - 1], '^[0-9]') THEN '<unit>'
  WHEN substr(w[i], 1, 1) <> substr(lower(w[i]), 1, 1) AND length(w[i]) > 1 AND substr(w[i], 2, 1) = substr(lower(w[i]), 2, 1) AND NOT regexp_matches(substr(w[i], 2, 1), '^[0-9]') THEN '<name>'
  ELSE ltrim(lower(w[i]), '^') END"""

SQL = f"""
WITH dw AS (SELECT DISTINCT doc_id, {_sql_words("text")} AS w FROM documents),
bw AS (SELECT item_id, body, {_sql_words("body")} AS w FROM (SELECT DISTINCT item_id, text AS body FROM benchmark)),
d AS (SELECT doc_id, w, list_transform(range(1, len(w) + 1), lambda i: {_SQL_TEMPLATE}) AS t FROM dw),
b AS (SELECT item_id, body, w, list_transform(range(1, len(w) + 1), lambda i: {_SQL_TEMPLATE}) AS t FROM bw WHERE len(w) > 0),
bx AS (SELECT item_id, body, w, t, least(len(w), {WINDOW}) AS n, unnest(range(0, len(w) - least(len(w), {WINDOW}) + 1)) AS item_at FROM b),
by_ AS (SELECT item_id, body, n, item_at, array_to_string(t[item_at + 1:item_at + n], ' ') AS k, t[item_at + 1:item_at + n] AS kinds, w[item_at + 1:item_at + n] AS vals FROM bx),
own AS (SELECT * FROM by_ WHERE 2 * len(list_filter(kinds, lambda x: x NOT IN ('<num>', '<unit>', '<name>'))) >= n),
dx AS (SELECT doc_id, w, t, n, unnest(range(0, len(w) - n + 1)) AS pos FROM d, (SELECT DISTINCT n FROM own) WHERE len(w) >= n),
met AS (SELECT doc_id, item_id, body, pos - item_at AS shift, item_at, own.n AS n, kinds, vals, w[pos + 1:pos + own.n] AS found
  FROM dx JOIN own ON own.n = dx.n AND own.k = array_to_string(dx.t[pos + 1:pos + dx.n], ' ')),
slot AS (SELECT doc_id, item_id, body, shift, item_at, unnest(range(1, n + 1)) AS j, kinds, vals, found FROM met),
pairs AS (SELECT DISTINCT doc_id, item_id, body, shift, kinds[j] AS k, ltrim(vals[j], '^') AS x, ltrim(found[j], '^') AS y FROM slot WHERE kinds[j] IN ('<num>', '<unit>', '<name>')),
fair AS (SELECT doc_id, item_id, body, shift, count(*) AS n_slots, count(DISTINCT k || ' ' || x) AS nx, count(DISTINCT k || ' ' || y) AS ny, bool_or(x <> y) AS other FROM pairs GROUP BY ALL),
one AS (SELECT doc_id, item_id, body, shift, count(DISTINCT item_at) AS n_matched FROM met GROUP BY ALL),
whole AS (SELECT item_id, body, greatest(1, len(w) - {WINDOW} + 1) AS n_windows FROM b),
good AS (SELECT one.*, n_windows, coalesce(n_slots, 0) AS n_slots, coalesce(other, false) AS other
  FROM one JOIN whole USING (item_id, body) LEFT JOIN fair USING (doc_id, item_id, body, shift)
  WHERE n_matched >= {COVERAGE} * n_windows AND (n_slots IS NULL OR nx = n_slots AND ny = n_slots)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched DESC, shift, n_windows DESC, n_slots DESC, other DESC) AS r FROM good)
SELECT doc_id, item_id, greatest(0, shift)::BIGINT AS first_word, n_matched::BIGINT AS n_matched, n_windows::BIGINT AS n_windows,
  n_matched / n_windows AS coverage, n_slots::BIGINT AS n_slots, other AS reparameterised FROM best WHERE r = 1
"""
