"""Title block and notes of a page, from its spans: labels with the value right of or below them, and the regions both take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetmeter.functions import geometry as g
from sheetmeter.functions import text as t

KEYS = ["drawing_id", "page"]


def values_near(labels: DataFrame, spans: DataFrame) -> DataFrame:
    """labels, spans: drawing_id, page, seq, str, n (normalised), x, y, w, h. Per label (page, seq) its value, if any.

    The nearest span to the right on the same line is taken, unless that is a label itself or there is none; then the nearest below, unless
    that is a label. Ties go to the span that comes first.
    """
    a = labels.select(*KEYS, F.col("seq").alias("label"), *[F.col(c).alias(f"l{c}") for c in "xywh"])
    b = spans.select(*KEYS, "seq", "str", "n", *"xywh")
    both = a.join(b, KEYS).where("seq <> label")
    lx, ly, lw, lh = (F.col(f"l{c}") for c in "xywh")
    x, y, h = F.col("x"), F.col("y"), F.col("h")
    beside = (F.abs(y + h / 2 - (ly + lh / 2)) < lh) & (x > lx + lw - 1) & (x - (lx + lw) < 30 * lh)
    below = (y > ly + lh / 2) & (y - (ly + lh) < 2 * lh) & (F.abs(x - lx) < 4 * lh)
    first = lambda where, at: F.min(F.when(where, F.struct(at.alias("at"), "seq", "str", F.col("n").rlike(t.LABELS).alias("label"))))
    best = both.groupBy(*KEYS, "label").agg(first(beside, x).alias("beside"), first(below, y).alias("below"))
    value = lambda c: F.when(~F.col(f"{c}.label"), t.stripped(F.col(f"{c}.str")))
    return best.select(*KEYS, F.col("label").alias("seq"), F.coalesce(value("beside"), value("below")).alias("value")).where("value is not null")


def _parsed(kind: str, n: Column) -> Column:
    inline = F.regexp_extract(n, {"number": t.DRAWING_NO, "title": t.TITLE}.get(kind, t.SCALE), 1)
    return F.when(inline != "", inline)


def read_title_blocks(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """drawing_id, page, drawing_number, title, scale (int) and box (null without a label) of every page."""
    s = spans.withColumn("n", t.normalise("str"))
    kind = F.when(F.col("n").rlike(t.DRAWING_NO), "number").when(F.col("n").rlike(t.TITLE), "title").when(F.col("n").rlike(r"\ASCALE\b"), "scale")
    labels = s.withColumn("kind", kind).where(F.col("kind").isNotNull() | F.col("n").rlike(t.LABELS))
    near = values_near(labels.where("kind is not null"), s)
    known = labels.join(near, [*KEYS, "seq"], "left")
    n, v = F.col("n"), F.col("value")
    scale = F.coalesce(_parsed("scale", n), _parsed("scale", t.normalise(F.coalesce(v, F.lit("")))))
    found = F.when(F.col("kind") == "scale", scale).when(F.col("kind") == "number", F.coalesce(_parsed("number", n), v)).when(F.col("kind") == "title", F.coalesce(_parsed("title", n), v))
    known = known.withColumn("found", found)
    first = known.where("found is not null").groupBy(*KEYS, "kind").agg(F.min(F.struct("seq", "found")).alias("m"))
    of = first.groupBy(*KEYS).agg(*[F.max(F.when(F.col("kind") == k, F.col("m"))).alias(k) for k in ("number", "title", "scale")])
    # a label counts while its value is still open, and any label of the list at all times
    known = known.join(first.select(*KEYS, "kind", F.col("m.seq").alias("until")), [*KEYS, "kind"], "left")
    counted = known.where(n.rlike(t.LABELS) | F.col("until").isNull() | (F.col("seq") <= F.col("until")))
    area = counted.groupBy(*KEYS).agg(g.union_box().alias("b"))
    bare = s.withColumn("found", _parsed("scale", n)).where("found is not null").groupBy(*KEYS).agg(F.min_by("found", "seq").alias("bare"))
    out = pages.join(of, KEYS, "left").join(area, KEYS, "left").join(bare, KEYS, "left")
    pad = F.least(F.lit(24.0), F.col("b.h") * 0.3 + 12)
    x = F.col("b.x") - pad
    box = F.when(F.col("b").isNotNull(), g.box(x, F.col("b.y") - pad, F.col("width") - x, F.col("b.h") + 2 * pad))
    return out.select(*KEYS, F.col("number.found").alias("drawing_number"), F.col("title.found").alias("title"), F.coalesce("scale.found", "bare").cast("int").alias("scale"), box.alias("box"))


def notes_boxes(spans: DataFrame) -> DataFrame:
    """drawing_id, page and box of the notes: from the first NOTES heading to the bottom of the long lines in its column."""
    heads = spans.where(t.normalise("str").rlike(t.NOTES)).groupBy(*KEYS).agg(F.min_by(F.struct("x", "y", "w", "h"), "seq").alias("head"))
    long = spans.where(F.length(t.stripped(F.col("str"))) > 12)
    x, y, h = F.col("head.x"), F.col("head.y"), F.col("head.h")
    column = long.join(heads, KEYS).where((F.col("y") >= y) & (F.col("x") >= x - h) & (F.col("x") < x + 2 * h)).select(*KEYS, "x", "y", "w", "h", "head")
    every = column.unionByName(heads.select(*KEYS, "head.x", "head.y", "head.w", "head.h", "head"))
    area = every.groupBy(*KEYS).agg(g.union_box().alias("b"), F.max("w").alias("widest"), F.first("head.h").alias("h"))
    return area.select(*KEYS, g.expand(g.box(F.col("b.x"), F.col("b.y"), F.col("widest"), F.col("b.h")), F.col("h")).alias("box"))


def structural_boxes(titles: DataFrame, notes: DataFrame) -> DataFrame:
    """The regions of title blocks and notes: drawing_id, page, kind, x, y, w, h."""
    of = lambda df, kind: df.where("box is not null").select(*KEYS, F.lit(kind).alias("kind"), "box.*")
    return of(titles, "title").unionByName(of(notes, "notes"))
