"""Tagged instances: spans whose text is a legend tag, outside excluded regions, twins drawn inside one symbol counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmeter.functions import geometry as g
from sheetmeter.functions import text as t


def _in_box(boxes: DataFrame):
    b = boxes.select(F.col("drawing_id").alias("b_d"), F.col("page").alias("b_p"), *[F.col(k).alias(f"b_{k}") for k in "xywh"])
    return b, (F.col("drawing_id") == F.col("b_d")) & (F.col("page") == F.col("b_p")) & g.center_inside("b_", "")


def outside(spans: DataFrame, boxes: DataFrame) -> DataFrame:
    """Spans whose centre lies in no box of the same drawing and page: an equality join on the page, the box as residual."""
    b, within = _in_box(boxes)
    return spans.join(b, within, "left_anti")


def inside(spans: DataFrame, boxes: DataFrame) -> DataFrame:
    b, within = _in_box(boxes)
    return spans.join(b, within, "left_semi")


def match_tags(spans: DataFrame, tags: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """spans with tag and multiplier, by the first reading that is one of the tags (column tag), of the same keys if any are given.

    A span's readings are worked out in its own row and looked up in the list of the tags, one row for each key (a legend holds tens of tags),
    so spans are neither exploded nor shuffled for themselves.
    """
    known = tags.where("tag is not null").groupBy(*keys).agg(F.collect_set("tag").alias("known"))
    read = spans.withColumn("readings", t.tag_candidates(t.normalise("str")))
    if keys:
        read = read.join(known, list(keys))
    else:  # the list is a single row
        read = read.withColumn("all", F.lit(1)).join(F.broadcast(known.withColumn("all", F.lit(1))), "all").drop("all")
    read = read.withColumn("m", F.get(F.filter("readings", lambda c: F.array_contains("known", c["tag"])), 0)).where("m is not null")
    return read.withColumns({"tag": F.col("m.tag"), "multiplier": F.col("m.multiplier")}).drop("readings", "known", "m")


def without_twins(hits: DataFrame) -> DataFrame:
    """In order of seq, a hit goes if a kept one of its tag and page is nearer than min(8, 2.5 font sizes); kept boxes are rounded first.

    A fold, since what is kept decides what goes; a group is one tag on one page of one drawing.
    """
    cx, cy = g.center()
    r = g.round_box("")
    rows = hits.select("drawing_id", "page", "tag", F.struct("seq", "multiplier", cx.alias("cx"), cy.alias("cy"), F.least(F.lit(8.0), F.col("font_size") * 2.5).alias("r"), (r["x"] + r["w"] / 2).alias("kx"), (r["y"] + r["h"] / 2).alias("ky"), r.alias("box")).alias("s"))
    lists = rows.groupBy("drawing_id", "page", "tag").agg(F.array_sort(F.collect_list("s")).alias("all"))
    kind = dict(lists.dtypes)["all"]
    near = lambda s: lambda k: F.sqrt((k["kx"] - s["cx"]) * (k["kx"] - s["cx"]) + (k["ky"] - s["cy"]) * (k["ky"] - s["cy"])) < s["r"]
    kept = F.aggregate("all", F.array().cast(kind), lambda acc, s: F.when(F.exists(acc, near(s)), acc).otherwise(F.concat(acc, F.array(s))))
    return lists.select("drawing_id", "page", "tag", F.explode(kept).alias("s")).select("drawing_id", "page", "tag", "s.seq", "s.multiplier", "s.box")


def tag_detections(spans: DataFrame, items: DataFrame, exclusions: DataFrame) -> DataFrame:
    """items: drawing_id, tag. The tagged instances of each drawing as detections."""
    kept = without_twins(outside(match_tags(spans, items, ("drawing_id",)), exclusions))
    return kept.select("drawing_id", "page", F.col("tag").alias("item_id"), "box.*", F.lit(1.0).alias("confidence"), F.lit("vector").alias("source"), F.col("multiplier").cast("int").alias("multiplier"), F.lit(False).alias("needs_review"), F.lit(None).cast("string").alias("review_reason"))


def count_tags(spans: DataFrame, tags: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Per drawing and tag the sum of multipliers and the spans counted, one for twins that stand inside one symbol."""
    hits = without_twins(outside(match_tags(spans, tags), exclusions))
    return hits.groupBy("drawing_id", "tag").agg(F.sum("multiplier").cast("long").alias("n"), F.count("*").alias("spans"))
