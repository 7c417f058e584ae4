"""Counts of items: aggregation with zero rows, merging over drawings, bill sections, pivot, precedence, warnings, legends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetmeter.functions import text as t


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """Adds the place (from 1) of each row within its keys by order, which has to begin as the bucket does.

    Rows are numbered within a bucket; only the buckets' sizes are summed along the order, so no key's rows meet in one task.
    """
    x = df.withColumn("_b", bucket)
    sizes = x.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_b").alias("_c"), F.coalesce(before, F.lit(0)).alias("_before"))
    same = F.col("_b").eqNullSafe(F.col("_c"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    place = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    return x.join(sizes, same).withColumn(name, (place + F.col("_before")).cast("long")).drop("_b", "_c", "_before", *[f"_{k}" for k in keys])


def item_counts(items: DataFrame, detections: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """items: item_id, tag, description (and keys). Per item the count, reviews, source (none, the one, or mixed) and pages seen; items never seen stay."""
    pages = detections.groupBy(*keys, "item_id", "page").agg(F.sum("multiplier").cast("long").alias("n"), F.sum(F.col("needs_review").cast("long")).alias("r"), F.min("source").alias("lo"), F.max("source").alias("hi"))
    one = pages.groupBy(*keys, "item_id").agg(F.sum("n").alias("count"), F.sum("r").alias("needs_review"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("pages"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("page").cast("string"), "n")))).alias("per_page"))
    zero = F.lit(0).cast("long")
    return items.join(one, [*keys, "item_id"], "left").select(*keys, "item_id", "tag", "description", F.coalesce("count", zero).alias("count"), F.coalesce("needs_review", zero).alias("needs_review"), F.when(F.col("lo").isNull(), "none").when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("mixed").alias("source"), F.coalesce("pages", zero).alias("pages"), "per_page")


def merge_items(counts: DataFrame) -> DataFrame:
    """Item counts of several drawings as one bill line per key (tag, else item_id); the first drawing's description stands. per_page, where it is known, is
    kept by drawing#page."""
    order = F.struct("drawing_id", "item_seq") if "item_seq" in counts.columns else F.col("drawing_id")
    pages = [F.map_from_entries(F.array_sort(F.flatten(F.collect_list(F.transform(F.map_entries("per_page"), lambda e: F.struct(F.concat(F.col("drawing_id").cast("string"), F.lit("#"), e["key"]).alias("key"), e["value"].alias("value"))))))).alias("per_page")] if "per_page" in counts.columns else []
    return counts.groupBy(F.coalesce("tag", "item_id").alias("key")).agg(F.sum("count").cast("long").alias("count"), F.sum("needs_review").cast("long").alias("needs_review"), F.when(F.min("source") == F.max("source"), F.min("source")).otherwise("mixed").alias("source"), F.min_by("description", order).alias("description"), F.count("*").alias("drawings"), F.bool_or(F.col("tag").isNotNull()).alias("tagged"), *pages)


def bill(lines: DataFrame) -> DataFrame:
    """lines: key, description, count. Adds section and the reference within it (A/1, A/2, ...)."""
    section = lines.withColumn("section", t.section_of(F.col("description")))
    placed = numbered(section, ["section"], F.substring("key", 1, 3), ["key"], "place")
    return placed.withColumn("ref", F.concat_ws("/", "section", F.col("place").cast("string"))).drop("place")


def bill_totals(lines: DataFrame) -> DataFrame:
    """Section subtotals and the grand total (section null)."""
    return lines.withColumn("section", t.section_of(F.col("description"))).rollup("section").agg(F.sum("count").cast("long").alias("count"), F.count("*").alias("lines"))


def counts_pivot(counts: DataFrame, columns: list[str]) -> DataFrame:
    """counts: key, drawing, count. One column per drawing, missing as 0, and the total."""
    wide = counts.groupBy("key").pivot("drawing", columns).agg(F.sum("count").cast("long"))
    return wide.fillna(0).withColumn("total", sum((F.col(f"`{c}`") for c in columns), F.lit(0).cast("long")))


def by_precedence(*ranked: DataFrame) -> DataFrame:
    """Detections of several sources, best first; a source's detections of an item count only if no better source has the item in the drawing."""
    out = ranked[0]
    for d in ranked[1:]:
        out = out.unionByName(d.join(out.select("drawing_id", "item_id").distinct(), ["drawing_id", "item_id"], "left_anti"))
    return out


def disagreements(detections: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Items that vision and the rest count differently: both above 0 and apart by more than 1 and 5 %."""
    vision = F.col("source") == "vision"
    n = detections.groupBy(*keys, "item_id").agg(F.sum(F.when(vision, F.col("multiplier")).otherwise(0)).cast("long").alias("vision"), F.sum(F.when(vision, 0).otherwise(F.col("multiplier"))).cast("long").alias("other"))
    return n.where((F.col("vision") > 0) & (F.col("other") > 0) & (F.abs(F.col("vision") - F.col("other")) > F.greatest(F.lit(1.0), F.col("other") * 0.05)))


def merge_legends(items: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """items: legend_seq, item_seq, tag, description (and keys). The first of each tag, or of each description without one, stays; untagged ones are numbered L1, L2, ..."""
    keys = keys or []
    key = F.coalesce("tag", F.concat(F.lit("desc:"), "description"))
    w = Window.partitionBy(*keys, key).orderBy("legend_seq", "item_seq")
    first = items.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r").withColumn("bare", F.col("tag").isNull())
    placed = numbered(first, [*keys, "bare"], F.col("legend_seq"), ["legend_seq", "item_seq"], "place")
    return placed.withColumn("id", F.coalesce("tag", F.concat(F.lit("L"), F.col("place").cast("string")))).drop("bare", "place")


def raster_drawings(paths: DataFrame, pages: DataFrame, least: int = 50) -> DataFrame:
    """Drawings with a page of fewer than `least` paths."""
    n = pages.join(paths.groupBy("drawing_id", "page").agg(F.count("*").alias("n")), ["drawing_id", "page"], "left")
    return n.groupBy("drawing_id").agg(F.bool_or(F.coalesce("n", F.lit(0)) < least).alias("raster"))
