"""Counts the legend items of drawings: tags first, then glyph geometry, then a model for what is left.

All drawings given are counted in one set of DataFrames; the drawing is a key column. Tags are authoritative, then symbols, then vision.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmeter.functions import geometry as g
from sheetmeter.operators import items as it
from sheetmeter.operators import legends as lg
from sheetmeter.operators import symbols as sy
from sheetmeter.operators import tags
from sheetmeter.operators import titleblock as tb
from sheetmeter.tables import written

KEYS = ["drawing_id", "page"]
#: A page with fewer painted paths is taken for a scan.
RASTER_PATHS = 50
DETECTIONS = ["drawing_id", "page", "item_id", "x", "y", "w", "h", "confidence", "source", "multiplier", "needs_review", "review_reason"]


class VisionPass(Protocol):
    """What the engine asks of a model pass."""

    def find_legends(self, pages: DataFrame) -> DataFrame:
        """Legend entries (as read_legends gives them) of the first page of each drawing on which a legend is seen."""

    def detect(self, pages: DataFrame, items: DataFrame, exclusions: DataFrame, legends: DataFrame) -> DataFrame:
        """Detections (columns DETECTIONS) of the items (drawing_id, item_id, tag, description) on the pages."""

    def usage(self) -> dict:
        """model, calls, cached_calls, prompt_tokens, output_tokens, thought_tokens, cost_usd."""


def no_usage(model: str = "none") -> dict:
    return {"model": model, "calls": 0, "cached_calls": 0, "prompt_tokens": 0, "output_tokens": 0, "thought_tokens": 0, "cost_usd": 0.0}


@dataclass
class Takeoff:
    """pages, legend entries, items, title_blocks, exclusions, detections, counts, stats (None without symbols), warnings (drawing_id, warning)."""

    pages: DataFrame
    entries: DataFrame
    items: DataFrame
    title_blocks: DataFrame
    exclusions: DataFrame
    detections: DataFrame
    counts: DataFrame
    stats: DataFrame | None
    warnings: DataFrame
    usage: dict = field(default_factory=no_usage)


def _shown(entries: DataFrame) -> DataFrame:
    """The regions of the legends printed on the sheets."""
    return entries.select(*KEYS, "legend", "legend_box.*").distinct().select(*KEYS, F.lit("legend").alias("kind"), "x", "y", "w", "h")


def with_signatures(entries: DataFrame, shapes: DataFrame) -> DataFrame:
    """Legend entries with the signature of the glyph in their symbol cell; null without one."""
    keys = [*KEYS, "legend", "item_seq"]
    found = sy.signatures(sy.glyphs(shapes, entries.where("symbol_box is not null").select(*keys, "symbol_box")), keys)
    return entries.join(found, keys, "left")


def read_entries(spans: DataFrame, pages: DataFrame, structure: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """The legend entries of all pages; headings inside title blocks and notes do not count."""
    entries = written(lg.read_legends(spans, pages, structure))
    return with_signatures(entries, shapes) if shapes is not None else entries.withColumn("signature", F.lit(None).cast(sy.SIGNATURE))


def merged_items(entries: DataFrame) -> DataFrame:
    """drawing_id, item_seq, item_id, tag, description, reference, signature: the first entry of each tag or description."""
    out = lg.legend_items(entries)
    return out.select("drawing_id", (F.col("legend_seq") * 10_000 + F.col("item_seq")).alias("item_seq"), F.col("id").alias("item_id"), "tag", "description", "reference", "signature")


def structure_of(spans: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Title blocks, and the regions of title blocks and notes."""
    titles = written(tb.read_title_blocks(spans, pages))
    return titles, written(tb.structural_boxes(titles, tb.notes_boxes(spans)))


def given_items(listed: DataFrame, pages: DataFrame) -> DataFrame:
    """The items of a legend file (item_seq, id, tag, description) as those of every drawing; the list is a legend's, tens of rows."""
    drawings = pages.select("drawing_id").distinct().withColumn("all", F.lit(1))
    return drawings.join(F.broadcast(listed.withColumn("all", F.lit(1))), "all").select("drawing_id", F.col("item_seq").cast("long").alias("item_seq"), F.col("id").alias("item_id"), "tag", "description", F.lit(None).cast("string").alias("reference"), F.lit(None).cast(sy.SIGNATURE).alias("signature"))


def vision_items(items: DataFrame, hits: DataFrame, paths: DataFrame | None, pages: DataFrame, matches: DataFrame | None, fallback: str, cross_check: bool) -> DataFrame:
    """The items to ask a model for. With a cross check all; else those without a hit: none (never), all (always, or without
    geometry, or on a scanned drawing), or (auto) those without a signature or whose anchor was seen."""
    if fallback not in ("never", "auto", "always"):
        raise ValueError("the fallback is never, auto or always")
    if cross_check:
        return items
    left = items.join(hits.select("drawing_id", "item_id").distinct(), ["drawing_id", "item_id"], "left_anti")
    if fallback == "never":
        return left.where("false")
    if fallback == "always" or paths is None or matches is None:
        return left
    raster = it.raster_drawings(paths, pages, RASTER_PATHS)
    seen = matches.where("anchors > 0").select("drawing_id", "item_id").distinct().withColumn("seen", F.lit(True))
    x = left.join(raster, "drawing_id", "left").join(seen, ["drawing_id", "item_id"], "left")
    return x.where(F.coalesce("raster", F.lit(False)) | F.col("signature").isNull() | F.col("seen").isNotNull()).select(*items.columns)


def count_drawings(spans: DataFrame, pages: DataFrame, paths: DataFrame | None = None, legend: str | DataFrame = "auto", vision: VisionPass | None = None, fallback: str = "auto", cross_check: bool = False, entries: DataFrame | None = None, items: DataFrame | None = None) -> Takeoff:
    """spans, pages, paths as read from the drawings; without paths symbols are not matched.

    legend: auto (the sheets' text, else the model), vector (the sheets' text), vision (the model), or the rows of a legend file. entries, items:
    what was read from the sheets before, and the item list to use (see bench.shared_items).
    """
    titles, structure = structure_of(spans, pages)
    shapes = written(sy.elements(sy.merge_hatch_bands(paths))) if paths is not None else None
    if entries is None:
        entries = read_entries(spans, pages, structure, shapes)
        if isinstance(legend, str) and legend == "vision":
            entries = entries.where("false")
        if isinstance(legend, str) and legend in ("auto", "vision") and vision is not None:
            without = pages.join(entries.select("drawing_id").distinct(), "drawing_id", "left_anti")
            entries = entries.unionByName(vision.find_legends(without), allowMissingColumns=True)
        entries = written(entries)
    if items is None:
        items = merged_items(entries) if isinstance(legend, str) else given_items(legend, pages)
    items = written(items)
    exclusions = written(_shown(entries).unionByName(structure))
    tagged = written(tags.tag_detections(spans, items.where("tag is not null"), exclusions))
    found, stats, matches = tagged, None, None
    if shapes is not None:
        wanted = items if cross_check else items.join(tagged.select("drawing_id", "item_id").distinct(), ["drawing_id", "item_id"], "left_anti")
        matches = written(sy.match_symbols(wanted, shapes, pages))
        symbols = written(sy.symbol_detections(matches, items, spans, exclusions))
        stats = sy.symbol_stats(wanted, matches, symbols)
        found = found.unionByName(symbols)
    asked = vision_items(items, found, paths, pages, matches, fallback, cross_check)
    warnings = [pages.select("drawing_id").distinct().join(items.select("drawing_id").distinct(), "drawing_id", "left_anti").select("drawing_id", F.lit("no legend found; nothing to count").alias("warning"))]
    if vision is not None:
        seen = written(vision.detect(pages, written(asked), exclusions, entries.select(*KEYS, "legend_box").distinct())).join(pages.select(*KEYS), KEYS, "left_semi")
        if not cross_check:
            seen = seen.join(found.select("drawing_id", "item_id").distinct(), ["drawing_id", "item_id"], "left_anti")
        found = found.unionByName(seen.select(*DETECTIONS))
    else:
        ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_seq", "item_id"))), lambda s: s["item_id"]), ", ")
        text = F.concat(F.lit("vision disabled: "), F.count("*").cast("string"), F.lit(" item(s) have no tagged instances and no vector symbol match ("), ids, F.lit(")"))
        warnings.append(asked.groupBy("drawing_id").agg(text.alias("warning")))
    if cross_check:
        apart = it.disagreements(found.join(items.where("tag is not null").select("drawing_id", "item_id"), ["drawing_id", "item_id"], "left_semi"), ("drawing_id",))
        warnings.append(apart.select("drawing_id", F.concat("item_id", F.lit(": vector count "), F.col("other").cast("string"), F.lit(" and vision count "), F.col("vision").cast("string"), F.lit(" disagree")).alias("warning")))
    counts = it.item_counts(items, counted(found) if cross_check else found, ("drawing_id",))
    said = warnings[0]
    for w in warnings[1:]:
        said = said.unionByName(w)
    return Takeoff(pages, entries, items, titles, exclusions, found, counts, stats, said, vision.usage() if vision else no_usage())


def counted(detections: DataFrame) -> DataFrame:
    """Of each item of a drawing the detections of its best source: tags, else symbols, else vision."""
    rank = F.when(F.col("source") == "vector", 0).when(F.col("source") == "symbol", 1).otherwise(2)
    best = detections.groupBy("drawing_id", "item_id").agg(F.min(rank).alias("_best"))
    return detections.join(best, ["drawing_id", "item_id"]).where(rank == F.col("_best")).drop("_best")


def marks(detections: DataFrame) -> DataFrame:
    """Detections as marks on the drawing: box, label (with xN for a multiplier) and colour by how they were found."""
    label = F.when(F.col("multiplier") > 1, F.concat("item_id", F.lit(" x"), F.col("multiplier").cast("string"))).otherwise(F.col("item_id"))
    kind = F.when(F.col("needs_review"), "review").otherwise(F.col("source"))
    return detections.select(*KEYS, g.box(*[F.col(c) for c in "xywh"]).alias("box"), label.alias("label"), kind.alias("colour"))
