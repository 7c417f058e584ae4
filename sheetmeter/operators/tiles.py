"""Tiling of page images, model answers, and de-duplication of detections that several tiles saw."""

from __future__ import annotations

import math
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def origins(length: Column, size: int = 1024, overlap: int = 160) -> Column:
    """Tile origins along one side; the last is flush with the end."""
    step = size - overlap
    return F.when(length <= size, F.array(F.lit(0).cast("long"))).otherwise(F.array_union(F.sequence(F.lit(0).cast("long"), length - size - 1, F.lit(step).cast("long")), F.array(length - size)))


def starts(length: int, size: int = 1024, overlap: int = 160) -> list[int]:
    """origins() for one number."""
    return [0] if length <= size else [*range(0, length - size, size - overlap), length - size]


def tiles(pages: DataFrame, size: int = 1024, overlap: int = 160) -> DataFrame:
    """pages: width, height in pixels (long). One row per tile, in row-major order: px, py."""
    return pages.withColumn("py", F.explode(origins(F.col("height"), size, overlap))).withColumn("px", F.explode(origins(F.col("width"), size, overlap)))


def detections_of(answers: DataFrame, known: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """answers: a JSON text of {d: [{t, b, c}]}. One row per detection of a known item (of the same keys), confidence held in 0 to 1."""
    d = answers.withColumn("d", F.explode(F.from_json("answer", "struct<d: array<struct<t: string, b: array<double>, c: double>>>")["d"]))
    c = F.when(F.col("d.c").isNull() | F.isnan("d.c"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("d.c"))))
    return d.select(*answers.columns, F.col("d.t").alias("item_id"), F.col("d.b").alias("raw"), c.alias("confidence")).join(known.select(*(keys or []), "item_id").distinct(), [*(keys or []), "item_id"], "left_semi")


def _overlap(a: dict, b: dict) -> float:
    w = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
    h = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    return w * h / (a["w"] * a["h"] + b["w"] * b["h"] - w * h) if w > 0 and h > 0 else 0.0


def merge_sightings(rows: list[dict], iou: float = 0.3, reach: float = 1.5, same_iou: float = 0.6) -> list[dict]:
    """The fold over one page: the surest sightings first, each joins the nearest kept one that it repeats.

    Kept rows are filed in cells as wide as the farthest reach, so that only neighbours are compared.
    """
    ordered = sorted(rows, key=lambda r: (-r["confidence"], -r["edge_margin"], r["seq"], *(str(r.get(c)) for c in ("item_id", "tile", "x", "y", "w", "h"))))
    if not ordered:
        return []
    wide = max(1e-9, max(reach * (r["w"] + r["h"]) / 2 for r in ordered), max(max(r["w"], r["h"]) for r in ordered))
    cells: dict[tuple[int, int], list[dict]] = {}
    kept: list[dict] = []
    for r in ordered:
        cx, cy = r["x"] + r["w"] / 2, r["y"] + r["h"] / 2
        i, j = math.floor(cx / wide), math.floor(cy / wide)
        near, least = None, math.inf
        for k in sorted((k for a in (-1, 0, 1) for b in (-1, 0, 1) for k in cells.get((i + a, j + b), ())), key=lambda k: k["n"]):
            apart = math.hypot(k["x"] + k["w"] / 2 - cx, k["y"] + k["h"] / 2 - cy)
            if k["tile"] == r["tile"]:
                same = _overlap(k, r) >= same_iou
            else:
                same = _overlap(k, r) >= iou or apart < reach * (r["w"] + r["h"] + k["w"] + k["h"]) / 4
            if same and apart < least:
                near, least = k, apart
        if near is None:
            new = dict(r, n=len(kept), cell=(i, j))
            kept.append(new)
            cells.setdefault((i, j), []).append(new)
            continue
        if near["item_id"] == r["item_id"]:
            if r["edge_margin"] > near["edge_margin"] and r["confidence"] >= near["confidence"] - 0.05:
                near.update({c: r[c] for c in ("x", "y", "w", "h", "edge_margin")})
                cells[near["cell"]].remove(near)
                near["cell"] = (math.floor((near["x"] + near["w"] / 2) / wide), math.floor((near["y"] + near["h"] / 2) / wide))
                cells.setdefault(near["cell"], []).append(near)
        elif not near["needs_review"]:
            near["needs_review"] = True
            near["review_reason"] = f"also seen as {r['item_id']} ({r['confidence']:.2f})"
    return kept


def dedupe(detections: DataFrame, drawing: str = "long", page: str = "long") -> DataFrame:
    """drawing, page: the types of these keys. Tile detections (drawing_id, page, seq, item_id, x, y, w, h, confidence, edge_margin, tile, needs_review, review_reason) merged per page."""
    names = ["drawing_id", "page", "seq", "item_id", "x", "y", "w", "h", "confidence", "needs_review", "review_reason"]
    kind = f"drawing_id {drawing}, page {page}, seq long, item_id string, x double, y double, w double, h double, confidence double, needs_review boolean, review_reason string"

    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [arrow[drawing], arrow[page], pa.int64(), pa.string()] + [pa.float64()] * 5 + [pa.bool_(), pa.string()]

    def run(batches):
        def rows():
            for b in batches:
                yield from b.to_pylist()

        out: list[dict] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in zip(names, types, strict=True)], names)

        for _, page in groupby(rows(), key=lambda r: (r["drawing_id"], r["page"])):  # one page in memory at a time
            out += merge_sightings(list(page))
            if len(out) >= 10_000:
                yield batch()
                out = []
        yield batch()

    return detections.repartition("drawing_id", "page").sortWithinPartitions("drawing_id", "page").mapInArrow(run, kind)


def second_look(detections: DataFrame, answers: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """answers: id, item, confidence of a second look. known: the item ids there are (of each drawing); without it every item is known.

    Agreement lifts the confidence and, from 0.9 on, clears a flag; none drops the detection from 0.8 on and flags it below; another known item
    reclassifies from 0.8 on; anything else flags.
    """
    x = detections.join(answers.select("id", "item", F.col("confidence").alias("c")), "id", "left")
    is_known = F.lit(True)
    if known is not None:
        k = known.select(*[F.col(c).alias(f"k_{c}") for c in known.columns]).distinct().withColumn("k", F.lit(True))
        same = F.col("item") == F.col("k_item_id")
        for c in known.columns:
            if c != "item_id":
                same &= F.col(c) == F.col(f"k_{c}")
        x = x.join(k, same, "left").drop(*[f"k_{c}" for c in known.columns])
        is_known = F.col("k").isNotNull()
    agree, none = F.col("item") == F.col("item_id"), F.col("item") == "none"
    x = x.where(~F.coalesce(none & (F.col("c") >= 0.8), F.lit(False)))
    other = ~agree & ~none & is_known & (F.col("c") >= 0.8)
    sure = F.when(agree, F.greatest("confidence", "c")).when(other, F.col("c")).otherwise(F.col("confidence"))
    cleared = agree & (F.col("c") >= 0.9)
    review = F.when(F.col("item").isNull(), F.col("needs_review")).when(cleared, False).when(agree, F.col("needs_review")).otherwise(True)
    new = {"needs_review": review, "item_id": F.when(other, F.col("item")).otherwise(F.col("item_id")), "confidence": sure}
    if "review_reason" in detections.columns:
        why = F.when(none, F.format_string("second look saw no symbol (%.2f)", "c")).when(other, F.format_string("reclassified from %s on second look (%.2f)", "item_id", "c")).otherwise(F.format_string("second look said %s (%.2f)", "item", "c"))
        new["review_reason"] = F.when(F.col("item").isNull(), F.col("review_reason")).when(cleared, F.lit(None)).when(agree, F.col("review_reason")).otherwise(why)
    return x.withColumns(new).drop("item", "c", "k")
