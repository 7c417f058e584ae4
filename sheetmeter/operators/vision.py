"""The model pass: page images cut into tiles, a client asked about each, answers turned into detections, merged and looked at again.

The client is handed in: anything with generate(request) -> response text of one JSON document. Requests are rows; the same request is asked once, answers are
kept in a table by request key, and the spend cap is checked on the driver before each round of calls.
"""

from __future__ import annotations

import base64
import json
import struct
import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetmeter.functions import geometry as g
from sheetmeter.functions import text as t
from sheetmeter.tables import written

from . import layout, scoring, tags, tiles
from . import legends as lg


class Client(Protocol):
    model: str

    def generate(self, request: dict) -> dict:
        """request: parts (texts and base64 PNG images) and schema. The response: candidates of parts, and usage counts. Raises Retry for
        what may pass, any other exception for what will not."""


class Retry(Exception):
    """A failure worth trying again: kind is network, auth or busy."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(message)
        self.kind = kind


class SpendCapError(RuntimeError):
    """The cost so far has reached the cap."""


# Tries by kind of failure; defaults of the pass.
TRIES = {"network": 5, "auth": 3, "busy": 6}
MAX_SPEND = 2.0


@dataclass
class Settings:
    dpi: int = 200
    tile: int = 1024
    overlap: int = 160
    concurrency: int = 4
    verify: bool = True
    threshold: float = 0.75
    isolation: float = 6.0
    batch: int = 12
    context: float = 60.0
    max_spend: float = MAX_SPEND
    least_ink: float = 0.0005


# ---- images: eight-bit grey, colour or with alpha, not interlaced

def read_png(data: bytes) -> np.ndarray:
    """Rows of pixels (height, width, channels)."""
    from sheetmeter.sources.pdf import _unpredicted

    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, head = 8, [], b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = data[at + 8 : at + 8 + size]
        elif kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += size + 12
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlaced:
        raise ValueError("only eight-bit grey and colour images, not interlaced, are read")
    raw = _unpredicted(zlib.decompress(b"".join(packed)), {"Predictor": 15, "Colors": channels, "Columns": width})
    return np.frombuffer(raw, np.uint8).reshape(height, width, channels)


def write_png(pixels: np.ndarray) -> bytes:
    height, width, channels = pixels.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def crop(pixels: np.ndarray, x: float, y: float, w: float, h: float, scale: float = 1.0) -> np.ndarray:
    """The window, cut at the image's edges, drawn at another scale by the nearest pixels; at least one pixel."""
    x0, y0 = max(0, int(np.floor(x))), max(0, int(np.floor(y)))
    wide, high = min(pixels.shape[1] - x0, int(np.ceil(w))), min(pixels.shape[0] - y0, int(np.ceil(h)))
    if wide < 1 or high < 1:
        return np.full((1, 1, pixels.shape[2]), 255, np.uint8)
    n, m = max(1, round(high * scale)), max(1, round(wide * scale))
    part = pixels[y0 : y0 + high, x0 : x0 + wide]
    return part if (n, m) == (high, wide) else part[(np.arange(n) * high // n)[:, None], (np.arange(m) * wide // m)[None, :]]


def ink(pixels: np.ndarray, step: int = 4) -> float:
    """The share of dark pixels, every `step` along both sides."""
    seen = pixels[::step, ::step, : 3 if pixels.shape[2] >= 3 else 1]
    return float((seen.mean(axis=2) < 128).mean()) if seen.size else 0.0


# ---- requests

def item_list(items: list[dict]) -> str:
    return "\n".join(f'- id "{i["item_id"]}"' + (f' (tag {i["tag"]})' if i.get("tag") else "") + f': {i["description"] or "see the symbol in the legend"}' for i in items)


def detection_schema(ids: list[str]) -> dict:
    box = {"type": "ARRAY", "items": {"type": "INTEGER"}, "minItems": 4, "maxItems": 4, "description": "[ymin, xmin, ymax, xmax], 0 to 1000 over the tile"}
    one = {"type": "OBJECT", "properties": {"t": {"type": "STRING", "enum": ids}, "b": box, "c": {"type": "NUMBER", "description": "confidence, 0 to 1"}}, "required": ["t", "b", "c"]}
    return {"type": "OBJECT", "properties": {"d": {"type": "ARRAY", "items": one}}, "required": ["d"]}


def detection_prompt(items: list[dict], with_legend: bool) -> str:
    return "\n".join([
        "Count symbols on one tile of a building services drawing.",
        "The legend image shows each symbol beside its id and description." if with_legend else "There is no legend image; go by the descriptions.",
        "Symbols to look for:", item_list(items),
        "Give one detection for each symbol drawn: t is its id, b its tight box [ymin, xmin, ymax, xmax] from 0 to 1000 over the tile, c your confidence.",
        "Go by shape, not by nearby lettering. Leave out text, dimensions, grid bubbles, title block, rows of the legend, symbols cut by the tile's edge, and any symbol not listed.",
        "Give an empty list if the tile has none.",
    ])


def verify_schema(ids: list[str]) -> dict:
    one = {"type": "OBJECT", "properties": {"index": {"type": "INTEGER"}, "item": {"type": "STRING", "enum": [*ids, "none"]}, "confidence": {"type": "NUMBER"}}, "required": ["index", "item", "confidence"]}
    return {"type": "OBJECT", "properties": {"answers": {"type": "ARRAY", "items": one}}, "required": ["answers"]}


def verify_prompt(items: list[dict], with_legend: bool) -> str:
    return "\n".join(["Each numbered crop is centred on one symbol of a building services drawing.", *(["The legend image shows each symbol beside its id."] if with_legend else []), "Legend items:", item_list(items), 'For each crop name the item at its centre, or "none" if that is lettering, a wall, a grid line or a symbol not listed, with a confidence from 0 to 1.'])


LEGEND_SCHEMA = {"type": "OBJECT", "properties": {"found": {"type": "BOOLEAN"}, "box_2d": {"type": "ARRAY", "items": {"type": "INTEGER"}, "minItems": 4, "maxItems": 4}, "rows": {"type": "ARRAY", "items": {"type": "OBJECT", "properties": {"tag": {"type": "STRING"}, "description": {"type": "STRING"}}, "required": ["tag", "description"]}}}, "required": ["found", "box_2d", "rows"]}
LEGEND_PROMPT = "Find the legend of this drawing sheet: the block that lists symbols with tag and description. Give its box [ymin, xmin, ymax, xmax] from 0 to 1000 over the image and one row per symbol, with an empty tag where none is printed. Title block, notes and schedules are no legend. Without a legend give found as false."


def image_part(pixels: np.ndarray) -> dict:
    return {"image": base64.b64encode(write_png(pixels)).decode()}


def request_of(parts: list[dict], schema: dict) -> str:
    return json.dumps({"parts": parts, "schema": schema}, sort_keys=True)


# ---- asking

def call(client: Client, request: str, pause: Callable[[float], None] = time.sleep) -> dict:
    """One answer: text (of all parts that are no thoughts) and token counts. Failures that may pass are tried again, waiting longer each time."""
    tries = dict.fromkeys(TRIES, 0)
    while True:
        try:
            response = client.generate(json.loads(request))
            break
        except Retry as e:
            tries[e.kind] += 1
            if tries[e.kind] >= TRIES[e.kind]:
                raise RuntimeError(f"the model was asked {tries[e.kind]} times: {e}") from e
            pause(min(60.0, 0.5 * 2 ** sum(tries.values())))
    parts = (((response.get("candidates") or [{}])[0].get("content") or {}).get("parts")) or []
    said = "".join(p.get("text", "") for p in parts if not p.get("thought"))
    if not said:
        raise RuntimeError("the model gave no answer")
    json.loads(said)
    use = response.get("usage") or {}
    return {"answer": said, "tokens_in": int(use.get("prompt", 0)), "tokens_out": int(use.get("output", 0)), "tokens_thought": int(use.get("thought", 0))}


ANSWERS = "key string, answer string, tokens_in long, tokens_out long, tokens_thought long"


def ask(requests: DataFrame, client: Client, concurrency: int) -> DataFrame:
    """requests: key, request. The answers, `concurrency` calls at a time."""

    def run(batches):
        for b in batches:
            rows = [{"key": k} | call(client, r) for k, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            cols = ["key", "answer", "tokens_in", "tokens_out", "tokens_thought"]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(cols, kinds, strict=True)], cols)

    return requests.select("key", "request").repartition(max(1, concurrency), "key").mapInArrow(run, ANSWERS)


@dataclass
class Asker:
    """Asks each request once: known answers come from the table in `cache` (a folder, Parquet), the others from the client, and are added to it."""

    client: Client
    concurrency: int = 4
    max_spend: float = MAX_SPEND
    cache: str | None = None
    used: dict = field(default_factory=lambda: {"calls": 0, "cached_calls": 0, "prompt_tokens": 0, "output_tokens": 0, "thought_tokens": 0})

    def cost(self) -> float:
        return (self.used["prompt_tokens"] * scoring.PRICE_IN + (self.used["output_tokens"] + self.used["thought_tokens"]) * scoring.PRICE_OUT) / 1e6

    def usage(self) -> dict:
        return {"model": self.client.model} | self.used | {"cost_usd": self.cost()}

    def answers(self, requests: DataFrame) -> DataFrame:
        """requests: request and other columns. The same rows with answer; one call for equal requests."""
        spark = requests.sparkSession
        rows = written(requests.withColumn("key", t.request_key(F.lit(self.client.model), F.col("request"))))
        wanted = rows.select("key", "request").dropDuplicates(["key"])
        known = None
        if self.cache:
            try:
                known = written(spark.read.schema(ANSWERS).parquet(self.cache).join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"]))
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        missing = wanted.join(known, "key", "left_anti") if known is not None else wanted
        new = None
        if missing.head(1):
            if self.cost() >= self.max_spend:
                raise SpendCapError(f"the calls so far cost ${self.cost():.2f} of ${self.max_spend:.2f}")
            new = written(ask(missing, self.client, self.concurrency))
            if self.cache:
                new.write.mode("append").parquet(self.cache)
        for df, cached in ((known, True), (new, False)):
            if df is not None:
                s = df.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens_in", "tokens_out", "tokens_thought")]).first()
                self.used["cached_calls" if cached else "calls"] += s[0]
                for name, v in zip(("prompt_tokens", "output_tokens", "thought_tokens"), s[1:], strict=True):
                    self.used[name] += v
        got = new if known is None else known if new is None else known.unionByName(new)
        return rows.join(got.select("key", "answer"), "key") if got is not None else rows.withColumn("answer", F.lit(None).cast("string"))


# ---- the second look

def doubtful(detections: DataFrame, threshold: float = 0.75, factor: float = 6.0) -> DataFrame:
    """detections: id besides the usual columns. Those of the model that are unsure, flagged, or alone: with no other detection nearer than `factor` times
    their size."""
    d = detections.withColumns({"x0": F.col("x"), "y0": F.col("y"), "_cx": F.col("x") + F.col("w") / 2, "_cy": F.col("y") + F.col("h") / 2, "_r": (F.col("w") + F.col("h")) / 2 * factor})
    unsure = (F.col("confidence") < threshold) | F.col("needs_review")
    keys = ["drawing_id", "page"]
    pick = d.where((F.col("source") == "vision") & ~unsure)
    # cells as wide as the reach of each size class, so that a few large symbols do not widen the cells of all others
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("_r"), F.lit(1e-6))))).cast("int")
    side = F.pow(F.lit(2.0), "_l")
    a = pick.withColumn("_l", level)
    near = F.explode(F.array(*[F.struct((F.floor(F.col("_cx") / side) + i).alias("i"), (F.floor(F.col("_cy") / side) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = a.withColumn("_c", near).select(*keys, "id", "_cx", "_cy", "_r", "_l", "_c.i", "_c.j")
    levels = a.select("_l").distinct()
    b = d.select(*keys, F.col("id").alias("other"), F.col("_cx").alias("_ox"), F.col("_cy").alias("_oy")).join(F.broadcast(levels), F.lit(True))  # a level is a power of two: a few dozen at most
    b = b.select(*keys, "other", "_ox", "_oy", "_l", F.floor(F.col("_ox") / side).alias("i"), F.floor(F.col("_oy") / side).alias("j"))
    meeting = [*keys, "_l", "i", "j"]
    b = b.withColumnsRenamed({k: f"o_{k}" for k in meeting}).hint(layout.SORTED)
    near = (F.col("other") != F.col("id")) & (F.hypot(F.col("_cx") - F.col("_ox"), F.col("_cy") - F.col("_oy")) < F.col("_r"))
    met = a.join(b, [*[F.col(k) == F.col(f"o_{k}") for k in meeting], near], "left_semi").select("id").distinct()  # the first neighbour settles a detection
    alone = pick.join(met.hint(layout.SORTED), "id", "left_anti") if factor > 0 else pick.where("false")
    return d.where((F.col("source") == "vision") & unsure).unionByName(alone).select(*detections.columns)


def batched(rows: DataFrame, size: int = 12) -> DataFrame:
    """Adds batch and index (from 1) per page, in order of id."""
    k = F.row_number().over(Window.partitionBy("drawing_id", "page").orderBy("id")) - 1
    return rows.withColumn("_k", k).withColumns({"batch": F.floor(F.col("_k") / size).cast("long"), "index": (F.col("_k") % size + 1).cast("long")}).drop("_k")


def by_index(batches: DataFrame, answers: DataFrame) -> DataFrame:
    """answers: drawing_id, page, batch, answer. The answer for each row of the batches; indexes beyond a batch are dropped, the last of several counts."""
    kind = "struct<answers: array<struct<index: bigint, item: string, confidence: double>>>"
    each = answers.select("drawing_id", "page", "batch", F.posexplode(F.from_json("answer", kind)["answers"]).alias("k", "a"))
    last = each.groupBy("drawing_id", "page", "batch", F.col("a.index").alias("index")).agg(F.max_by("a", "k").alias("a"))
    c = F.col("a.confidence")
    held = F.when(c.isNull() | F.isnan(c), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    return batches.select("drawing_id", "page", "batch", "index", "id").join(last, ["drawing_id", "page", "batch", "index"]).select("id", F.col("a.item").alias("item"), held.alias("confidence"))


# ---- the pass

class ModelPass:
    """A vision pass over rendered pages. images: drawing_id, page, dpi, width, height, content (PNG), for instance from
    drawings.read_page_images() or from a renderer of the caller's."""

    def __init__(self, client: Client, images: DataFrame, settings: Settings | None = None, cache: str | None = None):
        self.settings = settings or Settings()
        self.asker = Asker(client, self.settings.concurrency, self.settings.max_spend, cache)
        self.images = images

    def usage(self) -> dict:
        return self.asker.usage()

    def find_legends(self, pages: DataFrame) -> DataFrame:
        """The legend the model sees on the first page of each drawing that has one; pages are asked in order until then."""
        keys, asked, found = ["drawing_id", "page"], pages, None
        while asked.head(1):
            first = asked.groupBy("drawing_id").agg(F.min("page").alias("page"))
            got = written(self._legends(first.join(pages, keys)))
            found = got if found is None else found.unionByName(got)
            asked = asked.join(first, keys, "left_anti").join(got.select("drawing_id").distinct(), "drawing_id", "left_anti")
        return found if found is not None else pages.sparkSession.createDataFrame([], lg.ITEMS)

    def _legends(self, pages: DataFrame) -> DataFrame:
        def run(batches):
            for b in batches:
                out = []
                for content in b.column("content"):
                    pixels = read_png(content.as_py())
                    small = crop(pixels, 0, 0, pixels.shape[1], pixels.shape[0], min(1.0, 1600 / max(pixels.shape[:2])))
                    out.append(request_of([{"text": LEGEND_PROMPT}, image_part(small)], LEGEND_SCHEMA))
                yield pa.RecordBatch.from_arrays([b.column("drawing_id"), b.column("page"), pa.array(out, pa.string())], ["drawing_id", "page", "request"])

        pictures = pages.select("drawing_id", "page").join(self.images, ["drawing_id", "page"])
        asked = self.asker.answers(pictures.select("drawing_id", "page", "content").mapInArrow(run, "drawing_id string, page int, request string"))
        return legends_of(asked, pages)

    def detect(self, pages: DataFrame, items: DataFrame, exclusions: DataFrame, legends: DataFrame) -> DataFrame:
        s, keys = self.settings, ["drawing_id", "page"]
        wanted = items.groupBy("drawing_id").agg(F.array_sort(F.collect_list(F.struct("item_seq", "item_id", "tag", "description"))).alias("items"))
        legend = legends.groupBy("drawing_id").agg(F.min_by(F.struct("page", "legend_box"), "page").alias("legend"))
        crops = legend.select("drawing_id", "legend.page", "legend.legend_box").join(self.images, keys).select("drawing_id", F.struct("legend_box", "content", "dpi").alias("legend"))
        pictures = pages.select(*keys).join(self.images, keys).join(wanted, "drawing_id").join(crops, "drawing_id", "left")
        asked = self.asker.answers(written(pictures.select(*keys, "dpi", "content", "items", "legend").mapInArrow(_tile_requests(s), "drawing_id string, page int, dpi int, tile int, px int, py int, size_w int, size_h int, request string")))
        known = items.select("drawing_id", "item_id")
        raw = tiles.detections_of(asked, known, ["drawing_id"])
        place = g.tile_box_to_page(F.col("raw"), F.col("px"), F.col("py"), F.col("size_w"), F.col("size_h"), F.col("dpi"))
        boxes = raw.withColumn("b", place).where("b is not null").select(*keys, "tile", "px", "py", "size_w", "size_h", "dpi", "item_id", "confidence", "b.*")
        seq = F.row_number().over(Window.partitionBy(*keys).orderBy("tile", "y", "x", "item_id", "w", "h", "confidence"))
        edge = g.edge_margin(F.col("px"), F.col("py"), F.col("size_w"), F.col("size_h"), F.col("dpi"))
        seen = tags.outside(boxes, exclusions).withColumns({"seq": seq.cast("long"), "edge_margin": edge, "needs_review": F.lit(False), "review_reason": F.lit(None).cast("string")})
        merged = tiles.dedupe(seen, "string", "int").withColumns({"source": F.lit("vision"), "multiplier": F.lit(1), "id": F.concat_ws("#", "drawing_id", "page", "seq")})
        if s.verify:
            merged = self._verified(written(merged), items, pictures)
        round_box = g.round_box("")
        return merged.select(*keys, "item_id", *[round_box[c].alias(c) for c in "xywh"], g.rounded(F.col("confidence"), 2).alias("confidence"), "source", "multiplier", "needs_review", "review_reason")

    def _verified(self, merged: DataFrame, items: DataFrame, pictures: DataFrame) -> DataFrame:
        s, keys = self.settings, ["drawing_id", "page"]
        batches = written(batched(doubtful(merged, s.threshold, s.isolation), s.batch))
        if not batches.head(1):
            return merged
        lists = batches.groupBy(*keys, "batch").agg(F.array_sort(F.collect_list(F.struct("index", "item_id", "x", "y", "w", "h"))).alias("crops"))
        asked = self.asker.answers(written(lists.join(pictures, keys).select(*keys, "batch", "dpi", "content", "items", "legend", "crops").mapInArrow(_crop_requests(s), "drawing_id string, page int, batch long, request string")))
        return tiles.second_look(merged, by_index(batches, asked), items.select("drawing_id", "item_id"))


def legends_of(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """asked: drawing_id, page, answer. Legend entries of the pages where the model found one; the box is grown by 6 points and held on the page."""
    kind = "struct<found: boolean, box_2d: array<double>, rows: array<struct<tag: string, description: string>>>"
    a = asked.withColumn("a", F.from_json("answer", kind)).where("a.found and size(a.rows) > 0").join(pages.select("drawing_id", "page", "width", "height"), ["drawing_id", "page"])
    at = lambda i, d: F.coalesce(F.get("a.box_2d", F.lit(i)), F.lit(d)) / 1000
    box = g.expand(g.box(at(1, 0.0) * F.col("width"), at(0, 0.0) * F.col("height"), (at(3, 1000.0) - at(1, 0.0)) * F.col("width"), (at(2, 1000.0) - at(0, 0.0)) * F.col("height")), F.lit(6.0))
    a = a.withColumn("grown", box).withColumn("box", g.clamp_to_page(F.col("grown"), F.col("width"), F.col("height")))
    rows = a.select("drawing_id", "page", "box", F.posexplode("a.rows").alias("k", "r")).withColumn("tag", t.model_tag(F.col("r.tag")))
    n = F.row_number().over(Window.partitionBy("drawing_id", "page", F.col("tag").isNull()).orderBy("k"))
    none = F.lit(None)
    return rows.select("drawing_id", "page", F.lit(0).alias("legend"), (F.col("k") + 1).alias("item_seq"), F.coalesce("tag", F.concat(F.lit("L"), n.cast("string"))).alias("id"), "tag", F.trim(F.coalesce("r.description", F.lit(""))).alias("description"), none.cast("string").alias("reference"), "box", none.cast(lg.BOX).alias("symbol_box"), F.col("box").alias("legend_box"))


def _legend_parts(legend: dict | None) -> list[dict]:
    if not legend:
        return []
    f, b = legend["dpi"] / 72, legend["legend_box"]
    return [{"text": "Legend:"}, image_part(crop(read_png(legend["content"]), b["x"] * f, b["y"] * f, b["w"] * f, b["h"] * f))]


def _tile_requests(s: Settings):
    def run(batches):
        names = ["drawing_id", "page", "dpi", "tile", "px", "py", "size_w", "size_h", "request"]
        kinds = [pa.string(), *[pa.int32()] * 7, pa.string()]
        for b in batches:
            for row in b.to_pylist():
                pixels, out = read_png(row["content"]), []
                shown = _legend_parts(row["legend"])
                ids = [i["item_id"] for i in row["items"]]
                high, wide = pixels.shape[:2]
                places = [(x, y) for y in tiles.starts(high, s.tile, s.overlap) for x in tiles.starts(wide, s.tile, s.overlap)]
                busy = [(x, y, part) for x, y in places if ink(part := crop(pixels, x, y, s.tile, s.tile)) > s.least_ink]
                for k, (x, y, part) in enumerate(busy):  # blank tiles need no call
                    request = request_of([{"text": detection_prompt(row["items"], bool(shown))}, *shown, {"text": "Tile:"}, image_part(part)], detection_schema(ids))
                    out.append((row["drawing_id"], row["page"], row["dpi"], k, x, y, part.shape[1], part.shape[0], request))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names)

    return run


def _crop_requests(s: Settings):
    def run(batches):
        for b in batches:
            out = []
            for row in b.to_pylist():
                pixels, f = read_png(row["content"]), row["dpi"] / 72
                shown = _legend_parts(row["legend"])
                parts = [{"text": verify_prompt(row["items"], bool(shown))}, *shown]
                for c in row["crops"]:
                    x, y = c["x"] + c["w"] / 2 - s.context / 2, c["y"] + c["h"] / 2 - s.context / 2
                    left, top = max(0.0, x), max(0.0, y)
                    w, h = (min(x + s.context, pixels.shape[1] / f) - left) * f, (min(y + s.context, pixels.shape[0] / f) - top) * f
                    parts += [{"text": f"Crop {c['index']} (first guess: {c['item_id']}):"}, image_part(crop(pixels, left * f, top * f, w, h, 256 / w if 0 < w < 256 else 1.0))]
                out.append((row["drawing_id"], row["page"], row["batch"], request_of(parts, verify_schema([i["item_id"] for i in row["items"]]))))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int64(), pa.string()))], ["drawing_id", "page", "batch", "request"])

    return run
