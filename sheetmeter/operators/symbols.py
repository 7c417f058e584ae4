"""Symbol matching on vector geometry: elements, hatch bands, glyph signatures, proposals and claims.

Hatch bands, glyph selection and signatures are DataFrame operations. Proposals and claims go page by page: which
proposal takes a path decides what is left for the next.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from sheetmeter.functions import geometry as g
from sheetmeter.functions import text as t

from .legends import BOX
from .paging import by_key

KEYS = ["drawing_id", "page"]
# Limits that decide what matches.
MIN_SCORE, MIN_ELEMENTS, SMALLEST, LARGEST, POSITION = 0.7, 0.6, 0.2, 2.5, 0.14
ANCHOR_LIMIT, ELEMENT_LIMIT, SURE, SAMPLES, CELL = 0.45, 0.6, 0.85, 24, 12.0
KINDS = ("dot", "line", "open", "closed", "curve")
#: Kinds that may stand for each other at a price.
COUSINS = {("closed", "curve"), ("curve", "closed"), ("open", "closed"), ("closed", "open")}

SUBPATHS = "array<struct<points: array<struct<x: double, y: double>>, closed: boolean, curves: int>>"
PATHS = f"drawing_id string, page int, index int, subpaths {SUBPATHS}, x double, y double, w double, h double, fill boolean, stroke boolean, line_width double"
SHAPE = "kind string, aspect double, fill boolean, stroke boolean, angular array<double>, radial array<double>, round double"
ELEMENTS = f"drawing_id string, page int, index int, x double, y double, w double, h double, straight boolean, {SHAPE}"
SIGNATURE = "struct<elements: array<struct<kind: string, dx: double, dy: double, size: double, aspect: double, fill: boolean, stroke: boolean, angular: array<double>, radial: array<double>, round: double, weight: double>>, anchor: int, extent: double, anchor_size: double>"


def merge_hatch_bands(paths: DataFrame) -> DataFrame:
    """Runs of at least three consecutive, touching, thin filled bands become one filled rectangle with the first one's index."""
    points = F.aggregate("subpaths", F.lit(0), lambda n, s: n + F.size(s["points"]))
    band = F.col("fill") & (F.size("subpaths") <= 2) & (points <= 8) & (F.least("w", "h") < 1.5)
    w = Window.partitionBy(*KEYS).orderBy("index")
    before = lambda c: F.lag(c).over(w)
    near = lambda at, size: (F.col(f"_{at}") <= F.col(at) + F.col(size) + 0.6) & (F.col(at) <= F.col(f"_{at}") + F.col(f"_{size}") + 0.6)
    x = paths.withColumn("_band", band).withColumns({f"_{c}": before(c) for c in ("index", "x", "y", "w", "h")} | {"_was": before("_band")})
    goes_on = F.col("_band") & F.col("_was") & (F.col("index") == F.col("_index") + 1) & near("x", "w") & near("y", "h")
    x = x.withColumn("_run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*KEYS, "_run")
    x = x.withColumns({"_n": F.count("*").over(run), "_first": F.min("index").over(run), "_x1": F.min("x").over(run), "_y1": F.min("y").over(run), "_x2": F.max(F.col("x") + F.col("w")).over(run), "_y2": F.max(F.col("y") + F.col("h")).over(run)})
    x = x.where((F.col("_n") < 3) | (F.col("index") == F.col("_first")))
    merged = F.col("_n") >= 3
    corner = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    area = F.array(F.struct(F.array(corner("_x1", "_y1"), corner("_x2", "_y1"), corner("_x2", "_y2"), corner("_x1", "_y2")).alias("points"), F.lit(True).alias("closed"), F.lit(0).alias("curves")))
    new = {"subpaths": area.cast(SUBPATHS), "x": F.col("_x1"), "y": F.col("_y1"), "w": F.col("_x2") - F.col("_x1"), "h": F.col("_y2") - F.col("_y1"), "stroke": F.lit(False)}
    return x.withColumns({c: F.when(merged, v).otherwise(F.col(c)) for c, v in new.items()}).select(*paths.columns)


def resampled(subpaths: list[dict], target: int = SAMPLES) -> np.ndarray:
    """Points at even steps along all pieces of a path; its own points if it has no length."""
    runs = [np.array([(p["x"], p["y"]) for p in s["points"]] + ([(s["points"][0]["x"], s["points"][0]["y"])] if s["closed"] and len(s["points"]) > 1 else []), float).reshape(-1, 2) for s in subpaths]
    a, b = (np.concatenate([r[k : len(r) - 1 + k] for r in runs if len(r) > 1] or [np.zeros((0, 2))]) for k in (0, 1))
    size = np.hypot(*(b - a).T) if len(a) else np.zeros(0)
    total = math.fsum(size)
    if total <= 0:
        return np.concatenate([np.array([(p["x"], p["y"]) for p in s["points"]], float).reshape(-1, 2) for s in subpaths] or [np.zeros((0, 2))])
    ends = np.cumsum(size)
    at = np.arange(target) * (total / target)
    k = np.minimum(np.searchsorted(ends, at, "left"), len(size) - 1)
    share = np.where(size[k] > 0, (at - (ends[k] - size[k])) / np.where(size[k] > 0, size[k], 1), 0.0)
    return a[k] + (b[k] - a[k]) * share[:, None]


def histograms(points: np.ndarray, cx: float, cy: float, extent: float) -> tuple[list[float], list[float], float]:
    """Shares of points by direction (8 bins) and by distance (6 bins), each point split between its two nearest bins, and the
    share of points at about the median distance."""
    if not len(points) or extent == 0:
        return [0.0] * 8, [0.0] * 6, 1.0
    dx, dy = points[:, 0] - cx, points[:, 1] - cy
    r = np.hypot(dx, dy) / (extent / 2)
    a = (np.arctan2(dy, dx) + math.pi) / (2 * math.pi) * 8 - 0.5
    low = np.floor(a)
    angular = np.bincount(low.astype(int) % 8, 1 - (a - low), 8) + np.bincount((low.astype(int) + 1) % 8, a - low, 8)
    b = np.minimum(r, 0.999) * 6 - 0.5
    low = np.maximum(0, np.floor(b))
    rest = np.maximum(0, b - low)
    radial = np.bincount(np.minimum(5, low.astype(int)), 1 - rest, 6) + np.bincount(np.minimum(5, low.astype(int) + 1), rest, 6)
    n = len(points)
    return (angular / n).tolist(), (radial / n).tolist(), float((np.abs(r - np.sort(r)[n // 2]) < 0.1).sum() / n)


def element(p: dict) -> dict:
    """The shape of one path (see ELEMENTS)."""
    extent = max(p["w"], p["h"])
    subpaths = p["subpaths"] or []
    count = sum(len(s["points"]) for s in subpaths)
    if extent < 0.75:
        kind = "dot"
    elif any(s["curves"] for s in subpaths):
        kind = "curve"
    elif len(subpaths) == 1 and count == 2:
        kind = "line"
    else:
        kind = "closed" if any(s["closed"] for s in subpaths) or p["fill"] and not p["stroke"] else "open"
    angular, radial, round_ = histograms(resampled(subpaths), p["x"] + p["w"] / 2, p["y"] + p["h"] / 2, extent)
    aspect = min(extent / max(min(p["w"], p["h"]), 1e-6), 20.0)
    return {c: p[c] for c in ("drawing_id", "page", "index", "x", "y", "w", "h", "fill", "stroke")} | {"straight": len(subpaths) == 1 and count == 2, "kind": kind, "aspect": aspect, "angular": angular, "radial": radial, "round": round_}


def elements(paths: DataFrame) -> DataFrame:
    """The shapes of all paths (columns ELEMENTS), row by row."""
    arrow = to_arrow_schema(StructType.fromDDL(ELEMENTS))

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                yield pa.RecordBatch.from_pylist([element(p) for p in b.slice(k, 2048).to_pylist()], schema=arrow)

    return paths.mapInArrow(run, ELEMENTS)


def glyphs(shapes: DataFrame, cells: DataFrame) -> DataFrame:
    """cells: drawing_id, page, cell (any key columns besides), symbol_box. The shapes that draw a cell's glyph: centred in it, no larger than it, and
    no rule across it."""
    e = shapes.select(F.col("drawing_id").alias("e_d"), F.col("page").alias("e_p"), F.struct(*[c for c in shapes.columns if c not in KEYS]).alias("e"))
    box, c = F.col("symbol_box"), F.col("e")
    within = g.contains_point(box, c["x"] + c["w"] / 2, c["y"] + c["h"] / 2)
    fits = F.greatest(c["w"], c["h"]) <= F.greatest(box["w"], box["h"]) * 1.05
    rule = c["straight"] & (((c["w"] >= box["w"] * 0.9) & (c["h"] < 0.5)) | ((c["h"] >= box["h"] * 0.9) & (c["w"] < 0.5)))
    return cells.join(e, (F.col("drawing_id") == F.col("e_d")) & (F.col("page") == F.col("e_p")) & within & fits & ~rule).drop("e_d", "e_p")


def signatures(found: DataFrame, keys: list[str]) -> DataFrame:
    """found: keys and e (see glyphs()). Per glyph its signature: offsets from the centre and sizes over its extent, and the anchor, which is
    the largest element (of equal ones the first curve, else the first). Glyphs under half a point have none."""
    one = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("e.index").alias("index"), "e"))).alias("all"), F.min("e.x").alias("x1"), F.min("e.y").alias("y1"), F.max(F.col("e.x") + F.col("e.w")).alias("x2"), F.max(F.col("e.y") + F.col("e.h")).alias("y2"))
    one = one.withColumn("extent", F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).where("extent >= 0.5")
    cx, cy, extent = (F.col("x1") + (F.col("x2") - F.col("x1")) / 2), (F.col("y1") + (F.col("y2") - F.col("y1")) / 2), F.col("extent")

    def of(r):
        e = r["e"]
        size = F.greatest(e["w"], e["h"]) / extent
        return F.struct(e["kind"].alias("kind"), ((e["x"] + e["w"] / 2 - cx) / extent).alias("dx"), ((e["y"] + e["h"] / 2 - cy) / extent).alias("dy"), size.alias("size"), *[e[c].alias(c) for c in ("aspect", "fill", "stroke", "angular", "radial", "round")], (size + 0.15).alias("weight"))

    rank = F.transform("all", lambda r, i: F.struct(F.greatest(r["e"]["w"], r["e"]["h"]).alias("size"), (r["e"]["kind"] == "curve").alias("curve"), (-i).alias("back")))
    anchor = -F.array_max(rank)["back"]
    return one.withColumn("_a", anchor).select(*keys, F.struct(F.transform("all", of).alias("elements"), F.col("_a").cast("int").alias("anchor"), extent.alias("extent"), (F.array_max(rank)["size"] / extent).alias("anchor_size")).cast(SIGNATURE).alias("signature"))


# ---- one page

#: The eight ways to lay a glyph: quarter turns, each plain and mirrored.
VARIANTS = [(q, m) for q, m in product(range(4), (False, True))]
#: For each the place in the angular histogram that a bin comes from.
_TURNED = np.array([[(7 - (i - 2 * q) % 8) if m else (i - 2 * q) % 8 for i in range(8)] for q, m in VARIANTS])


def turned(dx: float, dy: float, quarters: int, mirror: bool) -> tuple[float, float]:
    x, y = dx, -dy if mirror else dy
    for _ in range(quarters):
        x, y = -y, x
    return x, y


class Shapes:
    """The elements of a page as arrays, filed in cells by their centres."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        col = lambda c: np.array([r[c] for r in rows], float)
        self.x, self.y, self.w, self.h = (col(c) for c in "xywh")
        self.cx, self.cy, self.extent = self.x + self.w / 2, self.y + self.h / 2, np.maximum(self.w, self.h)
        self.aspect, self.round = col("aspect"), col("round")
        self.fill = np.array([bool(r["fill"]) for r in rows], bool)
        self.kind = np.array([KINDS.index(r["kind"]) for r in rows], int)
        self.radial = np.array([r["radial"] for r in rows], float).reshape(-1, 6)
        self.angular = np.array([r["angular"] for r in rows], float).reshape(-1, 8)[:, _TURNED]  # element, variant, bin
        self.cells: dict[tuple[int, int], list[int]] = {}
        for i, (x, y) in enumerate(zip(self.cx.tolist(), self.cy.tolist(), strict=True)):
            self.cells.setdefault((math.floor(x / CELL), math.floor(y / CELL)), []).append(i)

    def near(self, x: float, y: float, radius: float) -> list[int]:
        """The elements with their centre within the radius, cell by cell."""
        out = []
        for i in range(math.floor((x - radius) / CELL), math.floor((x + radius) / CELL) + 1):
            for j in range(math.floor((y - radius) / CELL), math.floor((y + radius) / CELL) + 1):
                out += [k for k in self.cells.get((i, j), ()) if math.hypot(self.cx[k] - x, self.cy[k] - y) <= radius]
        return out

    def distance(self, ref: dict, which: np.ndarray) -> np.ndarray:
        """How far the shapes of these elements are from ref, for each variant; 1 if they cannot stand for each other."""
        kind = KINDS.index(ref["kind"])
        kinds = self.kind[which]
        price = np.array([0.0 if k == kind else 0.2 if (ref["kind"], KINDS[k]) in COUSINS else np.inf for k in range(len(KINDS))])[kinds]
        turn = np.abs(self.angular[which] - np.array(ref["angular"])).sum(2)
        flat = 0.35 * np.abs(self.radial[which] - np.array(ref["radial"])).sum(1) + 0.3 * np.minimum(1, np.abs(np.log(ref["aspect"] / self.aspect[which]))) + 0.5 * np.abs(ref["round"] - self.round[which])
        d = price[:, None] + 0.5 * turn + flat[:, None]
        dot = kind == 0
        d[(kinds == 0) & dot] = 0.0
        d[np.isinf(price)] = 1.0
        return d


def proposals(sig: dict, shapes: Shapes, mirror: bool = True) -> tuple[list[dict], int]:
    """Every place the glyph may sit, and how many elements looked like its anchor."""
    parts, anchor = sig["elements"], sig["elements"][sig["anchor"]]
    scale = shapes.extent / (anchor["size"] * sig["extent"])
    ok = (scale >= SMALLEST) & (scale <= LARGEST)
    if anchor["kind"] != "dot" and len(parts) == 1:
        ok &= shapes.fill == anchor["fill"]
    which = np.flatnonzero(ok)
    if not len(which):
        return [], 0
    variants = [k for k, (_, m) in enumerate(VARIANTS) if mirror or not m]
    apart = shapes.distance(anchor, which)[:, variants]
    seen = apart.min(1) <= ANCHOR_LIMIT
    which, apart = which[seen], apart[seen]
    whole = sum(p["weight"] for p in parts)
    least = max(1, math.ceil(len(parts) * MIN_ELEMENTS))
    out = []
    for i, row in zip(which.tolist(), apart, strict=True):
        extent = sig["extent"] * float(scale[i])
        reach = max(0.8, POSITION * extent)
        best = None
        for k, d in zip(variants, row.tolist(), strict=True):
            if d > ANCHOR_LIMIT:
                continue
            q, m = VARIANTS[k]
            ax, ay = turned(anchor["dx"], anchor["dy"], q, m)
            ox, oy = shapes.cx[i] - ax * extent, shapes.cy[i] - ay * extent
            met, used = 0.0, []
            for n, part in enumerate(parts):
                if n == sig["anchor"]:
                    met += part["weight"] * (1 - 0.5 * d / ANCHOR_LIMIT)
                    used.append(i)
                    continue
                px, py = turned(part["dx"], part["dy"], q, m)
                found = _nearest_part(shapes, part, ox + px * extent, oy + py * extent, part["size"] * extent, reach, k, {i, *used})
                if found:
                    met += part["weight"] * (1 - 0.5 * found[0] / ELEMENT_LIMIT)
                    used.append(found[1])
            score = met / whole if whole and len(used) >= least else 0.0
            if best is None or score > best[0]:
                best = (score, k, used)
        if best and best[0] >= MIN_SCORE:
            score, k, used = best
            x, y = shapes.x[used].min(), shapes.y[used].min()
            box = {"x": float(x), "y": float(y), "w": float((shapes.x[used] + shapes.w[used]).max() - x), "h": float((shapes.y[used] + shapes.h[used]).max() - y)}
            out.append(box | {"score": math.floor(score * 100 + 0.5) / 100, "rotation": VARIANTS[k][0], "mirrored": VARIANTS[k][1], "scale": math.floor(float(scale[i]) * 100 + 0.5) / 100, "used": used})
    return out, int(len(which))


def _nearest_part(shapes: Shapes, part: dict, x: float, y: float, size: float, reach: float, variant: int, taken: set[int]) -> tuple[float, int] | None:
    """The best element for a part of a glyph expected at (x, y), if one is near and like enough; the first of equal ones."""
    there = [j for j in shapes.near(x, y, reach) if j not in taken and (size < 1 or 0.55 <= shapes.extent[j] / size <= 1.8)]
    if not there:
        return None
    at = np.array(there)
    d = shapes.distance(part, at)[:, variant] + np.hypot(shapes.cx[at] - x, shapes.cy[at] - y) / reach / 4
    k = int(d.argmin())
    return (float(d[k]), there[k]) if d[k] < ELEMENT_LIMIT else None


def claims(items: list[dict], shapes: Shapes) -> tuple[list[dict], dict[str, int]]:
    """Proposals of all items, the best scores first, then the larger ones: a path belongs to one instance only. items: item_id, signature."""
    made, seen = [], {}
    for item in items:
        found, seen[item["item_id"]] = proposals(item["signature"], shapes)
        made += [m | {"item_id": item["item_id"], "extent": item["signature"]["extent"]} for m in found]
    taken: set[int] = set()
    out = []
    for m in sorted(made, key=lambda m: (-m["score"], -len(m["used"]), -m["extent"])):
        if taken.isdisjoint(m["used"]):
            taken.update(m["used"])
            out.append(m)
    return out, seen


MATCHES = "drawing_id string, page int, item_id string, x double, y double, w double, h double, score double, rotation int, mirrored boolean, scale double, path_indices array<int>, anchors long"


def _match_page(key: tuple, rows: list[dict]) -> list[dict]:
    items = [{"item_id": r["item_id"], "signature": r["signature"]} for r in rows if r["signature"]]
    largest = max([40.0, *(i["signature"]["extent"] * LARGEST * 1.2 for i in items)])
    shapes = Shapes([r for r in rows if not r["signature"] and max(r["w"], r["h"]) <= largest])
    found, seen = claims(items, shapes)
    out = [{"item_id": k, "anchors": n} for k, n in seen.items()]
    for m in found:
        out.append({c: m[c] for c in ("item_id", "x", "y", "w", "h", "score", "rotation", "mirrored", "scale")} | {"path_indices": [shapes.rows[i]["index"] for i in m["used"]]})
    return out


def match_symbols(items: DataFrame, shapes: DataFrame, pages: DataFrame) -> DataFrame:
    """items: drawing_id, item_seq, item_id, signature. The claimed instances on all pages, and for each item and page a row with the number of anchors seen
    (score null). The elements of a page and the signatures of its drawing meet in one group."""
    glyph = items.where("signature is not null").join(pages.select(*KEYS), "drawing_id")
    mine = glyph.select(*KEYS, F.lit(0).alias("rank"), F.col("item_seq").cast("long").alias("place"), "item_id", "signature")
    plan = shapes.join(glyph.select("drawing_id").distinct(), "drawing_id", "left_semi").select(*KEYS, F.lit(1).alias("rank"), F.col("index").cast("long").alias("place"), *[c for c in shapes.columns if c not in KEYS])
    return by_key(mine.unionByName(plan, allowMissingColumns=True), KEYS, ["rank", "place"], _match_page, MATCHES)


def symbol_detections(matches: DataFrame, items: DataFrame, spans: DataFrame, exclusions: DataFrame) -> DataFrame:
    """The claimed instances outside the excluded regions and without another item's letters inside them, as detections.

    items: drawing_id, item_id, tag, of all legend items. A tag inside names the symbol: another legend tag means another item,
    and for an item without a tag any tag-like text does.
    """
    from .tags import outside

    m = outside(matches.where("score is not null"), exclusions).join(items.select("drawing_id", "item_id", F.col("tag").alias("own")), ["drawing_id", "item_id"])
    cx, cy = g.center()
    words = spans.where(t.is_tag_like("str")).select(F.col("drawing_id").alias("s_d"), F.col("page").alias("s_p"), cx.alias("s_x"), cy.alias("s_y"), t.normalise("str").alias("said"))
    tags = items.where("tag is not null").select(F.col("drawing_id").alias("s_d"), F.col("tag").alias("said")).distinct().withColumn("known", F.lit(True))
    words = words.join(tags, ["s_d", "said"], "left")
    foreign = (F.col("drawing_id") == F.col("s_d")) & (F.col("page") == F.col("s_p")) & g.contains_point("", F.col("s_x"), F.col("s_y")) & F.when(F.col("own").isNull(), True).otherwise((F.col("said") != F.col("own")) & F.col("known").isNotNull())
    m = m.join(words, foreign, "left_anti")
    review = F.col("score") < SURE
    reason = F.format_string("symbol match %.2f (%d°%s, scale %s)", "score", F.col("rotation") * 90, F.when(F.col("mirrored"), " mirrored").otherwise(""), F.regexp_replace(F.col("scale").cast("string"), r"\.0$", ""))
    return m.select(*KEYS, "item_id", "x", "y", "w", "h", F.col("score").alias("confidence"), F.lit("symbol").alias("source"), F.lit(1).alias("multiplier"), review.alias("needs_review"), F.when(review, reason).alias("review_reason"))


def symbol_stats(items: DataFrame, matches: DataFrame, detections: DataFrame) -> DataFrame:
    """Per item: elements of its glyph, anchors seen, instances, and their mean score."""
    keys = ["drawing_id", "item_id"]
    seen = matches.where("anchors is not null").groupBy(*keys).agg(F.sum("anchors").alias("anchor_candidates"))
    met = detections.groupBy(*keys).agg(F.count("*").alias("matches"), g.rounded(F.avg("confidence"), 2).alias("mean_score"))
    of = items.where("signature is not null").select(*keys, F.size("signature.elements").alias("reference_elements"))
    return of.join(seen, keys, "left").join(met, keys, "left").fillna(0, ["anchor_candidates", "matches"]).fillna(0.0, ["mean_score"])
