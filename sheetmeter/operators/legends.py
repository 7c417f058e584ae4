"""Legends of a page, read from its text spans: tables with column titles, and rows of tag and description under a heading.

A heading that lies inside an accepted legend is passed over, lines join by the first span of the last one, and a row's gap limit depends
on the rows before it. These are folds over one page, so they run page by page; the rest is joins (see layout and titleblock).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmeter.functions import text as t

from .paging import by_key

BOX = "struct<x: double, y: double, w: double, h: double>"
ITEMS = f"drawing_id string, page int, legend int, item_seq int, id string, tag string, description string, reference string, box {BOX}, symbol_box {BOX}, legend_box {BOX}"


@dataclass
class Box:
    x: float
    y: float
    w: float
    h: float

    @property
    def right(self) -> float:
        return self.x + self.w

    @property
    def bottom(self) -> float:
        return self.y + self.h

    @property
    def cx(self) -> float:
        return self.x + self.w / 2

    @property
    def cy(self) -> float:
        return self.y + self.h / 2

    def holds(self, other: Box) -> bool:
        return self.x <= other.cx <= self.right and self.y <= other.cy <= self.bottom

    def plain(self) -> dict:
        return {"x": self.x, "y": self.y, "w": self.w, "h": self.h}


def around(boxes: list[Box]) -> Box:
    x, y = min(b.x for b in boxes), min(b.y for b in boxes)
    return Box(x, y, max(b.right for b in boxes) - x, max(b.bottom for b in boxes) - y)


def on_page(x: float, y: float, w: float, h: float, width: float, height: float) -> Box:
    left, top = max(0.0, x), max(0.0, y)
    return Box(left, top, max(0.0, min(width, x + w) - left), max(0.0, min(height, y + h) - top))


@dataclass
class Span(Box):
    str: str
    size: float

    def __post_init__(self) -> None:
        self.n = t.norm(self.str)
        self.taglike = t.tag_like(self.str)


def joined(spans: list[Span]) -> str:
    return t.norm(" ".join(s.str for s in spans))


def lines_of(spans: list[Span], tolerance: float = 0.6) -> list[list[Span]]:
    """From top to bottom; a span joins the last line if its centre is within tolerance heights of that line's first span."""
    out: list[list[Span]] = []
    for s in sorted(spans, key=lambda s: (s.y, s.x)):
        if out and abs(out[-1][0].cy - s.cy) <= tolerance * s.h:
            out[-1].append(s)
        else:
            out.append([s])
    return out


def upper_median(values: list[float]) -> float:
    return sorted(values)[len(values) // 2] if values else 0.0


class Page:
    def __init__(self, spans: list[Span], width: float, height: float):
        self.spans, self.width, self.height = spans, width, height

    def legends(self, exclude: list[Box]) -> list[tuple[Box, list[dict]]]:
        headings = [s for s in self.spans if t.IS_HEADING.match(s.n) and not any(b.holds(s) for b in exclude)]
        found: list[tuple[Box, list[dict]]] = []
        for h in sorted(headings, key=lambda s: (-s.size, s.y)):
            if not any(box.holds(h) for box, _ in found) and (legend := self.table(h) or self.rows(h)):
                found.append(legend)
        return sorted(found, key=lambda f: f[0].y)

    # -- tables

    def table(self, head: Span) -> tuple[Box, list[dict]] | None:
        titles = [s for s in self.spans if s is not head and s.x > head.x + head.w / 2 and abs(s.cy - head.cy) < 2.5 * max(head.h, s.h) and t.IS_COLUMN.match(s.n)]
        if not titles:
            return None
        columns = sorted({math.floor(s.x + 0.5) for s in titles})
        right = max(s.right for s in titles) + 2 * head.h
        top = max(head.bottom, *(s.bottom for s in titles)) - 0.2 * head.h
        under = [s for s in self.spans if s.y > top]
        below = [s for s in under if s.x < columns[0] - 4 and s.right <= right]
        prose = [s for s in below if len(s.str.strip()) >= 4 and not s.taglike]
        if not prose:
            return None
        # the left edge of the descriptions: the tenth of the way through the sorted places, so that a few strays do no harm
        left = sorted(s.x for s in prose)[int(len(prose) * 0.1)]
        font = upper_median([s.size for s in prose])
        symbols = [s for s in below if left - 10 * head.h < s.x < left - 2 and s.taglike]
        after = (columns[1] if len(columns) > 1 else right) - 4
        references = [s for s in under if columns[0] - 4 <= s.x < after and s.right <= right + 4 * head.h]
        groups = self._wrapped(lines_of([s for s in below if s.x >= left - 2 and s.size <= 1.6 * font]), font)
        starts = [g[0][0].cy for g in groups]
        pitch = upper_median([b - a for a, b in zip(starts, starts[1:], strict=False)]) if len(groups) > 1 else 2.5 * font
        items: list[dict] = []
        boxes: list[Box] = []
        for g in groups:
            spans = [s for line in g for s in sorted(line, key=lambda s: s.x)]
            description = joined(spans)
            if len(description) < 3:
                continue
            body = around(spans)
            band = lambda s, body=body: body.y - 0.45 * pitch <= s.cy <= body.bottom + 0.45 * pitch
            mark = min((s for s in symbols if band(s)), key=lambda s: abs(s.cy - body.cy), default=None)
            cell = max(0.0, left - 6 * head.h)
            box = around([*spans, mark] if mark else spans)
            boxes.append(box)
            items.append(self._item(len(items) + 1, mark.n if mark else None, description, joined([s for s in references if band(s)]) or None, box, on_page(cell, body.cy - 0.42 * pitch, left - 2 - cell, 0.84 * pitch, self.width, self.height)))
        if not items:
            return None
        rows = around(boxes)
        x, y = min(left - 6 * head.h, rows.x), min(head.y, rows.y) - 0.5 * head.h
        x2, y2 = right, rows.bottom + 0.5 * pitch
        return on_page(min(x, x2), min(y, y2), abs(x2 - x), abs(y2 - y), self.width, self.height), items

    @staticmethod
    def _wrapped(lines: list[list[Span]], font: float) -> list[list[list[Span]]]:
        """Lines that nearly touch are one description; the table ends at a wide gap or another block's heading."""
        out: list[list[list[Span]]] = []
        bottom = -math.inf
        for line in lines:
            gap = min(s.y for s in line) - bottom
            if out and gap > 10 * font or t.IS_STOP.match(joined(sorted(line, key=lambda s: s.x))):
                break
            if out and gap <= 0.6 * font:
                out[-1].append(line)
            else:
                out.append([line])
            bottom = max(s.bottom for s in line)
        return out

    # -- rows

    def rows(self, head: Span) -> tuple[Box, list[dict]] | None:
        left, right = head.x - 6 * head.h, min(self.width, head.x + max(0.35 * self.width, 320))
        kept: list[tuple[str | None, str, Box]] = []
        bottom, widest = head.bottom, None
        for line in lines_of([s for s in self.spans if s is not head and s.y > head.y + head.h / 2 and left <= s.x < right]):
            line = sorted(line, key=lambda s: s.x)
            gap = min(s.y for s in line) - bottom
            limit = 4 * head.h if widest is None else 2.5 * max(widest, head.h)
            if gap > limit or t.IS_STOP.match(joined(line)):
                break
            tagged = line[0].taglike
            description = joined(line[1:] if tagged else line)
            if not tagged and len(description) < 3:
                continue
            kept.append((line[0].n if tagged else None, description, around(line)))
            if len(kept) > 1:
                widest = gap if widest is None else max(widest, gap)
            bottom = max(s.bottom for s in line)
        if not kept or len(kept) < 3 and all(tag is None for tag, _, _ in kept):
            return None
        pitch = (kept[-1][2].y - kept[0][2].y) / (len(kept) - 1) if len(kept) > 1 else 2.5 * head.h
        items = []
        for k, (tag, description, box) in enumerate(kept, 1):
            cell = max(0.0, min(head.x, box.x) - 6 * head.h)
            items.append(self._item(k, tag, description, None, box, on_page(cell, box.cy - 0.42 * pitch, box.x - 2 - cell, 0.84 * pitch, self.width, self.height)))
        rows = around([b for _, _, b in kept])
        margin = max(5 * head.h, 3 * rows.h / len(kept))
        x, y = min(head.x, rows.x) - margin, head.y - 0.5 * head.h
        return on_page(x, y, max(head.right, rows.right) + head.h - x, rows.bottom + head.h - y, self.width, self.height), items

    @staticmethod
    def _item(k: int, tag: str | None, description: str, reference: str | None, box: Box, cell: Box) -> dict:
        return {"item_seq": k, "id": tag or f"L{k}", "tag": tag, "description": description, "reference": reference, "box": box.plain(), "symbol_box": cell.plain()}


def _read(key: tuple, rows: list[dict]) -> list[dict]:
    spans = [Span(r["x"], r["y"], r["w"], r["h"], r["str"], r["font_size"]) for r in rows]
    page = Page(spans, rows[0]["width"], rows[0]["height"])
    found = page.legends([Box(**b) for b in rows[0]["boxes"] or ()])
    return [{"legend": k, "legend_box": box.plain()} | item for k, (box, items) in enumerate(found) for item in items]


def read_legends(spans: DataFrame, pages: DataFrame, exclude: DataFrame) -> DataFrame:
    """The items of all legends, page by page. exclude: drawing_id, page, x, y, w, h, boxes whose headings do not count.

    Columns as in ITEMS. Pages without a heading are left out before their spans are moved.
    """
    keys = ["drawing_id", "page"]
    candidates = spans.where(t.is_heading(t.normalise("str"))).select(*keys).distinct()
    boxes = exclude.groupBy(*keys).agg(F.collect_list(F.struct("x", "y", "w", "h")).alias("boxes"))
    about = candidates.join(pages.select(*keys, "width", "height"), keys).join(boxes, keys, "left")
    return by_key(spans.join(about, keys), keys, ["seq"], _read, ITEMS)


def legend_items(entries: DataFrame, legend_seq: str = "page * 100000 + legend") -> DataFrame:
    """Merged per drawing: the first of each tag, or of each description without one; untagged ones numbered L1, L2, ... in that order."""
    from .items import merge_legends

    return merge_legends(entries.withColumn("legend_seq", F.expr(legend_seq).cast("long")), ["drawing_id"])


def read_legend_file(spark, path: str) -> DataFrame:
    """A JSON file {items: [{tag, description}]} as legend entries; tags in upper case, trimmed. A file of another shape is an error."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<items: array<struct<tag: string, description: string>>>")["items"].alias("items"))
    items = rows.select(F.posexplode(F.coalesce("items", F.raise_error(F.lit("a legend file holds {items: [{tag, description}]}")))).alias("k", "i"))
    tag = F.when(F.length(F.trim("i.tag")) > 0, F.trim(F.upper("i.tag")))
    return items.select((F.col("k") + 1).alias("item_seq"), F.coalesce(tag, F.concat(F.lit("L"), (F.col("k") + 1).cast("string"))).alias("id"), tag.alias("tag"), F.coalesce("i.description", F.lit("")).alias("description"))
