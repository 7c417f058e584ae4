"""Drawings marked up: every detection as a box with its label, coloured by how it was found."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmeter.engine import Takeoff, marks
from sheetmeter.sources import pdf

# Colours (red, green, blue) by how a detection was found.
COLOURS = {"vector": (0.1, 0.35, 0.9), "symbol": (0.55, 0.2, 0.8), "vision": (0.05, 0.6, 0.25), "review": (0.85, 0.1, 0.1)}
KEY = {"vector": "tag printed on the drawing", "symbol": "glyph geometry matched", "vision": "seen by the model", "review": "to be checked"}


def page_marks(t: Takeoff) -> DataFrame:
    """drawing_id, page, marks (box, label, colour) and the line of counts of each page."""
    m = marks(t.detections).groupBy("drawing_id", "page").agg(F.array_sort(F.collect_list(F.struct("box", "label", "colour"))).alias("marks"))
    per = t.counts.join(t.items.select("drawing_id", "item_id", "item_seq"), ["drawing_id", "item_id"]).select("drawing_id", "item_seq", F.coalesce("tag", "item_id").alias("key"), F.explode("per_page").alias("page", "n"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_seq", "key", "n"))), lambda x: F.concat(x["key"], F.lit(": "), x["n"].cast("string"))), "   ")
    counts = per.where("n > 0").groupBy("drawing_id", F.col("page").cast("int").alias("page")).agg(line.alias("counts"))
    return m.join(counts, ["drawing_id", "page"], "left")


def _content(found: list[dict], counts: str | None, box: list[float], turn: int) -> bytes:
    ctm, _, _ = pdf.viewport(box, turn)
    wide = abs(box[2] - box[0])
    stroke, size = max(0.6, wide / 2400), max(4.0, wide / 400)
    out = [f"q {stroke:.3f} w"]
    rgb = lambda c, op: f"{c[0]:g} {c[1]:g} {c[2]:g} {op}"

    def text(s: str, x: float, y: float, colour) -> str:
        return f"{rgb(colour, 'rg')} BT /SheetmeterF {size:.2f} Tf {x:.2f} {y:.2f} Td ({pdf.escaped(s).decode('latin-1')}) Tj ET"

    for m in found:
        x, y, w, h = pdf.to_page_space(ctm, *(m["box"][k] for k in "xywh"))
        pad, colour = 2 * stroke, COLOURS[m["colour"]]
        out.append(f"{rgb(colour, 'RG')} {x - pad:.2f} {y - pad:.2f} {w + 2 * pad:.2f} {h + 2 * pad:.2f} re S")
        out.append(text(m["label"], x - pad, y + h + pad + 1, colour))
    x0, y0 = min(box[0], box[2]) + 8, min(box[1], box[3]) + 8
    for i, (kind, words) in enumerate(KEY.items()):
        y = y0 + i * (size + 3)
        out.append(f"{rgb(COLOURS[kind], 'RG')} {x0:.2f} {y:.2f} {size:.2f} {size:.2f} re S")
        out.append(text(words, x0 + size + 3, y + 1, COLOURS[kind]))
    out.append(text(counts or "", x0, y0 + len(KEY) * (size + 3) + 2, (0.2, 0.2, 0.2)))
    return "\n".join([*out, "Q"]).encode("latin-1", "replace")


def _written(x) -> bytes:
    """An object as it stands in a file."""
    if isinstance(x, pdf.Ref):
        return b"%d 0 R" % x.number
    if isinstance(x, pdf.Name):
        return b"/" + b"".join(bytes([c]) if 33 <= c < 127 and c not in b"#/%()<>[]{}" else b"#%02X" % c for c in x.encode("latin-1"))
    if isinstance(x, dict):
        return b"<< " + b" ".join(_written(pdf.Name(k)) + b" " + _written(v) for k, v in x.items()) + b" >>"
    if isinstance(x, list):
        return b"[" + b" ".join(map(_written, x)) + b"]"
    if isinstance(x, bytearray):
        return b"<" + bytes(x).hex().encode() + b">"
    if isinstance(x, bool):
        return b"true" if x else b"false"
    if isinstance(x, bytes):
        return x
    return f"{x:g}".encode() if isinstance(x, float) else str(x).encode()


def overlaid(data: bytes, found: dict[int, tuple[list[dict], str | None]]) -> bytes:
    """The file with marks (by page number) drawn over its pages, as an update appended to it; the original bytes stay as they are."""
    doc = pdf.Document(data)
    root = next(k for k, v in doc.objects.items() if isinstance(v, dict) and v.get("Type") == "Catalog")
    top, new = max(doc.objects), {}

    def added(body: bytes) -> pdf.Ref:
        nonlocal top
        top += 1
        new[top] = body
        return pdf.Ref(top)

    font = added(b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding /BaseFont /Helvetica >>")
    originals = {k: v for k, v in doc.objects.items() if isinstance(v, dict) and v.get("Type") == "Page"}
    for number, info in enumerate(doc.pages(), 1):
        if number not in found:
            continue
        key = next((k for k, v in originals.items() if all(info.get(f) == v.get(f) for f in v)), None)
        if key is None:
            continue
        box = [float(doc.of(v)) for v in doc.of(info.get("CropBox")) or doc.of(info.get("MediaBox")) or [0, 0, 612, 792]]
        body = zlib.compress(_content(*found[number], box, int(doc.of(info.get("Rotate")) or 0)))
        drawn = added(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(body), body))
        before, after = (added(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(x), x)) for x in (b"q", b"Q"))
        parts = doc.of(info.get("Contents"))
        parts = parts if isinstance(parts, list) else [info["Contents"]] if "Contents" in info else []
        resources = dict(doc.of(info.get("Resources")) or {})
        resources["Font"] = dict(doc.of(resources.get("Font")) or {}) | {"SheetmeterF": font}
        new[key] = _written(originals.pop(key) | {"Resources": resources, "Contents": [before, *parts, after, drawn]})
    out, at = bytearray(data if data.endswith(b"\n") else data + b"\n"), {}
    for k, body in sorted(new.items()):
        at[k] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    where = len(out)
    last = data.rfind(b"startxref")
    previous = int(data[last + 9 :].split()[0]) if last >= 0 else 0
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (k, v) for k, v in sorted(at.items()))
    return bytes(out + b"trailer\n<< /Size %d /Root %d 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (top + 1, root, previous, where))


def overlays(t: Takeoff, files: DataFrame) -> DataFrame:
    """files: drawing_id, content. drawing_id and the marked content; a drawing is written by one task."""
    by = page_marks(t).groupBy("drawing_id").agg(F.collect_list(F.struct("page", "marks", "counts")).alias("pages"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            made = [overlaid(c.as_py(), {p["page"]: (p["marks"], p["counts"]) for p in pages or ()}) for c, pages in zip(b.column(1), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["drawing_id", "content"])

    return files.join(by, "drawing_id", "left").select("drawing_id", "content", "pages").mapInArrow(run, "drawing_id string, content binary")
