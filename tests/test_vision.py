"""The model pass with a scripted client: no network, deterministic answers."""

import base64
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetmeter import benchmark, engine
from sheetmeter.operators import tiles, vision
from sheetmeter.sources import drawings, fixtures, pdf


def scripted(price=1000, fail=(), script=None):
    """A client that sees dark squares of 8 pixels in the tile; the class is local, so that workers get it by value."""

    class Client:
        model = "scripted"

        def __init__(self):
            self.failures = list(fail)

        def generate(self, request):
            if self.failures:
                raise vision.Retry(self.failures.pop(0))
            use = {"prompt": price, "output": 10, "thought": 5}
            said = script(request) if script else self.seen(request)
            return {"candidates": [{"content": {"parts": [{"text": "let me see", "thought": True}, {"text": json.dumps(said)}]}}], "usage": use}

        def seen(self, request):
            texts = [p.get("text", "") for p in request["parts"]]
            pixels = vision.read_png(base64.b64decode(request["parts"][-1]["image"]))
            dark = pixels[:, :, 0] < 128
            if "answers" in request["schema"]["properties"]:
                return {"answers": [{"index": k, "item": "L1", "confidence": 0.97} for k in range(1, sum(t.startswith("Crop") for t in texts) + 1)]}
            if "found" in request["schema"]["properties"]:
                return {"found": True, "box_2d": [0, 0, 100, 500], "rows": [{"tag": " a1 ", "description": " lamp "}, {"tag": "", "description": "square"}]}
            high, wide = dark.shape
            out = []
            for y, x in zip(*np.nonzero(dark), strict=True):
                if (y == 0 or not dark[y - 1, x]) and (x == 0 or not dark[y, x - 1]) and y + 8 <= high and x + 8 <= wide and y and x:
                    out.append({"t": "L1", "b": [y / high * 1000, x / wide * 1000, (y + 8) / high * 1000, (x + 8) / wide * 1000], "c": 0.9})
            return {"d": out + [{"t": "unknown", "b": [0, 0, 500, 500], "c": 1}, {"t": "L1", "b": [1, 2], "c": 1}]}

    return Client()


PLACES = [(20, 30), (115, 60), (118, 110), (200, 140), (60, 170), (190, 20)]


def page_image(places=PLACES, width=240, height=200):
    pixels = np.full((height, width, 3), 255, np.uint8)
    for x, y in places:
        pixels[y : y + 8, x : x + 8] = 0
    return vision.write_png(pixels)


@pytest.fixture()
def setting(spark):
    pages = spark.createDataFrame([("d", 1, 240.0, 200.0)], drawings.PAGES)
    images = spark.createDataFrame([("d", 1, 72, 240, 200, page_image())], "drawing_id string, page int, dpi int, width int, height int, content binary")
    items = spark.createDataFrame([("d", 1, "L1", None, "square")], "drawing_id string, item_seq long, item_id string, tag string, description string")
    boxes = spark.createDataFrame([("d", 1, 180.0, 10.0, 40.0, 30.0)], "drawing_id string, page int, x double, y double, w double, h double")
    legends = spark.createDataFrame([], "drawing_id string, page int, legend_box struct<x: double, y: double, w: double, h: double>")
    return pages, images, items, boxes, legends


SMALL = vision.Settings(dpi=72, tile=128, overlap=32, concurrency=2)


def test_squares_are_found_once_outside_the_excluded_box(setting):
    pages, images, items, boxes, legends = setting
    run = vision.ModelPass(scripted(), images, SMALL)
    got = run.detect(pages, items, boxes, legends).collect()
    assert sorted((r["x"], r["y"]) for r in got) == sorted((float(x), float(y)) for x, y in PLACES[:-1])
    assert all(r["source"] == "vision" and r["item_id"] == "L1" and not r["needs_review"] and (r["w"], r["h"]) == (8.0, 8.0) for r in got)
    assert run.usage()["calls"] == 6 + 1 and run.usage()["model"] == "scripted"  # six tiles with ink, one batch of crops
    assert run.usage()["cost_usd"] == pytest.approx((7 * 1000 * 1.5 + 7 * 15 * 7.5) / 1e6)


def test_answers_are_kept_and_cost_counted(setting, tmp_path):
    pages, images, items, boxes, legends = setting
    cache = str(tmp_path / "answers")
    first = vision.ModelPass(scripted(), images, SMALL, cache)
    want = sorted(map(tuple, first.detect(pages, items, boxes, legends).collect()))

    def none(request):
        raise AssertionError("asked again")

    again = vision.ModelPass(scripted(script=none), images, SMALL, cache)
    assert sorted(map(tuple, again.detect(pages, items, boxes, legends).collect())) == want
    assert (again.usage()["calls"], again.usage()["cached_calls"]) == (0, 7) and again.usage()["cost_usd"] == first.usage()["cost_usd"]


def test_spend_cap(setting):
    pages, images, items, boxes, legends = setting
    run = vision.ModelPass(scripted(price=2_000_000), images, vision.Settings(dpi=72, tile=128, overlap=32, max_spend=2.0))
    with pytest.raises(vision.SpendCapError):
        run.detect(pages, items, boxes, legends).collect()  # the tiles cost more than the cap, so no crop is asked about


def test_tries():
    waits = []
    request = vision.request_of([{"text": "x"}], vision.LEGEND_SCHEMA)
    got = vision.call(scripted(fail=["network", "busy", "auth"], script=lambda r: {"found": False}), request, waits.append)
    assert json.loads(got["answer"]) == {"found": False} and waits == [1.0, 2.0, 4.0]
    for kind, n in vision.TRIES.items():
        waits.clear()
        with pytest.raises(RuntimeError, match=f"{n} times"):
            vision.call(scripted(fail=[kind] * 9), request, waits.append)
        assert len(waits) == n - 1


def test_empty_answers_are_errors():
    class Silent:
        model = "m"

        def generate(self, request):
            return {"candidates": []}

    with pytest.raises(RuntimeError, match="no answer"):
        vision.call(Silent(), vision.request_of([], {}))


def test_legend_by_the_model(setting):
    pages, images, *_ = setting
    got = vision.ModelPass(scripted(), images, SMALL).find_legends(pages).sort("item_seq").collect()
    assert [(r["id"], r["tag"], r["description"]) for r in got] == [("A1", "A1", "lamp"), ("L1", None, "square")]
    assert got[0]["legend_box"].asDict() == {"x": 0.0, "y": 0.0, "w": 126.0, "h": 26.0}


def test_counting_with_the_model(spark, setting):
    pages, images, *_ = setting
    spans = spark.createDataFrame([("d", 1, 0, "A1", 100.0, 100.0, 6.0, 6.0, 6.0)], drawings.SPANS)
    out = engine.count_drawings(spans, pages, None, vision=vision.ModelPass(scripted(), images, SMALL))
    counts = {r["item_id"]: (r["count"], r["source"]) for r in out.counts.collect()}
    assert counts["A1"] == (1, "vector") and counts["L1"][1] == "vision" and counts["L1"][0] >= 4
    plain = engine.count_drawings(spans, pages, None, legend="vision")
    assert [r["warning"] for r in plain.warnings.collect()] == ["no legend found; nothing to count"]


def test_images():
    rng = np.random.default_rng(1)
    for channels in (1, 2, 3, 4):
        pixels = rng.integers(0, 256, (7, 5, channels), dtype=np.uint8)
        assert (vision.read_png(vision.write_png(pixels)) == pixels).all()
    white, black = np.full((16, 16, 3), 255, np.uint8), np.zeros((16, 16, 1), np.uint8)
    assert vision.ink(white) == 0 and vision.ink(black) == 1 and vision.crop(white, 20, 20, 5, 5).shape == (1, 1, 3)
    assert vision.crop(white, -2, 3, 6, 4).shape == (4, 6, 3) and vision.crop(white, 0, 0, 16, 16, 0.5).shape == (8, 8, 3)
    with pytest.raises(ValueError):
        vision.read_png(b"no image")


def test_rendered_pages(spark, tmp_path):
    (tmp_path / "plan").mkdir()
    (tmp_path / "plan" / "page-2-150.png").write_bytes(page_image())
    (tmp_path / "plan" / "other.png").write_bytes(page_image())
    r = drawings.read_page_images(spark, str(tmp_path)).collect()
    assert [(x["drawing_id"], x["page"], x["dpi"], x["width"], x["height"]) for x in r] == [("plan", 2, 150, 240, 200)]


def plain_merge(rows):
    """The fold over sightings without cells: every kept one is looked at."""
    kept = []
    for r in sorted(rows, key=lambda r: (-r["confidence"], -r["edge_margin"], r["seq"])):
        best, least = None, math.inf
        for k in kept:
            apart = math.hypot(k["x"] + k["w"] / 2 - r["x"] - r["w"] / 2, k["y"] + k["h"] / 2 - r["y"] - r["h"] / 2)
            over = tiles._overlap(k, r)
            size = (r["w"] + r["h"] + k["w"] + k["h"]) / 4
            if (over >= 0.6 if k["tile"] == r["tile"] else over >= 0.3 or apart < 1.5 * size) and apart < least:
                best, least = k, apart
        if best is None:
            kept.append(dict(r))
        elif best["item_id"] == r["item_id"]:
            if r["edge_margin"] > best["edge_margin"] and r["confidence"] >= best["confidence"] - 0.05:
                best.update({c: r[c] for c in ("x", "y", "w", "h", "edge_margin")})
        elif not best["needs_review"]:
            best["needs_review"], best["review_reason"] = True, f"also seen as {r['item_id']} ({r['confidence']:.2f})"
    return kept


def test_merged_sightings_against_the_plain_fold():
    rng = random.Random(7)
    for _ in range(40):
        rows = [{"seq": i, "item_id": rng.choice("AAB"), "x": rng.uniform(0, 90), "y": rng.uniform(0, 90), "w": rng.uniform(4, 14), "h": rng.uniform(4, 14), "confidence": rng.choice([0.5, 0.8, 0.84, 0.9]), "edge_margin": rng.uniform(0, 30), "tile": rng.randrange(3), "needs_review": False, "review_reason": None} for i in range(60)]
        names = ("seq", "item_id", "x", "y", "w", "h", "needs_review", "review_reason")
        assert [tuple(k[c] for c in names) for k in tiles.merge_sightings([dict(r) for r in rows])] == [tuple(k[c] for c in names) for k in plain_merge(rows)]


def test_drawings_without_a_legend_take_their_sets(spark, tmp_path):
    """The sheets of a set as two files, the legend only on the first."""
    data, truth = fixtures.build("set-03")
    doc = pdf.Document(data)
    at = tmp_path / "s"
    (at / "drawings").mkdir(parents=True)
    for k, page in enumerate(doc.pages()):
        (at / "drawings" / f"{k}.pdf").write_bytes(pdf.write([(2384, 1684, doc.content(doc.of(page["Contents"])))]))
    (at / "ground_truth.json").write_text(json.dumps(truth))
    r = benchmark.run_bench(spark, str(tmp_path))
    assert r.sets.first()["strict_pass"] and r.sets.first()["files"] == ["0.pdf", "1.pdf"]
    per = {x["drawing_id"][-5:]: x["n"] for x in r.takeoffs[0].counts.groupBy("drawing_id").agg(F.sum("count").alias("n")).collect()}
    assert per == {f"{k}.pdf": sum(v.values()) for k, v in enumerate(truth["perSheet"].values())}
