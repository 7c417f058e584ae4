"""Drawings from end to end: seeded fixtures against their truths, decoding, legends, symbols, bench, sinks, command line."""

import json
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetmeter import benchmark, cli, engine
from sheetmeter.operators import legends as lg
from sheetmeter.operators import symbols as sy
from sheetmeter.operators import tags, titleblock
from sheetmeter.sinks import overlay, results, workbook
from sheetmeter.sources import drawings, fixtures, pdf, sets

# counts of the published truth files of the three seeded sets
TRUTH = {
    "set-01": {"A1": 223, "A2": 183, "B1": 85, "EM": 67, "EX": 35, "SD": 114, "HD": 45, "SP": 118},
    "set-02": {"SD": 63, "SP": 59, "SSO": 67, "SW": 24},
    "set-03": {"A1": 152, "A2": 123, "B1": 74, "EM": 58, "EX": 29, "SD": 92, "HD": 31, "SP": 105, "SSO": 78, "SW": 47},
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("sets")
    fixtures.write_sets(str(at))
    return at


@pytest.fixture(scope="module")
def report(spark, folder):
    return benchmark.run_bench(spark, str(folder))


def test_generated_counts_equal_the_truths():
    for name, want in TRUTH.items():
        _, truth = fixtures.build(name)
        assert truth["items"] == want and sum(sum(s.values()) for s in truth["perSheet"].values()) == sum(want.values())


def test_all_sets_are_counted_exactly(report):
    got = {}
    for r in report.items.collect():
        got.setdefault(r["set"], {})[r["key"]] = r["predicted"]
    assert got == TRUTH
    sets_ = {r["set"]: r for r in report.sets.collect()}
    assert all(r["strict_pass"] and r["weighted_pass"] and r["weighted_error"] == 0 and r["error"] is None for r in sets_.values())
    assert tuple(report.summary.first()) == (3, 3, 3, 0.0, 0) and report.extras.count() == 0


def test_sources_of_counts_and_signatures(report):
    t = report.takeoffs[0]
    by = {(r["drawing_id"].split("/")[-3], r["tag"]): r["source"] for r in t.counts.collect()}
    assert {by["set-01", k] for k in TRUTH["set-01"]} == {"vector"} and {by["set-02", k] for k in TRUTH["set-02"]} == {"symbol"}
    assert {by["set-03", k] for k in fixtures.LIGHTING} == {"vector"} and {by["set-03", k] for k in (*fixtures.FIRE, *fixtures.POWER)} == {"symbol"}
    size = {r["item_id"]: (r["reference_elements"], r["mean_score"]) for r in t.stats.where(F.col("drawing_id").contains("set-02")).collect()}
    assert size == {"SSO": (2, 1.0), "SP": (5, 1.0), "SD": (2, 1.0), "SW": (3, 1.0)}
    assert t.warnings.count() == 0


def test_title_blocks(report):
    got = {r["drawing_number"]: (r["title"], r["scale"]) for r in report.takeoffs[0].title_blocks.collect()}
    assert got["E-301"] == ("LEVEL 3 LIGHTING AND FIRE ALARM LAYOUT", 100) and got["M-201"][1] == 200 and len(got) == 5


def test_sinks(spark, report, folder, tmp_path):
    t = report.takeoffs[0]
    docs = {r["drawing_id"].split("/")[-3]: json.loads(r["json"]) for r in results.result_documents(t).collect()}
    assert {i["item_id"]: i["count"] for i in docs["set-02"]["items"]} == TRUTH["set-02"]
    assert sum(len(p["detections"]) for p in docs["set-01"]["pages"]) == 870 and "signature" not in json.dumps(docs)
    lines = [r["line"] for r in results.console_lines(t).where(F.col("drawing_id").contains("set-02")).sort("item_seq").collect()]
    assert len(lines) == 4 and lines[0].split()[1:3] == [str(TRUTH["set-02"][lines[0].split()[0]]), "symbol"]
    text = results.report_text(report).split("\n")
    assert text[0].startswith("set-01     PASS strict  PASS weighted   0.0%  items   8/  8") and "3 of 3 sets within ±5% on every item (3 of 3" in results.report_text(report)
    assert results.report_document(report, "x")["summary"]["strict"] == 3
    workbook.write_bill(t, str(tmp_path / "bill.xlsx"))
    with zipfile.ZipFile(tmp_path / "bill.xlsx") as z:
        sheets = [z.read(f"xl/worksheets/sheet{i}.xml").decode() for i in (1, 2, 3)]
    assert sheets[2].count("<row ") == 1 + 870 + 213 + 789 and "IF(ISNUMBER(E" in sheets[0] and "Section A to collection" in sheets[0] and "(type A1)" in sheets[0]
    assert sum(r["count"] for r in workbook.bill_lines(t).collect()) == 870 + 213 + 789
    assert [r[1] for r in workbook.drawing_numbers(t).sort("place").collect()] == ["E-301", "E-302", "M-201", "E-401", "E-402"]
    files = drawings.read_files(spark, str(folder / "set-02" / "drawings"))
    marked = bytes(overlay.overlays(t, files).first()["content"])
    before, after = pdf.decode(files.first()["content"])[0], pdf.decode(marked)[0]
    assert len(after.paths) == len(before.paths) + 213 + 4 and len(after.spans) == len(before.spans) + 213 + 4 + 1


def test_pdf_boxes():
    m, w, h = pdf.viewport([0, 0, 200, 100], 0)
    assert (w, h) == (200, 100) and pdf.to_page_space(m, 10, 20, 30, 40) == (10, 40, 30, 40)
    for turn in (90, 180, 270):
        m, w, h = pdf.viewport([0, 0, 200, 100], turn)
        assert (w, h) == ((100, 200) if turn % 180 else (200, 100))
        assert all(0 <= v <= 200 for p in ((0, 0), (200, 100)) for v in pdf.mapped(m, *p))


def test_content_operators():
    content = b"""q 2 0 0 2 10 10 cm 3 w 0 0 m 10 0 l 10 10 l h S Q  1 0 0 1 0 0 cm 5 5 20 10 re f  0 0 m 0 10 10 10 10 0 c B
    0 0 m 5 5 l n  q 100 0 0 100 0 0 cm Q  BT /F1 10 Tf 1 0 0 1 50 50 Tm (Hello \\(x\\)) Tj 0 -12 Td [(A) -50 (B)] TJ ( ) Tj ET"""
    page = pdf.decode(pdf.write([(200, 100, content)]))[0]
    a, b, c = page.paths
    assert (a["stroke"], a["fill"], a["line_width"], a["x"], a["y"], a["w"], a["h"]) == (True, False, 6.0, 10.0, 70.0, 20.0, 20.0)
    assert a["subpaths"][0]["closed"] and (b["fill"], b["x"], b["y"], b["w"], b["h"]) == (True, 5.0, 85.0, 20.0, 10.0)
    assert c["fill"] and c["stroke"] and c["subpaths"][0]["curves"] == 1 and len(c["subpaths"][0]["points"]) == 7
    s, t = page.spans
    assert (s["str"], s["x"], s["y"], s["h"], s["font_size"]) == ("Hello (x)", 50.0, 40.0, 10.0, 10.0) and t["str"] == "AB" and t["y"] == 52.0
    assert s["w"] == pytest.approx(sum(pdf.HELVETICA[ord(ch) - 32] for ch in "Hello (x)") / 100)


def test_damaged_files_and_empty_pages(spark, tmp_path):
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    (tmp_path / "blank.pdf").write_bytes(pdf.write([(100, 100, b"")]))
    got = {r["drawing_id"].rpartition("/")[2] for r in drawings.read_failures(spark, str(tmp_path)).collect()}
    assert got == {"bad.pdf"}
    at = str(tmp_path / "blank.pdf")
    out = engine.count_drawings(drawings.read_spans(spark, at), drawings.read_pages(spark, at), drawings.read_paths(spark, at))
    assert out.counts.count() == 0 and [r["warning"] for r in out.warnings.collect()] == ["no legend found; nothing to count"]


def test_sets_that_do_not_run(spark, tmp_path):
    for name, truth in (("a", '{"items": {"X": "two"}}'), ("b", '{"items": {"X": 2}}'), ("c", "no json")):
        (tmp_path / name / "drawings").mkdir(parents=True)
        (tmp_path / name / "ground_truth.json").write_text(truth)
    (tmp_path / "a" / "drawings" / "x.pdf").write_bytes(pdf.write([(100, 100, b"")]))
    (tmp_path / "d").mkdir()
    assert [tuple(r) for r in sets.discover_sets(spark, str(tmp_path)).select("set", F.size("drawings")).sort("set").collect()] == [("a", 1), ("b", 0), ("c", 0)]
    assert sets.discover_sets(spark, str(tmp_path / "none")).count() == 0
    r = benchmark.run_bench(spark, str(tmp_path))
    errors = {x["set"]: x["error"] for x in r.sets.collect()}
    assert errors["a"].startswith("ground truth must be") and errors["b"] == "no drawings" and set(errors) == {"a", "b", "c"}
    assert r.summary.first()["failed"] == 3 and r.summary.first()["mean_error"] == 1.0
    with pytest.raises(ValueError):
        benchmark.run_bench(spark, str(tmp_path), ["zzz"])


def test_mapping_file_overrides(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "ground_truth.json").write_text('{"items": {"b": 1, "a": 2}, "descriptions": {"a": "first"}, "mapping": {"a": ["x"], "b": ["y"]}}')
    (tmp_path / "s" / "mapping.json").write_text('{"a": ["z", "w"]}')
    truth, errors = sets.read_truth(spark, str(tmp_path))
    assert [tuple(r)[1:] for r in truth.sort("key_seq").collect()] == [(0, "b", 1, None, ["y"]), (1, "a", 2, "first", ["z", "w"])] and errors.count() == 0


# ---- legends and title blocks on literals

def spans_of(spark, rows, drawing="d", page=1):
    return spark.createDataFrame([(drawing, page, i, *r) for i, r in enumerate(rows)], drawings.SPANS)


def pages_of(spark, width=1000.0, height=800.0):
    return spark.createDataFrame([("d", 1, width, height)], drawings.PAGES)


def read(spark, rows, exclude=()):
    boxes = spark.createDataFrame([("d", 1, *b) for b in exclude], "drawing_id string, page int, x double, y double, w double, h double")
    return lg.read_legends(spans_of(spark, rows), pages_of(spark), boxes).sort("legend", "item_seq").collect()


def words(*rows, size=10.0):
    return [(s, float(x), float(y), 6.0 * len(s), size, size) for s, x, y in rows]


def test_row_legend_ends_at_a_gap_and_a_stop_heading(spark):
    rows = words(("LEGEND", 100, 100), ("A1", 120, 120), ("DOWNLIGHT", 160, 120), ("A2", 120, 140), ("PANEL", 160, 140), ("MIRROR LIGHT", 160, 160))
    got = read(spark, rows + words(("B9", 120, 300), ("FAR AWAY", 160, 300)))
    assert [(r["id"], r["tag"], r["description"]) for r in got] == [("A1", "A1", "DOWNLIGHT"), ("A2", "A2", "PANEL"), ("L3", None, "MIRROR LIGHT")]
    assert [r["id"] for r in read(spark, rows + words(("NOTES", 120, 178), ("B9", 120, 190), ("AFTER", 160, 190)))] == ["A1", "A2", "L3"]
    assert got[0]["symbol_box"]["x"] == 40 and got[0]["legend_box"]["x"] < 100
    assert read(spark, rows, [(90.0, 90.0, 100.0, 30.0)]) == []


def test_stray_headings_are_no_legends(spark):
    assert read(spark, words(("LEGEND", 100, 100), ("just a sentence", 120, 120))) == []
    assert read(spark, words(("LEGEND", 100, 100))) == [] and read(spark, words(("no heading", 1, 1))) == []


def test_table_legend(spark):
    rows = words(("LEGEND", 100, 100), ("MANUFACTURER", 400, 100), ("MOUNTING", 600, 100), ("A", 110, 140), ("RECESSED LUMINAIRE", 160, 140), ("WITH DIFFUSER", 160, 151), ("ACME 1", 400, 140), ("D", 110, 180), ("WALL LIGHT FITTING", 160, 180), ("ACME 2", 400, 180), ("SUSPENDED FITTING", 160, 220))
    got = read(spark, rows)
    assert [(r["id"], r["tag"], r["description"], r["reference"]) for r in got] == [("A", "A", "RECESSED LUMINAIRE WITH DIFFUSER", "ACME 1"), ("D", "D", "WALL LIGHT FITTING", "ACME 2"), ("L3", None, "SUSPENDED FITTING", None)]


def test_heading_inside_an_accepted_legend_is_passed_over(spark):
    big = words(("LEGEND", 100, 100), size=14.0) + words(("A1", 120, 125), ("DOWNLIGHT", 160, 125), ("SYMBOLS", 160, 140), ("A2", 120, 155), ("PANEL", 160, 155))
    assert {r["legend"] for r in read(spark, big)} == {0}


def test_title_block_values(spark):
    block = lambda rows: titleblock.read_title_blocks(spans_of(spark, rows), pages_of(spark)).first()
    r = block(words(("DRAWING TITLE", 500, 700), ("THE TITLE", 620, 700), ("DRAWING NO: E-1", 500, 715), ("SCALE", 500, 730), ("1 : 50", 500, 745)))
    assert (r["drawing_number"], r["title"], r["scale"]) == ("E-1", "THE TITLE", 50) and r["box"]["x"] + r["box"]["w"] == 1000
    r = block(words(("DRAWING NO", 500, 700), ("REV", 600, 700), ("E-9", 500, 715)))
    assert r["drawing_number"] == "E-9"  # the neighbour is a label, so the value is below
    r = block(words(("DRAWING NO", 500, 700), ("REV", 600, 700), ("STATUS", 500, 715)))
    assert r["drawing_number"] is None
    r = block(words(("shown at 1:75 somewhere", 10, 10)))
    assert (r["scale"], r["box"]) == (75, None)


def test_notes(spark):
    rows = words(("NOTES", 50, 600), ("1. A SENTENCE OF SOME LENGTH", 50, 615), ("short", 50, 630), ("2. ANOTHER ONE THAT IS LONGER STILL", 52, 645), ("1. NOT IN THE COLUMN AT ALL", 300, 615))
    b = titleblock.notes_boxes(spans_of(spark, rows)).first()["box"]
    assert (b["x"], b["y"], b["h"]) == (40, 590, 75) and b["w"] == 6.0 * 35 + 20


def test_tags_of_each_drawing(spark):
    spans = spark.createDataFrame([("d", 1, 0, "A1", 0.0, 0.0, 5.0, 5.0, 5.0), ("e", 1, 0, "A1", 0.0, 0.0, 5.0, 5.0, 5.0), ("d", 1, 1, "3 NO. A1", 50.0, 0.0, 5.0, 5.0, 5.0), ("d", 1, 2, "A1", 200.0, 0.0, 5.0, 5.0, 5.0)], drawings.SPANS)
    items = spark.createDataFrame([("d", "A1")], "drawing_id string, tag string")
    out = spark.createDataFrame([("d", 1, 190.0, -10.0, 30.0, 30.0)], "drawing_id string, page int, x double, y double, w double, h double")
    got = tags.tag_detections(spans, items, out).collect()
    assert sorted((r["drawing_id"], r["multiplier"]) for r in got) == [("d", 1), ("d", 3)]


# ---- symbols on literals

def shape(kind, index, x=0.0, y=0.0, s=20.0, turn=0.0, mirror=False, fill=False):
    """A flagged glyph's part as a path: a ring, or a pole with a flag at the side."""
    if kind == "ring":
        pts = [(math.cos(a) / 2, math.sin(a) / 2) for a in (2 * math.pi * k / 24 for k in range(25))]
    else:
        pts = {"pole": [(0, 0), (0.5, 0.5)], "flag": [(0.5, 0.5), (0.3, 0.5)]}[kind]
    out = []
    for a, b in pts:
        b = -b if mirror else b
        out.append({"x": x + s * (a * math.cos(turn) - b * math.sin(turn)), "y": y + s * (a * math.sin(turn) + b * math.cos(turn))})
    sub = [{"points": out, "closed": False, "curves": 4 if kind == "ring" else 0}]
    bx, by, w, h = pdf.bounds(sub)
    return {"drawing_id": "d", "page": 1, "index": index, "subpaths": sub, "x": bx, "y": by, "w": w, "h": h, "fill": fill, "stroke": not fill, "line_width": 1.0}


def paths_of(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in ("drawing_id", "page", "index", "subpaths", "x", "y", "w", "h", "fill", "stroke", "line_width")) for r in rows], sy.PATHS)


def signature_of(spark, parts):
    e = sy.elements(paths_of(spark, parts)).select(F.struct("index", "x", "y", "w", "h", "kind", "aspect", "fill", "stroke", "angular", "radial", "round", "straight").alias("e"), F.lit(1).alias("k"))
    return sy.signatures(e, ["k"]).first()["signature"].asDict(recursive=True)


def test_six_placements_of_a_glyph(spark):
    glyph = lambda **k: [shape(p, 0, **k) for p in ("ring", "pole", "flag")]
    sig = signature_of(spark, [dict(p, index=i) for i, p in enumerate(glyph())])
    assert len(sig["elements"]) == 3 and sig["elements"][sig["anchor"]]["kind"] == "curve"
    placed = [p for k, (turn, mirror, s) in enumerate([(0, False, 20), (1, False, 20), (2, False, 20), (3, False, 20), (0, True, 20), (0, False, 10)]) for p in glyph(x=100.0 + 60 * k, y=100.0, s=float(s), turn=turn * math.pi / 2, mirror=mirror)]
    shapes = sy.Shapes([sy.element(dict(p, index=i)) for i, p in enumerate(placed)])
    found, _ = sy.claims([{"item_id": "G", "signature": sig}], shapes)
    assert len(found) == 6 and all(m["score"] >= 0.95 for m in found)


def test_larger_glyphs_claim_first(spark):
    one = signature_of(spark, [shape("ring", 0), shape("pole", 1)])
    two = signature_of(spark, [shape("ring", 0), shape("pole", 1), shape("flag", 2)])
    placed = [p for k in range(3) for p in (shape(q, 0, x=100.0 * k) for q in ("ring", "pole", "flag"))]
    shapes = sy.Shapes([sy.element(dict(p, index=i)) for i, p in enumerate(placed)])
    found, seen = sy.claims([{"item_id": "ONE", "signature": one}, {"item_id": "TWO", "signature": two}], shapes)
    assert sorted(m["item_id"] for m in found) == ["TWO"] * 3 and seen["ONE"] >= 3


def test_hatch_bands_become_one_shape(spark):
    band = lambda i, y, x=0.0: dict(shape("pole", i, fill=True), x=x, y=y, w=10.0, h=1.0)
    got = sy.merge_hatch_bands(paths_of(spark, [band(0, 0.0), band(1, 1.0), band(2, 2.0), band(3, 50.0), band(4, 51.0), band(6, 52.0), shape("ring", 7)])).sort("index").collect()
    assert [(r["index"], r["h"]) for r in got] == [(0, 3.0), (3, 1.0), (4, 1.0), (6, 1.0), (7, pytest.approx(20.0))]
    assert got[0]["subpaths"][0]["closed"] and not got[0]["stroke"]


def test_elements():
    e = sy.element(shape("ring", 0))
    assert e["kind"] == "curve" and e["round"] == 1.0 and sum(e["angular"]) == pytest.approx(1) and sum(e["radial"]) == pytest.approx(1)
    assert sy.element(shape("pole", 0))["kind"] == "line" and sy.element(dict(shape("pole", 0), w=0.1, h=0.1))["kind"] == "dot"
    none = dict(shape("pole", 0), subpaths=[])
    assert sy.element(none)["angular"] == [0.0] * 8


def test_turned_histograms_undo_the_turn():
    rng = random.Random(4)
    pts = [(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(40)]
    base = np.array(sy.histograms(np.array(pts), 0, 0, 20)[0])
    for k, (q, m) in enumerate(sy.VARIANTS):
        moved = np.array(sy.histograms(np.array([sy.turned(x, y, q, m) for x, y in pts]), 0, 0, 20)[0])
        assert np.allclose(base[sy._TURNED[k]], moved), (q, m)


def test_letters_inside_a_match_name_it(spark):
    m = spark.createDataFrame([("d", 1, "A", 0.0, 0.0, 20.0, 20.0, 0.9, 0, False, 1.0, [0], None), ("d", 1, "L1", 100.0, 0.0, 20.0, 20.0, 0.8, 1, True, 0.5, [1], None)], sy.MATCHES)
    items = spark.createDataFrame([("d", "A", "A"), ("d", "B", "B"), ("d", "L1", None)], "drawing_id string, item_id string, tag string")
    none = spark.createDataFrame([], "drawing_id string, page int, x double, y double, w double, h double")
    found = lambda *s: {r["item_id"]: r["review_reason"] for r in sy.symbol_detections(m, items, spans_of(spark, words(*s)), none).collect()}
    assert found(("x y z", 500, 500)) == {"A": None, "L1": "symbol match 0.80 (90° mirrored, scale 0.5)"}
    assert set(found(("B", 7, 5))) == {"L1"} and set(found(("A", 7, 5))) == {"A", "L1"} and set(found(("C", 7, 5), ("Z", 107, 5))) == {"A"}


def test_legend_file(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"items": [{"tag": " a1 ", "description": "x"}, {"description": "y"}]}')
    assert [tuple(r) for r in lg.read_legend_file(spark, str(tmp_path / "l.json")).collect()] == [(1, "A1", "A1", "x"), (2, "L2", None, "y")]
    (tmp_path / "bad.json").write_text('{"things": []}')
    with pytest.raises(Exception, match="legend file"):
        lg.read_legend_file(spark, str(tmp_path / "bad.json")).collect()


def test_command_line(spark, folder, tmp_path, capsys):
    drawing = str(folder / "set-02" / "drawings" / fixtures.SETS["set-02"][1])
    args = ["count", drawing, "--out", str(tmp_path / "r.json"), "--xlsx", str(tmp_path / "b.xlsx"), "--overlay", str(tmp_path / "o.pdf"), "--quiet"]
    assert cli.main(args, spark) == 0 and "SSO       67  symbol" in capsys.readouterr().out
    assert json.loads((tmp_path / "r.json").read_text())["schema_version"] == 1 and (tmp_path / "o.pdf").stat().st_size > 1000
    assert cli.main(["bench", str(tmp_path / "nowhere"), "--quiet"], spark) == 1
    assert "ValueError" in capsys.readouterr().err


def test_public_names():
    import sheetmeter

    assert len(sheetmeter.__all__) >= 41 and all(callable(getattr(sheetmeter, n)) or n.isupper() for n in sheetmeter.__all__)


def test_arriving_drawings_are_counted(spark, folder, tmp_path):
    from sheetmeter.streaming import arrivals

    at, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    at.mkdir()
    for name in ("set-02", "blank"):
        data = (folder / name / "drawings" / fixtures.SETS[name][1]).read_bytes() if name in fixtures.SETS else pdf.write([(100, 100, b"")])
        (at / f"{name}.pdf").write_bytes(data)
        arrivals.count_arrivals(spark, str(at), out, checkpoint).awaitTermination()
    got = {r["tag"]: (r["count"], r["batch"]) for r in spark.read.parquet(out).collect()}
    assert got == {k: (n, 0) for k, n in TRUTH["set-02"].items()}
